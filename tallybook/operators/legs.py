"""One statement row to several postings.

A leg is a struct of account, units and cost. An importer gives each row an array
of legs; ``emit`` turns those arrays into transactions and postings.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.accounts import as_column
from tallybook.functions.order import total_before
from tallybook.model import RAW

#: Numbers set aside per source row: its header and up to three legs.
NUMBERS_PER_ROW = 4


def leg(
    account: Column,
    units: tuple[Column, Column | str] | None = None,
    cost: tuple[Column, Column | str] | None = None,
) -> Column:
    """A posting of ``account``, with optional units and cost as (quantity, commodity)."""
    cp_quantity, cp_commodity = units or (F.lit(None), F.lit(None))
    tc_quantity, tc_commodity = cost or (F.lit(None), F.lit(None))
    return F.struct(
        account.alias("account"),
        cp_quantity.cast(RAW).alias("cp_quantity"),
        as_column(cp_commodity).cast("string").alias("cp_commodity"),
        tc_quantity.cast(RAW).alias("tc_quantity"),
        as_column(tc_commodity).cast("string").alias("tc_commodity"),
    )


def with_legs(rows: DataFrame, parts: Sequence[tuple[Column, Column]]) -> DataFrame:
    """Add ``legs`` and ``n_legs`` from (does it apply, leg) pairs, in leg order.

    A leg that does not apply is null in the array; one that does carries its place
    among those that do. A row that is in order but makes no posting has a single
    entry with the place -1. Rows with a ``reason`` to refuse them have none.
    """
    flags = [f"_applies_{at}" for at in range(len(parts))]
    rows = rows.withColumns(
        {
            flag: F.coalesce(applies, F.lit(False)).cast("int")
            for flag, (applies, _) in zip(flags, parts)
        }
    )
    place = F.lit(0)
    placed = []
    for flag, (_, part) in zip(flags, parts):
        placed.append(F.when(F.col(flag) == 1, F.struct(place.alias("leg_no"), part.alias("leg"))))
        place = place + F.col(flag)
    nothing = leg(F.lit(None).cast("string")).alias("leg")
    placed.append(
        F.when(
            (place == 0) & F.col("reason").isNull(), F.struct(F.lit(-1).alias("leg_no"), nothing)
        )
    )
    return rows.withColumns({"legs": F.array(*placed), "n_legs": place}).drop(*flags)


def emit(
    rows: DataFrame, original: Sequence[str], consecutive: bool = False
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(transactions, postings, rows without postings) of rows after ``with_legs``.

    Rows need ``row_no``, ``date`` and ``narration``. Statement numbers grow with
    ``row_no``; each row owns a block of ``NUMBERS_PER_ROW`` of them, so numbering
    needs no shuffle. With ``consecutive`` the numbers count every header and leg in
    document order from zero, and a row without legs takes one number; that costs a
    running total over ``file``, ``chunk`` and ``pos``.

    All three tables select from the exploded legs. The outer explode keeps the
    optimiser from deriving a filter on the array, which would evaluate the whole
    import a second time below it.
    """
    if consecutive:
        numbers = F.when(F.col("reason").isNull(), 1 + F.col("n_legs")).otherwise(0)
        rows = total_before(rows, numbers).withColumnRenamed("total_before", "transaction_no")
    else:
        rows = rows.withColumn("transaction_no", F.col("row_no") * NUMBERS_PER_ROW)

    exploded = rows.select("*", F.explode_outer("legs").alias("at"))
    place = F.col("at.leg_no")
    file_no = F.lit(0).cast("long").alias("file_no")
    transactions = exploded.filter(place == 0).select(
        F.col("transaction_no").alias("statement_no"),
        file_no,
        "date",
        "narration",
        F.lit(None).cast("string").alias("tags"),
    )
    postings = exploded.filter(place >= 0).select(
        (F.col("transaction_no") + 1 + place).alias("statement_no"),
        "transaction_no",
        file_no,
        "at.leg.*",
    )
    return transactions, postings, exploded.filter(place == -1).select(*original)


def default_cost_to_units(postings: DataFrame) -> DataFrame:
    """Give a posting with units but no cost its units as cost.

    Book text and bank statements imply this; brokerage rows do not, so for them
    it is a step the caller may add before completing.
    """
    no_cost = F.col("tc_quantity").isNull() & F.col("tc_commodity").isNull()
    return postings.withColumns(
        {
            "tc_quantity": F.when(no_cost, F.col("cp_quantity")).otherwise(F.col("tc_quantity")),
            "tc_commodity": F.when(no_cost, F.col("cp_commodity")).otherwise(F.col("tc_commodity")),
        }
    )
