"""Books as text lines.

A line is a row with its place in the document, so a transaction of any size is
never gathered; ``sinks.write_lines`` puts the rows in order when it writes them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.money import format_amount
from tallybook.model import (
    ACTION_BALANCE,
    ACTION_CLOSE,
    ACTION_OPEN,
    COST_SEP,
    TRANSACTION_FLAG,
)

#: Document order of rendered transaction lines.
LINE_ORDER = ("date", "statement_no", "transaction_no", "part")
_BLANK, _HEADER, _POSTING = 0, 1, 2

#: What stands for a posting that is still incomplete, and for a header without postings.
INCOMPLETE = "Nothing"

_AMOUNTS = (
    "cp_commodity_final",
    "cp_quantity_final",
    "tc_commodity_final",
    "tc_quantity_final",
)


def render_transactions(
    transactions: DataFrame, completed: DataFrame, numbered: bool = True
) -> DataFrame:
    """Rows ``date, statement_no, transaction_no, part, line`` of a completed book.

    A transaction's header stands before its first complete posting, after an empty
    line; ``numbered`` prefixes it with the transaction number. A cost is written
    only where its commodity is not that of the units.
    """
    complete = F.lit(True)
    for name in ("account", *_AMOUNTS):
        complete = complete & F.col(name).isNotNull()

    # One row per transaction, combined on the map side.
    extents = completed.groupBy("transaction_no").agg(
        F.min(F.when(complete, F.col("statement_no"))).alias("first_no"),
    )
    headed = transactions.select(
        F.col("statement_no").alias("transaction_no"), "date", "narration", "tags"
    ).join(extents.withColumn("has_postings", F.lit(True)), "transaction_no", "left")

    prefix = F.concat(F.col("transaction_no").cast("string"), F.lit(": ")) if numbered else F.lit("")
    header = F.concat(
        prefix,
        F.date_format("date", "yyyy-MM-dd"),
        F.lit(f' {TRANSACTION_FLAG} "'),
        "narration",
        F.lit('" '),
        F.coalesce("tags", F.lit("")),
    )
    headers = headed.filter(F.col("first_no").isNotNull() | F.col("has_postings").isNull()).select(
        "date",
        F.col("first_no").alias("statement_no"),
        "transaction_no",
        F.explode(
            F.when(
                F.col("has_postings").isNull(),
                F.array(F.struct(F.lit(_POSTING).alias("part"), F.lit(INCOMPLETE).alias("line"))),
            ).otherwise(
                F.array(
                    F.struct(F.lit(_BLANK).alias("part"), F.lit("").alias("line")),
                    F.struct(F.lit(_HEADER).alias("part"), header.alias("line")),
                )
            )
        ).alias("at"),
    ).select("date", "statement_no", "transaction_no", "at.part", "at.line")

    units = [format_amount(F.col("cp_quantity_final")), F.col("cp_commodity_final")]
    cost = [F.lit(COST_SEP), format_amount(F.col("tc_quantity_final")), F.col("tc_commodity_final")]
    written = F.when(
        F.col("cp_commodity_final") == F.col("tc_commodity_final"),
        F.concat_ws(" ", "account", *units),
    ).otherwise(F.concat_ws(" ", "account", *units, *cost))
    postings = completed.join(
        transactions.select(F.col("statement_no").alias("transaction_no"), "date"),
        "transaction_no",
    ).select(
        "date",
        "statement_no",
        "transaction_no",
        F.lit(_POSTING).alias("part"),
        F.when(complete, F.concat(F.lit("  "), written)).otherwise(INCOMPLETE).alias("line"),
    )
    return headers.unionByName(postings)


def render_verifications(verifications: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lines, rejects) of normalised assertions.

    Opening and closing name an account; a balance has an amount too. Any other
    combination is a reject.
    """
    action = F.col("action")
    named = F.col("date").isNotNull() & F.col("account").isNotNull()
    no_amount = F.col("quantity").isNull() & F.col("commodity").isNull()
    has_amount = F.col("quantity").isNotNull() & F.col("commodity").isNotNull()
    day = F.date_format("date", "yyyy-MM-dd")
    line = (
        F.when(
            named & no_amount & (action == ACTION_OPEN),
            F.concat_ws(" ", day, F.lit("open"), "account"),
        )
        .when(
            named & no_amount & (action == ACTION_CLOSE),
            F.concat_ws(" ", day, F.lit("close"), "account"),
        )
        .when(
            named & has_amount & (action == ACTION_BALANCE),
            F.concat_ws(
                " ",
                day,
                F.lit("balance"),
                "account",
                format_amount(F.col("quantity")),
                "commodity",
            ),
        )
    )
    judged = verifications.withColumn("line", line)
    return (
        judged.filter(F.col("line").isNotNull()),
        judged.filter(F.col("line").isNull()).drop("line"),
    )
