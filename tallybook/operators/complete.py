"""Fill in the amounts a transaction leaves out, and find what does not balance.

A transaction balances when its costs sum to zero per cost commodity. Where they
do not, the first commodity (by name) that is off supplies the amount for every
posting of the transaction that has a gap.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybook.functions.money import to_final
from tallybook.model import measure

_AMOUNTS = ("cp_commodity", "cp_quantity", "tc_commodity", "tc_quantity")

#: Postings of one transaction that one task of the completing join takes.
ROWS_PER_TASK = 2_000_000


def _has_gap() -> Column:
    gap = F.lit(False)
    for name in _AMOUNTS:
        gap = gap | F.col(name).isNull()
    return gap


def _amounts_owed(postings: DataFrame) -> DataFrame:
    """Per transaction: the amount that would balance it, and how many postings have a gap.

    Sums are combined on the map side before either shuffle, so a transaction
    with very many postings sends one row per commodity and task.
    """
    per_commodity = postings.groupBy("transaction_no", "tc_commodity").agg(
        F.sum("tc_quantity").alias("cost"),
        F.count(F.when(_has_gap(), True)).alias("gaps"),
    )
    # A cost without a commodity takes no part in balancing.
    is_off = F.col("tc_commodity").isNotNull() & (F.col("cost") != 0)
    return per_commodity.groupBy("transaction_no").agg(
        F.min(
            F.when(is_off, F.struct("tc_commodity", (-F.col("cost")).alias("totals")))
        ).alias("owed"),
        F.sum("gaps").alias("gaps"),
    )


def balancing_rows(postings: DataFrame) -> DataFrame:
    """One row per transaction that does not balance: commodity and amount to add."""
    return (
        _amounts_owed(postings)
        .filter(F.col("owed").isNotNull())
        .select("transaction_no", "owed.tc_commodity", "owed.totals")
    )


def _final_columns(postings: DataFrame, fill: dict[str, Column]) -> list[Column | str]:
    kept = [name for name in postings.columns if name not in _AMOUNTS]
    finals = []
    for by in ("cp", "tc"):
        m = measure(by)
        commodity, quantity = F.col(m.commodity), F.col(m.quantity)
        if fill:
            commodity = F.coalesce(commodity, fill["commodity"])
            quantity = F.coalesce(quantity, fill["quantity"])
        finals += [
            commodity.alias(m.commodity_final),
            to_final(quantity).alias(m.quantity_final),
        ]
    return [*kept, *finals]


def complete_transactions(
    postings: DataFrame, rows_per_task: int = ROWS_PER_TASK
) -> DataFrame:
    """Postings with final commodities and quantities (two decimals).

    A posting without a gap needs nothing from its transaction, so it is projected
    where it is read and never shuffled. Only postings with a gap join the
    amounts owed. A transaction with more than ``rows_per_task`` gaps is cut into
    shares that go to different tasks; the list of such transactions has at most
    (rows / rows_per_task) entries, which is why it may be broadcast.
    """
    shares = F.ceil(F.col("gaps") / F.lit(rows_per_task)).cast("int").alias("shares")
    # Which transactions are large needs the postings with a gap alone.
    gaps = postings.filter(_has_gap()).groupBy("transaction_no").agg(F.count(F.lit(1)).alias("gaps"))
    large = gaps.select("transaction_no", shares).filter(F.col("shares") > 1)
    owed = _amounts_owed(postings).filter((F.col("gaps") > 0) & F.col("owed").isNotNull())
    owed = owed.select("*", shares)

    with_gap = (
        postings.filter(_has_gap())
        .join(F.broadcast(large), "transaction_no", "left")
        .withColumn(
            "share",
            F.when(
                F.col("shares").isNotNull(),
                F.pmod(F.xxhash64("statement_no", "account"), F.col("shares")),
            )
            .otherwise(0)
            .cast("int"),
        )
        .drop("shares")
    )
    fills = owed.select(
        "transaction_no",
        F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"),
        F.col("owed.tc_commodity").alias("owed_commodity"),
        F.col("owed.totals").alias("owed_quantity"),
    )
    filled = with_gap.join(fills, ["transaction_no", "share"], "left").select(
        *_final_columns(
            postings,
            {"commodity": F.col("owed_commodity"), "quantity": F.col("owed_quantity")},
        )
    )
    whole = postings.filter(~_has_gap()).select(*_final_columns(postings, {}))
    return whole.unionByName(filled)


def find_imbalances(completed: DataFrame) -> DataFrame:
    """Transactions of a completed table that are off, or have a cost without commodity."""
    return (
        completed.groupBy("transaction_no", "tc_commodity_final")
        .agg(F.sum("tc_quantity_final").alias("totals"))
        .filter((F.col("totals") != 0) | F.col("tc_commodity_final").isNull())
    )


def imbalances(postings: DataFrame) -> DataFrame:
    """Same rows as ``find_imbalances(complete_transactions(postings))``, without completing.

    What completing adds to a transaction depends only on sums and counts, so one
    pass over the raw postings with map-side combining is enough; single postings
    are neither joined nor shuffled. The window runs over at most one row per
    commodity of a transaction.
    """
    m = measure("tc")
    per_commodity = postings.groupBy("transaction_no", m.commodity).agg(
        F.sum(m.quantity).alias("cost"),
        F.sum(to_final(F.col(m.quantity))).alias("rounded"),
        F.count(F.when(F.col(m.quantity).isNull(), True)).alias("blanks"),
    )
    is_off = F.col(m.commodity).isNotNull() & (F.col("cost") != 0)
    owed = F.min(
        F.when(is_off, F.struct(m.commodity, (-F.col("cost")).alias("totals")))
    ).over(W.partitionBy("transaction_no"))
    filled = F.when(F.col("blanks") > 0, F.col("blanks") * to_final(F.col("owed.totals")))
    return (
        per_commodity.withColumn("owed", owed)
        .select(
            "transaction_no",
            F.coalesce(m.commodity, "owed.tc_commodity").alias(m.commodity_final),
            to_final(
                F.when(filled.isNull(), F.col("rounded")).otherwise(
                    F.coalesce("rounded", F.lit(0)) + filled
                )
            ).alias("part"),
        )
        .groupBy("transaction_no", m.commodity_final)
        .agg(F.sum("part").alias("totals"))
        .filter((F.col("totals") != 0) | F.col(m.commodity_final).isNull())
    )


def normalise_verifications(verifications: DataFrame) -> DataFrame:
    """The five columns assertions are rendered from, quantity at two decimals."""
    return verifications.select(
        "date",
        "action",
        "account",
        to_final(F.col("quantity")).alias("quantity"),
        "commodity",
    )
