"""What each account holds, per commodity, in units or at cost.

An account shows the totals posted to itself and to every account whose name is a
text prefix of its own. The prefix test becomes an equi join: each account lists
its own prefixes, of the few lengths that accounts with totals have, and looks them up
among those, so no pair of accounts is ever compared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.model import measure
from tallybook.functions.money import to_final
from tallybook.operators.accounts import account_hierarchy
from tallybook.operators.complete import balancing_rows


def account_totals(completed: DataFrame, by: str) -> DataFrame:
    """Sum per account and commodity of postings made directly to the account."""
    m = measure(by)
    return completed.groupBy("account", m.commodity_final).agg(
        F.sum(m.quantity_final).alias("total")
    )


def account_totals_from_raw(postings: DataFrame, by: str) -> DataFrame:
    """Same rows as ``account_totals(complete_transactions(postings), by)``.

    Postings are summed before anything is joined: those without a gap straight
    into their account, those with one per transaction and account, because the
    gap is the same amount for all of them. Only these sums meet the amounts owed.
    """
    m = measure(by)
    commodity, quantity = F.col(m.commodity), F.col(m.quantity)
    has_gap = commodity.isNull() | quantity.isNull()
    sums = [
        F.sum(to_final(quantity)).alias("known"),
        F.count(F.when(quantity.isNull(), True)).alias("blanks"),
    ]
    parts = postings.groupBy(
        F.when(has_gap, F.col("transaction_no")).alias("owing"), "account", m.commodity
    ).agg(*sums)

    whole = parts.filter(F.col("owing").isNull()).select(
        "account", commodity.alias(m.commodity_final), F.col("known").alias("part")
    )
    owed = balancing_rows(postings).select(
        F.col("transaction_no").alias("owing"),
        F.col("tc_commodity").alias("owed_commodity"),
        to_final(F.col("totals")).alias("owed_quantity"),
    )
    filled = F.when(F.col("blanks") > 0, F.col("blanks") * F.col("owed_quantity"))
    gaps = (
        parts.filter(F.col("owing").isNotNull())
        .join(owed, "owing", "left")
        .select(
            "account",
            F.coalesce(m.commodity, "owed_commodity").alias(m.commodity_final),
            to_final(
                F.when(filled.isNull(), F.col("known")).otherwise(
                    F.coalesce("known", F.lit(0)) + filled
                )
            ).alias("part"),
        )
    )
    return (
        whole.unionByName(gaps)
        .groupBy("account", m.commodity_final)
        .agg(F.sum("part").alias("total"))
    )


def spread_totals(
    totals: DataFrame, accounts: DataFrame, by: str, ordered: bool = True
) -> DataFrame:
    """Give every account the totals of the accounts that are prefixes of it."""
    m = measure(by)
    posted = totals.filter(F.col(m.commodity_final).isNotNull()).withColumnRenamed(
        "account", "account_right"
    )
    # Names of other lengths than those of accounts with totals cannot match.
    lengths = posted.agg(F.collect_set(F.length("account_right"))).scalar()
    reach = accounts.select("account", F.explode(lengths).alias("upto"))
    prefixes = reach.filter(F.col("upto") <= F.length("account")).select("account", F.substring("account", F.lit(1), F.col("upto")).alias("account_right"))
    held = (
        prefixes.join(posted, "account_right")
        .groupBy("account", m.commodity_final)
        .agg(F.sum("total").alias("total"))
    )
    if ordered:
        held = held.orderBy(
            F.col("account").asc_nulls_last(), F.col(m.commodity_final).asc_nulls_last()
        )
    return held


def balances(completed: DataFrame, by: str, ordered: bool = True) -> DataFrame:
    """Balances of a completed table."""
    return spread_totals(
        account_totals(completed, by),
        account_hierarchy(completed, ordered=False),
        by,
        ordered,
    )


def balances_from_raw(postings: DataFrame, by: str, ordered: bool = True) -> DataFrame:
    """Balances straight from raw postings; the completed table is never built."""
    return spread_totals(
        account_totals_from_raw(postings, by),
        account_hierarchy(postings, ordered=False),
        by,
        ordered,
    )
