"""Account hierarchy and commodity lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.model import ACCOUNT_SEP, measure


def account_hierarchy(postings: DataFrame, ordered: bool = True) -> DataFrame:
    """Every account that is posted to, and every ancestor of one.

    ``ordered`` sorts by path segment, which puts ``A:C`` before ``A-B``.
    """
    paths = postings.select("account").distinct().select(
        F.split("account", ACCOUNT_SEP).alias("path")
    )
    every = (
        paths.select("path", F.explode(F.sequence(F.lit(1), F.size("path"))).alias("depth"))
        .select(F.slice("path", F.lit(1), F.col("depth")).alias("path"))
        .distinct()
    )
    if ordered:
        every = every.orderBy(F.col("path").asc_nulls_first())
    return every.select(F.array_join("path", ACCOUNT_SEP).alias("account"))


def commodities(completed: DataFrame, by: str) -> DataFrame:
    """Distinct final commodities, by units (``cp``) or by cost (``tc``)."""
    return completed.select(measure(by).commodity_final).distinct()
