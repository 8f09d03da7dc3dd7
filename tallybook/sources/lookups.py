"""Two-column lookup files without a header. A later line replaces an earlier one."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def last_entry_wins(entries: DataFrame, order: Column) -> DataFrame:
    """One row per ``key``: the ``value`` that stands last in ``order``.

    An aggregate, not a window: copies of one key are combined before the shuffle.
    """
    return entries.groupBy("key").agg(F.max_by("value", order).alias("value"))


def _read(spark: SparkSession, paths: str | Sequence[str], quote: str) -> DataFrame:
    scanned = (
        spark.read.schema("key string, value string")
        .option("quote", quote)
        .option("escape", '"')
        .csv(paths)
        .select(
            F.coalesce("key", F.lit("")).alias("key"),
            F.coalesce("value", F.lit("")).alias("value"),
            F.struct(
                F.col("_metadata.file_path"),
                F.col("_metadata.file_block_start"),
                F.monotonically_increasing_id(),
            ).alias("_at"),
        )
    )
    return last_entry_wins(scanned, F.col("_at"))


def read_symbols(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """description, symbol. Quote characters are part of the text."""
    return _read(spark, paths, quote="")


def read_account_names(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """account id, account name. Quoted fields are allowed."""
    return _read(spark, paths, quote='"')


def lookup_table(spark: SparkSession, entries: Iterable[tuple[str, str]]) -> DataFrame:
    """A lookup given in code."""
    return spark.createDataFrame(list(dict(entries).items()), "key string, value string")
