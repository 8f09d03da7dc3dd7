"""A book's tables as Parquet, with the import summary of what was written, and tables staged between steps."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Mapping
from contextlib import contextmanager
from dataclasses import fields

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallybook.model import Book


def write_tables(book: Book, folder: str) -> dict[str, int]:
    """Writes each table of a book below ``folder`` and returns how many rows each has.

    Rows are counted while they are written; no table is read again for the summary.
    """
    counts = {}
    for field in fields(book):
        table = getattr(book, field.name)
        if table is not None:
            seen = Observation(field.name)
            counted = table.observe(seen, F.count(F.lit(1)).alias("rows"))
            counted.write.mode("errorifexists").parquet(f"{folder}/{field.name}")
            counts[field.name] = seen.get["rows"]
    return counts


def staging(spark: SparkSession, folder: str, by: Mapping[str, str] | None = None) -> Callable[[DataFrame, str], DataFrame]:
    """A function that writes a table below ``folder`` under a name, and reads it back; ``by`` names the column
    that a table is partitioned by. A table that is there already stops the job."""

    def stage(table: DataFrame, name: str) -> DataFrame:
        writer = table.write.mode("errorifexists")
        if by and name in by:
            writer = writer.partitionBy(by[name])
        writer.parquet(f"{folder}/{name}")
        return spark.read.schema(table.schema).parquet(f"{folder}/{name}")

    return stage


#: Whether the shuffle files of a query go when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries within leave no shuffle files; else these stay until the driver happens to collect its garbage."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def staging_parts(spark: SparkSession, folder: str) -> Callable[[Iterable[DataFrame], str], DataFrame]:
    """A function that writes the parts of a table below ``folder``, one after another, and reads them back as one.
    What a part shuffled goes once it is written. A part that is there already stops the job."""

    def stage(parts: Iterable[DataFrame], name: str) -> DataFrame:
        paths = []
        for part in parts:
            paths.append(f"{folder}/{name}-{len(paths)}")
            with _shuffles_removed(spark):
                part.write.mode("errorifexists").option("compression", "zstd").parquet(paths[-1])
        return spark.read.schema(part.schema).parquet(*paths)

    return stage
