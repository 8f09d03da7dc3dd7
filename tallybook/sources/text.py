"""Plain-text books: lines in document order, and the files a book includes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.text import INCLUDE, LINE_END, resolve_path
from tallybook.sources.files import with_file_numbers


def _plain_path() -> Column:
    """Path of the row's file. It comes percent-encoded and has to equal the path as read; a local
    one is written with one slash, however it was given."""
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    decoded = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(path.contains("%"), decoded).otherwise(path)


def read_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``file, chunk, pos, line`` of text files, split wherever Spark splits them."""
    return (
        spark.read.option("lineSep", "\n")
        .text(paths)
        .select(
            _plain_path().alias("file"),
            F.col("_metadata.file_block_start").alias("chunk"),
            F.monotonically_increasing_id().alias("pos"),
            F.regexp_replace("value", "\r$", "").alias("line"),
        )
    )


def _include_edges(lines: DataFrame) -> list[tuple[str, str]]:
    """(including file, path as written), each once, in the order of their first lines.

    What comes to the driver is the list of input files, which ``spark.read`` needs
    there anyway.
    """
    path = F.regexp_extract("line", INCLUDE + LINE_END, 1)
    found = (
        lines.filter(F.col("line").startswith("include"))
        .select("file", "chunk", "pos", path.alias("path"))
        .filter(F.col("path") != "")
        .groupBy("file", "path")
        .agg(F.min(F.struct("chunk", "pos")).alias("at"))
        .orderBy("file", "at")
    )
    return [(row["file"], row["path"]) for row in found.collect()]


def included_files(spark: SparkSession, path: str) -> list[str]:
    """``path`` and every file reachable through include lines, each once.

    Files are read one include level at a time, all files of a level in one job. The
    result is in reading order: a file's includes follow it, each with its own
    includes before the next.
    """
    children: dict[str, list[str]] = {}
    root: str | None = None
    level = [path]
    while level:
        lines = read_lines(spark, level)
        if root is None:
            root = lines.select("file").first()["file"] if not lines.isEmpty() else path
            children[root] = []
        for file in level:
            children.setdefault(file, [])
        reached = []
        for file, written in _include_edges(lines):
            target = resolve_path(file, written)
            children.setdefault(file, []).append(target)
            if target not in children and target not in reached:
                reached.append(target)
        level = reached

    ordered: dict[str, None] = {}
    pending = [root]
    while pending:
        file = pending.pop()
        if file in ordered:
            continue
        ordered[file] = None
        pending.extend(reversed(children.get(file, [])))
    return list(ordered)


def read_book_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a book and of all it includes, with ``file_no`` in reading order.

    A line of a file that has no number stops the job: it would be lost otherwise.
    """
    files = included_files(spark, path)
    return with_file_numbers(read_lines(spark, files), files, path="file", into="file_no")
