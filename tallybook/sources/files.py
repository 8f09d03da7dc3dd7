"""Numbers for the files and rows of a scan, added where the rows are read."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from urllib.parse import unquote, urlsplit

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybook.functions.order import LINES_PER_FILE

#: What a lookup that goes to every task may hold; a larger one is merged with the rows instead.
BROADCAST_BYTES = 16 << 20
#: Bytes of a lookup's row beside its path.
_ROW_BYTES = 64


def sized(lookup: DataFrame, rows: int, path_bytes: int) -> DataFrame:
    """The lookup, marked for broadcast if `rows` of it, with paths of so many bytes, are small enough.

    The caller has measured both; Spark knows neither for a list made here nor for an aggregate.
    """
    return F.broadcast(lookup) if rows * (path_bytes + _ROW_BYTES) <= BROADCAST_BYTES else lookup


def with_file_numbers(rows: DataFrame, files: Iterable[str], path: str = "path", into: str = "file") -> DataFrame:
    """Add ``file``: the place of the row's path among the sorted paths of the scan.

    A sequence keeps its own order. The list of files is on the driver already, as the reader keeps it
    there. A short one goes to the rows, which stay where they are; with a long one rows are merged on the path, and adaptive
    execution splits files of very many rows. A path that the list does not have stops the job: its rows would be lost otherwise.
    """
    names = list(dict.fromkeys(files))
    names = names if isinstance(files, Sequence) else sorted(names)
    longest = max(map(len, names), default=0)
    numbers = rows.sparkSession.createDataFrame(list(zip(names, range(len(names)))), "_path string, _file long")
    absent = F.raise_error(F.concat(F.lit("no such file in the scan: "), F.col(path)))
    return (
        rows.join(sized(numbers, len(names), longest), F.col(path) == F.col("_path"), "left")
        .withColumn(into, F.coalesce("_file", absent.cast("long")))
        .drop("_path", "_file")
    )


def with_places(rows: DataFrame, files: Sequence[str], into: str, scan: DataFrame) -> DataFrame:
    """Add ``file`` and the number of each row, made of the file and the row's place in it, from one.

    ``rows`` have ``path``, ``chunk`` (the split's offset) and ``pos``, which grows by one from row to row of
    a split. So all a row needs is what lies before its split: one count for each split, combined where the
    rows are read, summed up within each file. ``scan`` is what the rows were read from; its splits and
    files bound that table, and while it is small no row leaves its task.
    """
    chunks = rows.groupBy("path", "chunk").agg(F.min("pos").alias("_first"), F.count(F.lit(1)).alias("_size"))
    earlier = W.partitionBy("path").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_size").over(earlier), F.lit(0))
    chunks = with_file_numbers(chunks.withColumn("_before", before), files)
    number: Column = F.col("file") * F.lit(LINES_PER_FILE) + F.col("_before") + F.col("pos") - F.col("_first") + 1
    bound = scan.rdd.getNumPartitions() + len(files)
    lookup = sized(chunks.drop("_size"), bound, max(map(len, files), default=0))
    return rows.join(lookup, ["path", "chunk"]).withColumn(into, number).drop("_first", "_before")


def first_lines(spark: SparkSession, files: Sequence[str], *, per_task: int = 64) -> list[tuple[str, bytes]]:
    """(file, the bytes of its first line) of every file that has one, from its first bytes.

    A data source with a small partition for every `per_task` files, which opens each and stops at the first line
    end. One row per file comes to the driver, which lists them anyway. Stores that only Spark reads are scanned instead.
    """
    from pyarrow import fs
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    def opened(file: str):
        parts = urlsplit(file)
        if parts.scheme in ("", "file"):
            return open(unquote(parts.path), "rb")
        system, path = fs.FileSystem.from_uri(unquote(file))
        return system.open_input_stream(path)

    def head(file: str) -> bytes | None:
        with opened(file) as stream:
            found = b""
            while b"\n" not in found and (more := stream.read(1 << 13)):
                found += more
        return found.partition(b"\n")[0] if found else None

    class Reader(DataSourceReader):
        def __init__(self, names: list[str]):
            self.names = names

        def partitions(self):
            return [InputPartition(self.names[i : i + per_task]) for i in range(0, len(self.names), per_task)]

        def read(self, partition):
            for file in partition.value:
                line = head(file)
                if line is not None:
                    yield file, line

    class FirstLines(DataSource):
        @classmethod
        def name(cls) -> str:
            return "tallybook_first_lines"

        def schema(self) -> str:
            return "path string, line binary"

        def reader(self, schema):
            return Reader(json.loads(self.options["files"]))

    if not files:
        return []
    try:
        with opened(files[0]):
            pass
    except Exception:  # not a store that opens outside Spark
        return _scanned_first_lines(spark, files)
    spark.dataSource.register(FirstLines)
    rows = spark.read.format("tallybook_first_lines").option("files", json.dumps(list(files))).load()
    return [(r["path"], bytes(r["line"])) for r in rows.collect()]


def _scanned_first_lines(spark: SparkSession, files: Sequence[str]) -> list[tuple[str, bytes]]:
    lines = spark.read.option("lineSep", "\n").text([unquote(file) for file in files]).select(
        F.input_file_name().alias("path"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"),
        F.col("value").cast("binary").alias("value"),
    )
    first = lines.filter(F.col("chunk") == 0).groupBy("path").agg(F.min_by("value", "pos").alias("line"))
    return [(r["path"], bytes(r["line"])) for r in first.collect()]


# Marks at the beginning of a file, and what they tell.
_MARKS = ((b"\xef\xbb\xbf", "UTF-8"), (b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE"))


def charsets(spark: SparkSession, files: Sequence[str]) -> dict[str | None, list[str]]:
    """The files of each charset that a byte order mark tells; None: no mark."""
    told = {path: next((name for mark, name in _MARKS if line.startswith(mark)), None) for path, line in first_lines(spark, files)}
    found: dict[str | None, list[str]] = {}
    for file in files:
        found.setdefault(told.get(file), []).append(file)
    return found
