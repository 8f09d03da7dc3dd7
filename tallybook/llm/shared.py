"""Helpers that the operators share: staging, text blocks, word and shingle hashes."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; bounds the memory of a task.
BLOCK = 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor sees; a session without one (tests) gets a local one."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at


_shipped: set[str] = set()
#: Rows and bytes of a batch between Spark and Python; with Spark's 10,000 rows, and no limit of bytes,
#: one batch of long texts would not fit a worker.
_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 16 * BLOCK}


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors once per application; they need not have it installed.

    Also sets the session's batch limits, where none are set.
    """
    for key, most in _BATCH.items():
        if spark.conf.get(key, None) in (None, "10000"):
            spark.conf.set(key, most)
    package = Path(__file__).resolve().parents[1]
    app = spark.sparkContext.applicationId
    if app in _shipped or not package.is_dir():
        return
    into = Path(tempfile.mkdtemp(prefix="llm-")) / f"{package.name}.zip"
    with zipfile.ZipFile(into, "w") as archive:
        for file in sorted(package.rglob("*.py")):
            archive.write(file, file.relative_to(package.parent))
    spark.sparkContext.addPyFile(str(into))
    _shipped.add(app)


def staged(frame: DataFrame) -> DataFrame:
    """Writes a table to the shared folder and reads it back, which cuts its lineage."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark)}/staged-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def doc_texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text as string, whatever else the table holds; null text is empty."""
    ship(docs.sparkSession)
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *more,
    )


def with_rest(docs: DataFrame) -> DataFrame:
    """doc_id and text as doc_texts gives them, and all other columns in one struct, out of the way."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("doc_id", "text")]
    return doc_texts(docs, F.struct(F.lit(True).alias("_"), *others).alias("rest"))


def like(frame: DataFrame, docs: DataFrame) -> DataFrame:
    """Rows of with_rest in the columns and types of docs; n_chars, if there, follows the text."""
    types = {f.name: f.dataType for f in docs.schema}
    from_ = {"doc_id": F.col("doc_id"), "text": F.col("text"), "n_chars": F.length("text")}
    return frame.select(*((from_.get(c, F.col("rest").getField(c))).cast(t).alias(c) for c, t in types.items()))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def trimmed(task: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """The task, which at its end gives the memory that it freed back to the system.

    Workers are reused; what the allocators keep would add to the needs of the next operator's tasks.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from task(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
            if trim:
                trim(0)

    return run


def text_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and where each row starts (one more than rows)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(at):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def blocks(at: np.ndarray, size: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Row ranges of about `size` bytes each; a longer row stands alone."""
    first, rows = 0, len(at) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(at, at[first] + size, "right")) - 1)
        yield first, min(last, rows)
        first = last


def slices(batch: pa.RecordBatch, column: str = "text", size: int = 4 * BLOCK) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about `size` bytes in a column, so that what is made of them stays small."""
    values = batch.column(column)
    lengths = pc.fill_null(pc.binary_length(values), 0).to_numpy(zero_copy_only=False)
    for i, j in blocks(np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)]), size):
        yield batch.slice(i, j - i)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over all output bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


@functools.cache
def _byte_values() -> np.ndarray:
    return mix(np.arange(1, 257, dtype=np.uint64) * _ODD)


#: Powers that are kept between calls; workers live on, and longer texts are rare.
_KEPT = 19


@functools.cache
def _kept_powers() -> tuple[np.ndarray, np.ndarray]:
    return _new_powers(_KEPT)


def _powers(exponent: int) -> tuple[np.ndarray, np.ndarray]:
    """At least 2**exponent powers of the odd base and of its inverse modulo 2**64."""
    return _kept_powers() if exponent <= _KEPT else _new_powers(exponent)


def _new_powers(exponent: int) -> tuple[np.ndarray, np.ndarray]:
    n = 1 << exponent
    inverse = pow(int(_ODD), -1, 1 << 64)
    out = []
    for base in (int(_ODD), inverse):
        powers = np.empty(n, np.uint64)
        powers[0], have = 1, 1
        while have < n:
            powers[have : 2 * have] = powers[:have] * np.uint64(pow(base, have, 1 << 64))
            have *= 2
        out.append(powers)
    return out[0], out[1]


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z to a-z; no other byte changes."""
    return np.where((data >= 65) & (data <= 90), data + 32, data)


def words(
    data: np.ndarray, at: np.ndarray, solid: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every run of solid bytes (by default those other than space and
    \\x09-\\x0D), and the number of words before each row (one more than rows). A word never
    crosses rows."""
    n = len(data)
    if n == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    if solid is None:
        solid = (data != 32) & ((data < 9) | (data > 13))
    begins = solid.copy()
    begins[1:] &= ~solid[:-1]
    ends = solid.copy()
    ends[:-1] &= ~solid[1:]
    inner = at[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    powers, inverse = _powers(int(n).bit_length())
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[data] * powers[:n], out=total[1:])
    return start, end, mix((total[end] - total[start]) * inverse[start]), np.searchsorted(start, at)


def grams(values: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` values; as many as fit into the whole array."""
    if len(values) < size:
        return np.zeros(0, np.uint64)
    out, width = values, 1
    need, total, done = size, None, 0
    while need:
        if need & 1:  # the run so far, then this power of two behind it
            part = out[done : done + len(values) - size + 1]
            total = part if total is None else total * np.uint64(pow(int(_ODD), width, 1 << 64)) + part
            done += width
        need >>= 1
        if need:
            out = out[:-width] * np.uint64(pow(int(_ODD), width, 1 << 64)) + out[width:]
            width *= 2
    return mix(total)


def gram_rows(count_before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For rows with so many words before them: (index of each gram that lies in one row, its row)."""
    lengths = np.maximum(np.diff(count_before) - size + 1, 0)
    row = np.repeat(np.arange(len(lengths)), lengths)
    before = np.concatenate([[0], np.cumsum(lengths)])[:-1]
    return count_before[:-1][row] + np.arange(len(row)) - before[row], row


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """node and component (smallest node reachable) for undirected links a, b of longs.

    Large-star and small-star in turn: every node is linked with the smallest it knows, so the
    number of rounds follows the logarithm of the longest path and rows never exceed the links.
    Each round is staged in the shared folder. Nodes without links are not listed.
    """
    links = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    for _ in range(rounds):
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("low")).select("a", F.least("a", "low").alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        small_low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = (
            large.join(small_low, "a")
            .select(F.explode(F.array(F.struct("b", "low"), F.struct(F.col("a").alias("b"), "low"))).alias("x"))
            .select(F.col("x.b").alias("a"), F.col("x.low").alias("b"))
            .where("a <> b")
            .distinct()
        )
        after = staged(small)
        settled = _fingerprint(after) == _fingerprint(links)
        links = after
        if settled:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = links.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)


def _fingerprint(links: DataFrame) -> tuple:
    row = links.agg(
        F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)"))
    ).first()
    return tuple(row)
