"""Hard negatives: exact inner products of many candidates at once, packed into wide integers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import ship, staged, trimmed

#: Candidates whose components share one integer; the integers of a block then fit the cache.
_TOGETHER = 2048


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label and x (doubles) of the rows that take part; see hard_negatives."""
    ship(vectors.sparkSession)
    v = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("x")
    )
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", bad))


def whole(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """Rows of floor(scale * component): 64-bit integers, or Python's where those do not reach."""
    x = np.floor(scale * column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim))
    if np.abs(x).max(initial=0) < 2**53:
        return x.astype(np.int64)
    return np.array([[int(v) for v in row] for row in x], object).reshape(len(column), dim)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


class Packed:
    """Candidates whose biased components lie side by side in one wide integer for each dimension.

    A component plus its bias is never negative, and a field holds the largest sum of products that
    can arise, so no field reaches into its neighbour: multiplying the integer of a dimension with an
    anchor's component multiplies all candidates at once, and the sums come out exactly.
    """

    def __init__(self, x: np.ndarray, most: int):
        """x: rows of integers. most: the largest component of any anchor, without its sign."""
        self.count, self.dim = x.shape
        self.bias, self.most = _largest(x), most
        bits = max(1, (max(self.dim, 1) * 2 * max(self.bias, 1) * 2 * max(most, 1)).bit_length())
        self.width = 4 if bits <= 32 else 8 if bits <= 63 else -(-bits // 8)  # bytes of a field
        self.sums = x.sum(1) if self.dim else np.zeros(self.count, np.int64)
        columns = (x + self.bias).T
        if self.width <= 8:
            kind = np.dtype(f"<u{self.width}")
            self.wide = [int.from_bytes(np.ascontiguousarray(c.astype(kind)).tobytes(), "little") for c in columns]
        else:
            self.wide = [int.from_bytes(b"".join(int(v).to_bytes(self.width, "little") for v in c), "little") for c in columns]

    def products(self, anchor: np.ndarray) -> np.ndarray:
        """The inner product of every candidate with an anchor."""
        total, lift = 0, self.most
        for wide, a in zip(self.wide, anchor.tolist(), strict=True):
            total += wide * (a + lift)  # one product for all candidates
        data = total.to_bytes(self.width * self.count, "little")
        over = self.bias * int(anchor.sum()) + self.dim * self.bias * lift
        if self.width <= 8:
            return np.frombuffer(data, f"<u{self.width}").astype(np.int64) - over - lift * self.sums
        fields = [int.from_bytes(data[i : i + self.width], "little") for i in range(0, len(data), self.width)]
        return np.array([f - over - lift * int(s) for f, s in zip(fields, self.sums, strict=True)], object)


def first(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k highest scores, ties by smaller id."""
    if scores.dtype == object:
        return np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    high = np.flatnonzero(scores >= np.partition(scores, -k)[-k]) if len(scores) > k else np.arange(len(scores))
    return high[np.lexsort((ids[high], -scores[high]))[:k]]


class _Shard:
    """Candidates of one length, by label, packed in blocks when the first anchors come."""

    def __init__(self):
        self.rows: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.packed: list[tuple[int, np.ndarray, Packed]] | None = None
        self.most = -1

    def add(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray) -> None:
        for label in np.unique(labels).tolist():
            own = labels == label
            self.rows.setdefault(label, []).append((ids[own], x[own]))

    def blocks(self, most: int) -> list[tuple[int, np.ndarray, Packed]]:
        """Packed for anchors with components up to `most`; packed anew if larger ones come."""
        if self.packed is None or most > self.most:
            self.most, self.packed = most, []
            for label, parts in self.rows.items():
                ids, x = (np.concatenate(c) for c in zip(*parts, strict=True))
                order = np.argsort(ids, kind="stable")
                for i in range(0, len(ids), _TOGETHER):
                    some = order[i : i + _TOGETHER]
                    self.packed.append((label, ids[some], Packed(x[some], most)))
        return self.packed


def _dealt(candidates: DataFrame, anchors: DataFrame, shards: int) -> DataFrame:
    """Candidates (side 0) in shards, and with each of these all anchors (side 1): a candidate moves once."""
    columns = ["dim", "shard", "side", "row", "vec_id", "label", "x", "bands"]
    home = candidates.withColumns(
        {"shard": F.pmod(F.xxhash64("row"), F.lit(shards)).cast("int"), "side": F.lit(0), "bands": F.lit(None).cast("array<bigint>")}
    )
    seen = anchors.withColumns({"shard": F.explode(F.sequence(F.lit(0), F.lit(shards - 1))), "side": F.lit(1)})
    both = home.select(columns).unionByName(seen.select(columns))
    return both.repartition("dim", "shard").sortWithinPartitions("dim", "shard", "side")


def _visits(batches: Iterator[pa.RecordBatch], scale: int) -> Iterator[tuple[_Shard, dict]]:
    """Each anchor with the shard it has come to."""
    here, shard = None, _Shard()
    for b in batches:
        key = np.stack([b.column(c).to_numpy() for c in ("dim", "shard", "side")], 1)
        cuts = [0, *(np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1), len(key)] if len(key) else [0]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            dim, at, side = key[i].tolist()
            part = b.slice(i, j - i)
            if (dim, at) != here:
                here, shard = (dim, at), _Shard()
            ids, labels, x = part.column("vec_id").to_numpy(), part.column("label").to_numpy(), whole(part.column("x"), dim, scale)
            if side == 0:
                shard.add(ids, labels, x)
                continue
            most = 1 << _largest(x).bit_length()
            rows, bands = part.column("row").to_pylist(), part.column("bands").to_pylist()
            for k in range(j - i):
                yield shard, {"row": rows[k], "id": int(ids[k]), "label": int(labels[k]), "x": x[k], "bands": bands[k], "most": most}


def hard_negatives(
    vectors: DataFrame, *, every: int = 100, positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, shard_rows: int = 8192
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score and negative_score.

    Components become floor(scale * component); a score is the integer inner product. Anchors are the
    rows whose id is divisible by `every`. An anchor's positives are its first `positives` other rows of
    its label; for each, the first `negatives` rows of other labels follow whose score lies between `least`
    and `most` hundredths of the positive's. Higher scores come first, then smaller ids.

    Two passes, each exact: anchors against the rows of their label, then, with the bands known,
    against the rows of all others. Candidates are dealt into shards of about `shard_rows` by a hash of the row,
    so a frequent label or vector spreads over all; every anchor visits every shard, and a task gives back only the
    best of each anchor and positive. Products are those of Packed.

    Rows with a null id, label, vector or component, or one that is not finite, take no part. Vectors
    of different lengths are not compared; an empty vector scores 0. Rows that repeat an id are rows of
    their own: one that repeats the anchor's id is no other row, and a positive that is repeated counts as often.
    Anchors without positives, and positives without negatives, give no rows, as does an empty table. A score beyond 64 bits fails the job.
    """
    rows = staged(usable(vectors).withColumns({"dim": F.size("x"), "row": F.monotonically_increasing_id()}))
    shards = max(1, math.ceil(rows.count() / shard_rows))
    anchors = rows.where(F.col("vec_id") % every == 0)

    def alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, a in _visits(batches, scale):
            found = [(ids, packed.products(a["x"])) for label, ids, packed in shard.blocks(a["most"]) if label == a["label"]]
            if not found:
                continue
            ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
            other = np.flatnonzero(ids != a["id"])
            best = other[first(ids[other], score[other], positives)]
            yield _longs({"row": [a["row"]] * len(best), "other_id": ids[best].tolist(), "score": score[best].tolist()})

    def unlike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, a in _visits(batches, scale):
            found = [(ids, packed.products(a["x"])) for label, ids, packed in shard.blocks(a["most"]) if label != a["label"]]
            if not found:
                continue
            ids, score = (np.concatenate(c) for c in zip(*found, strict=True))
            out = {"row": [], "positive_score": [], "negative_id": [], "negative_score": []}
            for band in sorted(set(a["bands"])):
                low, high = -((-least * band) // 100), (most * band) // 100
                inside = np.flatnonzero((score >= low) & (score <= high) & (ids != a["id"]))
                best = inside[first(ids[inside], score[inside], negatives)]
                for name, values in zip(out, ([a["row"]] * len(best), [band] * len(best), ids[best].tolist(), score[best].tolist()), strict=True):
                    out[name] += values
            yield _longs(out)

    none = anchors.withColumn("bands", F.lit(None).cast("array<bigint>"))
    near = _dealt(rows, none, shards).mapInArrow(trimmed(alike), "row long, other_id long, score long")
    own = Window.partitionBy("row").orderBy(F.desc("score"), "other_id")
    best = staged(near.withColumn("place", F.row_number().over(own)).where(F.col("place") <= positives))
    asked = anchors.join(best.groupBy("row").agg(F.collect_list("score").alias("bands")), "row")  # a few scores each
    far = _dealt(rows, asked, shards).mapInArrow(trimmed(unlike), "row long, positive_score long, negative_id long, negative_score long")
    order = Window.partitionBy("row", "positive_score").orderBy(F.desc("negative_score"), "negative_id")
    kept = far.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    pairs = best.select("row", F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
    found = kept.join(pairs, ["row", "positive_score"]).join(anchors.select("row", F.col("vec_id").alias("anchor_id")), "row")
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def _longs(columns: dict[str, list[int]]) -> pa.RecordBatch:
    return pa.record_batch({k: pa.array(v, pa.int64()) for k, v in columns.items()})
