"""Searches over vectors: a permutation index for nearest ones, collision counting for near copies."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import components, ship, staged


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (doubles) and dim of the vectors that take part.

    Null, empty and zero vectors and those holding null or non-finite components do not.
    """
    ship(vectors.sparkSession)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", bad)
    return v.where(F.coalesce(fine, F.lit(False))).withColumn("dim", F.size("embedding"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).astype(np.float64, copy=False)


def _runs(key: np.ndarray) -> Iterator[tuple[int, int]]:
    cut = np.flatnonzero(np.any(key[1:] != key[:-1], axis=1)) + 1 if len(key) else []
    edges = [0, *cut, len(key)]
    yield from ((a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a)


class PermutationIndex:
    """Vectors by the order of their nearest pivots, posted in one inverted file per pivot."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, *, pivots: int, prefix: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        norm = np.einsum("ij,ij->i", self.x, self.x)
        self.top = norm.max()
        # With this component all rows have one norm, and nearness by inner product is nearness by angle.
        lifted = np.concatenate([self.x, np.sqrt(np.maximum(self.top - norm, 0))[:, None]], 1)
        pick = _apart(lifted, np.random.default_rng(11).permutation(len(ids))[: 4 * pivots], pivots)
        self.pivots = lifted[pick]
        self.prefix = min(prefix, len(pick))
        near = self._nearest(lifted)
        by_pivot = np.argsort(near.ravel(), kind="stable")
        self.rows = by_pivot // self.prefix
        self.places = by_pivot % self.prefix
        self.starts = np.searchsorted(near.ravel()[by_pivot], np.arange(len(pick) + 1))

    def _nearest(self, lifted: np.ndarray) -> np.ndarray:
        return np.argsort(-(lifted @ self.pivots.T), axis=1, kind="stable")[:, : self.prefix]

    def search(self, query_ids: np.ndarray, q: np.ndarray, *, k: int, share: float, least: int):
        """For each query the ids and inner products of its k best among the rows of least footrule distance."""
        norm = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None]
        near = self._nearest(np.concatenate([q / norm, np.zeros((len(q), 1))], 1))
        take = min(len(self.ids), max(least, math.ceil(share * len(self.ids))))
        for i, query in enumerate(query_ids):
            spans = [slice(self.starts[p], self.starts[p + 1]) for p in near[i]]
            rows = np.concatenate([self.rows[s] for s in spans])
            place = np.concatenate([np.maximum(self.places[s], r) for r, s in enumerate(spans)])
            # The footrule distance of two prefixes is a constant less twice the sum, over common pivots, of
            # the prefix length less the later of the two places.
            common = np.bincount(rows, self.prefix - place, len(self.ids)).astype(np.int64)
            key = common * len(self.ids) + np.arange(len(self.ids))[::-1]  # ties to smaller ids
            found = np.argpartition(-key, take - 1)[:take] if take < len(key) else np.arange(len(key))
            found = found[self.ids[found] != query]
            score = np.einsum("ij,j->i", self.x[found], q[i])  # each row by itself, in one order: equal rows score alike
            best = np.lexsort((self.ids[found], -score))[:k]
            yield query, self.ids[found[best]], score[best]


def _apart(x: np.ndarray, pool: np.ndarray, count: int, alike: float = 0.8) -> np.ndarray:
    """The first `count` of a pool that are not nearly the direction of one before, then any others:
    pivots out of one group of copies would order everything alike."""
    unit = x[pool] / np.maximum(np.linalg.norm(x[pool], axis=1), 1e-300)[:, None]
    near = unit @ unit.T > alike
    chosen: list[int] = []
    taken = np.zeros(len(pool), bool)
    for i in range(len(pool)):
        if len(chosen) < count and not taken[i]:
            chosen.append(i)
            taken |= near[i]
    rest = [i for i in range(len(pool)) if i not in set(chosen)]
    return pool[[*chosen, *rest][:count]]


def nearest(vectors: DataFrame, *, every: int = 20, k: int = 20, pivots: int = 256, prefix: int = 64, share: float = 0.15, least: int = 1500, shard_rows: int = 8192) -> DataFrame:
    """query_id, rank, vec_id and score of the k largest inner products found for each query.

    Queries are the rows whose id is divisible by `every`; candidates are all other rows. The rows are
    dealt by a hash into shards of about `shard_rows`; every shard keeps a permutation index on pivots
    of its own (`pivots` of its vectors, the bounded sample) and sees all queries in blocks. Within a
    shard the `share` of rows (at least `least`) with the smallest footrule distance is ranked anew by
    the inner product in double precision. A task holds one shard and one batch of queries; what it
    gives back is k rows a query. Only vectors of one length are compared. Rows that repeat an id are not
    found for each other; an empty table gives none.
    """
    rows = usable(vectors)
    shards = max(1, math.ceil(rows.count() / shard_rows))
    queries = rows.where(F.col("vec_id") % every == 0)
    data = rows.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")).withColumn("side", F.lit(0))
    asked = queries.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).withColumn("side", F.lit(1))
    dealt = data.unionByName(asked).repartition("dim", "shard").sortWithinPartitions("dim", "shard", "side")

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, index = None, [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("dim", "shard", "side")], 1)
            for i, j in _runs(key):
                dim, shard, side = key[i].tolist()
                if (dim, shard) != here:
                    here, held, index = (dim, shard), [], None
                part = b.slice(i, j - i)
                ids, x = part.column("vec_id").to_numpy(), matrix(part.column("embedding"), dim)
                if side == 0:
                    held.append((ids, x))
                    continue
                if not held:  # no row of this length in the shard
                    continue
                if index is None:
                    index = PermutationIndex(*(np.concatenate(c) for c in zip(*held, strict=True)), pivots=pivots, prefix=prefix)
                    held = [()]
                out = list(index.search(ids, x, k=k, share=share, least=least))
                size = [len(o[1]) for o in out]
                yield pa.record_batch(
                    {
                        "query_id": pa.array(np.repeat([o[0] for o in out], size).astype(np.int64)),
                        "vec_id": pa.array(np.concatenate([o[1] for o in out])),
                        "score": pa.array(np.concatenate([o[2] for o in out])),
                    }
                )

    found = dealt.mapInArrow(searched, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


# --- near copies ---------------------------------------------------------------------------------


def calibrated(cosine: float, dim: int, directions: int, recall: float) -> tuple[float, int]:
    """Window half-width, and the collisions to ask for so that pairs at the cosine are found with `recall`.

    Projections of two unit vectors onto a random unit direction differ by about a normal variable of
    variance |u - v|**2 / dim. The window holds 98.8 % of such differences.
    """
    width = 2.5 * math.sqrt(2 * (1 - cosine) / dim)
    p, total = 0.988, 0.0
    for need in range(directions, 0, -1):
        total += math.comb(directions, need) * p**need * (1 - p) ** (directions - need)
        if total >= recall:
            return width, need
    return width, 1


def directions_of(dim: int, count: int) -> np.ndarray:
    """Orthogonal groups of random unit directions, the same in every task."""
    rng = np.random.default_rng(dim)
    parts = [np.linalg.qr(rng.normal(size=(dim, dim)))[0] for _ in range(math.ceil(count / dim))]
    return np.concatenate(parts)[:count]


#: Steps that half a window has; projections are kept as whole steps, so comparing them is exact.
STEPS = 24


def near_copies(vectors: DataFrame, *, cosine: float = 0.95, directions: int = 16, recall: float = 0.99, block_rows: int = 8192) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row.

    Equal vectors are one class. Every class is projected onto `directions` lines; on each, two vectors
    collide if one lies in the window around the other. The first projection is sorted and cut into
    ranges of about `block_rows` rows (a value that fills more is cut by a hash); a range sees all rows
    within a window of it, sorted by the second projection. A pair must collide on both and on as many
    lines as calibrated for `recall` at the cosine; the cosine of such pairs is then computed in double
    precision. Counting is per vector, so no pair leaves a task, only its counts and the links of
    a spanning forest. A task holds one range and a batch of rows.

    Vectors that take no part (see usable) link with nothing. Rows that repeat an id are rows of their
    own; an empty table gives none.
    """
    rows = usable(vectors)
    # 128 bits of hash stand for the vector.
    rows = rows.withColumns({"h1": F.xxhash64("embedding"), "h2": F.xxhash64(F.lit(1), F.reverse("embedding"))})
    classes = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("weight"))
    # Rows may repeat an id with another vector, so a class has a number of its own; staged, to be the same everywhere.
    classes = staged(classes.withColumn("of", F.monotonically_increasing_id()))
    spark = vectors.sparkSession
    firsts = rows.join(classes, ["h1", "h2"]).where("vec_id = rep").dropDuplicates(["h1", "h2"])

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for i, j in _runs(dims[:, None]):
                dim = int(dims[i])
                x = matrix(b.column("embedding").slice(i, j - i), dim)
                x = x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]
                width, _ = calibrated(cosine, dim, directions, recall)
                steps = np.rint(x @ directions_of(dim, directions).T * (STEPS / width)).astype(np.int32)
                yield pa.record_batch(
                    {
                        "dim": b.column("dim").slice(i, j - i),
                        "id": b.column("of").slice(i, j - i),
                        "weight": b.column("weight").slice(i, j - i),
                        "first": pa.array(steps[:, 0]),
                        "steps": pa.array([r.tobytes() for r in steps], pa.binary()),
                        "unit": pa.array([r.tobytes() for r in x], pa.binary()),
                    }
                )

    points = staged(firsts.select("dim", "of", "weight", "embedding").mapInArrow(projected, "dim int, id long, weight long, first int, steps binary, unit binary"))
    # The first projection has a bounded number of whole steps, so its counts are a small table.
    counts = points.groupBy("dim", "first").count().orderBy("dim", "first").collect()
    ranges, reach = [], STEPS + 1
    for dim, first, n in counts:
        last = ranges[-1] if ranges else None
        if last and last["dim"] == dim and last["n"] + n <= block_rows:
            last["hi"], last["n"] = first, last["n"] + n
        else:
            ranges.append({"dim": dim, "lo": first, "hi": first, "n": n})
    table = [(r["dim"], r["lo"], r["hi"], k, max(1, math.ceil(r["n"] / block_rows))) for k, r in enumerate(ranges)]
    cuts = spark.createDataFrame(table, "dim int, lo int, hi int, cell int, parts int") if table else spark.createDataFrame([], "dim int, lo int, hi int, cell int, parts int")
    # The ranges as lists by first value, so that rows meet them by an equi join.
    inside = cuts.select("dim", F.explode(F.sequence(F.col("lo") - reach, F.col("hi") + reach)).alias("first"), "lo", "hi", "cell", "parts")
    met = points.join(inside, ["dim", "first"])
    home = met.where("first between lo and hi").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("side", F.lit(0))
    seen = met.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("side", F.lit(1))
    columns = ["cell", "part", "side", "dim", "id", "weight", "steps", "unit"]
    dealt = home.select(columns).unionByName(seen.select(columns)).repartition("cell", "part").sortWithinPartitions("cell", "part", "side")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, held, block = None, [], None
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("cell", "part", "side", "dim")], 1)
            for i, j in _runs(key):
                cell, part, side, dim = key[i].tolist()
                if (cell, part) != here:
                    if block is not None:
                        yield block.result()
                    here, held, block = (cell, part), [], None
                s = b.slice(i, j - i)
                read = lambda c, t: np.frombuffer(b"".join(s.column(c).to_pylist()), t).reshape(j - i, -1)  # noqa: B023, E731
                rows_ = (s.column("id").to_numpy(), s.column("weight").to_numpy(), read("steps", np.int32), read("unit", np.float64))
                if side == 0:
                    held.append(rows_)
                elif held:
                    if block is None:
                        block = _Block(*(np.concatenate(c) for c in zip(*held, strict=True)), cosine, calibrated(cosine, dim, directions, recall)[1])
                    block.meet(*rows_)
        if block is not None:
            yield block.result()

    made = staged(dealt.mapInArrow(counted, "a long, b long, n long"))
    links = made.where("b is null").groupBy(F.col("a").alias("of")).agg(F.sum("n").alias("n"))
    group = components(made.where("b is not null").select("a", "b"))
    of_class = classes.join(links, "of", "left").join(group, F.col("of") == F.col("node"), "left")
    of_class = of_class.select("h1", "h2", "rep", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "of").alias("group"))
    smallest = of_class.groupBy("group").agg(F.min("rep").alias("component_id"))
    of_class = of_class.join(smallest, "group").select("h1", "h2", "n_links", "component_id")
    inner = rows.select("vec_id", "h1", "h2").join(of_class, ["h1", "h2"]).select("vec_id", "n_links", "component_id")
    every = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    apart = every.where(~F.coalesce(F.exists("embedding", lambda x: x != 0) & ~F.exists("embedding", bad), F.lit(False)))
    out = inner.unionByName(apart.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


class _Block:
    """The vectors of one range, and what they have met so far."""

    TILE = 512

    def __init__(self, ids, weights, steps, unit, cosine: float, need: int):
        order = np.argsort(steps[:, 1], kind="stable")
        self.ids, self.steps, self.unit = ids[order], steps[order], unit[order]
        self.cosine, self.need = cosine, need
        self.links = np.zeros(len(ids), np.int64)
        self.label = np.arange(len(ids))  # of a forest; a label is the smallest member's place
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []

    def meet(self, ids, weights, steps, unit) -> None:
        order = np.argsort(steps[:, 1], kind="stable")
        ids, weights, steps, unit = ids[order], weights[order], steps[order], unit[order]
        mine, theirs = self.steps.astype(np.uint8), (steps + STEPS).astype(np.uint8)
        label = np.concatenate([self.label, len(self.ids) + np.arange(len(ids))])
        name = np.concatenate([self.ids, ids])
        for i in range(0, len(self.ids), self.TILE):
            j = min(i + self.TILE, len(self.ids))
            low = np.searchsorted(steps[:, 1], self.steps[i, 1] - STEPS, "left")
            high = np.searchsorted(steps[:, 1], self.steps[j - 1, 1] + STEPS, "right")
            for k in range(low, high, 4 * self.TILE):
                m = min(k + 4 * self.TILE, high)
                hits = np.zeros((j - i, m - k), np.uint8)
                for d in range(steps.shape[1]):
                    # Whole steps modulo 256: within the window either way is one comparison.
                    hits += (theirs[k:m, d][None, :] - mine[i:j, d][:, None]) <= 2 * STEPS
                a, b = np.nonzero(hits >= self.need)
                if not len(a):
                    continue
                both = np.abs(self.steps[i + a, :2] - steps[k + b, :2]).max(1) <= STEPS
                a, b = a[both] + i, b[both] + k
                if len(a) > 0.02 * hits.size:
                    cosines = (self.unit[i:j] @ unit[k:m].T)[a - i, b - k]
                else:
                    cosines = np.einsum("ij,ij->i", self.unit[a], unit[b])
                good = (cosines >= self.cosine) & (self.ids[a] != ids[b])
                a, b = a[good], b[good]
                np.add.at(self.links, a, weights[b])
                label = self._join(a, b + len(self.ids), label, name)
        self.label = label[: len(self.ids)]

    def _join(self, a: np.ndarray, b: np.ndarray, label: np.ndarray, name: np.ndarray) -> np.ndarray:
        while True:
            x, y = label[a], label[b]
            apart = x != y
            if not apart.any():
                return label
            a, b = a[apart], b[apart]
            low, high = np.minimum(x, y)[apart], np.maximum(x, y)[apart]
            to = np.arange(len(label))
            np.minimum.at(to, high, low)
            moved = np.unique(high)
            self.edges.append((name[moved], name[to[moved]]))
            while (to[to] != to).any():
                to = to[to]
            label = to[label]

    def result(self) -> pa.RecordBatch:
        a = np.concatenate([self.ids, *(e[0] for e in self.edges)])
        b = np.concatenate([np.zeros(len(self.ids), np.int64), *(e[1] for e in self.edges)])
        n = np.concatenate([self.links, np.zeros(len(a) - len(self.ids), np.int64)])
        none = np.arange(len(a)) < len(self.ids)
        return pa.record_batch({"a": pa.array(a), "b": pa.array(b, mask=none), "n": pa.array(n)})
