"""Toxicity: boosted trees over dense text features, with isotonic calibration."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLOCK, blocks, doc_texts, mix, ship, staged, text_bytes, trimmed, words

# Words of the second person.
SECOND_PERSON = (
    "you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine ihr euch euer usted ustedes vosotros ti tus"
).split()
#: Lengths of word beginnings that count as terms, so that inflected forms of one stem meet.
PREFIXES = (4, 5, 6)
N_FEATURES = 16
#: A byte of text takes some hundred bytes of numbers here.
_BLOCK = BLOCK // 2


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte to folded byte (case, digits and signs that stand for letters), is it of a word, its class."""
    fold = np.arange(256, dtype=np.uint8)
    fold[65:91] += 32
    for sign, letter in zip(b"013457@$", b"oieastas", strict=True):
        fold[sign] = letter
    solid = np.zeros(256, bool)
    kind = np.zeros(256, np.uint8)  # 1 capital, 2 digit, 3 sign that hides a letter, 4 punctuation, 5 shouting
    for b in range(256):
        c = chr(b)
        solid[b] = b >= 128 or c.isalnum() or c in "@$*"
        kind[b] = 1 if 65 <= b <= 90 else 2 if 48 <= b <= 57 else 3 if c in "@$*" else 5 if c in "!?" else 4 if 33 <= b < 127 and not c.isalnum() else 0
    return fold, solid, kind


def _terms(data: np.ndarray, at: np.ndarray):
    """Hashes of folded words, of their beginnings (a column for each length, 0 where the word is shorter),
    and each word's row, place and class counts."""
    fold, solid, kind = _tables()
    start, end, whole, before = words(fold[data], at, solid[data])
    rows = np.repeat(np.arange(len(at) - 1), np.diff(before))
    size = end - start
    begin = np.zeros((len(PREFIXES), len(start)), np.uint64)
    for i, k in enumerate(PREFIXES):
        long = np.flatnonzero(size > k)
        if len(long):
            part = _prefix_hashes(fold[data], start[long], k)
            begin[i, long] = mix(part + np.uint64(k))
    return start, end, whole, begin, rows, before, kind[data]


def _prefix_hashes(data: np.ndarray, start: np.ndarray, k: int) -> np.ndarray:
    packed = np.zeros(len(start), np.uint64)
    for i in range(k):
        packed = (packed << np.uint64(8)) | data[start + i]
    return mix(packed)


@dataclass(frozen=True)
class Lexicon:
    """Term hashes, ascending, and how much each speaks for the label (smoothed log odds)."""

    hashes: np.ndarray
    weights: np.ndarray

    def of(self, terms: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.zeros(terms.shape)
        i = np.minimum(np.searchsorted(self.hashes, terms), len(self.hashes) - 1)
        return np.where(self.hashes[i] == terms, self.weights[i], 0.0)


def _second_person() -> np.ndarray:
    data = np.frombuffer(" ".join(SECOND_PERSON).encode(), np.uint8)
    return np.sort(words(data, np.array([0, len(data)]))[2])


def features(data: np.ndarray, at: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of dense features per text; an empty text has zeros."""
    n = len(at) - 1
    out = np.zeros((n, N_FEATURES))
    if not len(data):
        return out
    start, end, whole, begin, rows, before, kind = _terms(data, at)
    count = np.diff(before)
    by_word = lambda x: np.bincount(rows, x, n)
    share = lambda x: by_word(x) / np.maximum(count, 1)
    word_weight = lexicon.of(whole)
    begin_weight = lexicon.of(begin).max(0) if len(start) else np.zeros(0)
    weight = np.maximum(word_weight, begin_weight)
    hit = weight > 0
    you = np.isin(whole, _second_person())
    near = np.zeros(len(whole), bool)
    for d in range(1, 6):  # within five words of the same text
        near[d:] |= hit[d:] & you[:-d] & (rows[d:] == rows[:-d])
        near[:-d] |= hit[:-d] & you[d:] & (rows[d:] == rows[:-d])
    classes = np.zeros((6, len(data) + 1), np.int32)
    for k in range(1, 6):
        np.cumsum(kind == k, out=classes[k, 1:])
    in_word = lambda k: classes[k, end] - classes[k, start]
    in_text = lambda k: (classes[k, at[1:]] - classes[k, at[:-1]]) / np.maximum(np.diff(at), 1)
    size = end - start
    odd = in_word(2) + in_word(3)
    hidden = (odd > 0) & (odd < size)
    top = np.zeros(n)
    np.maximum.at(top, rows[hit], weight[hit])
    hits = by_word(hit)
    out[:, 0] = np.log1p(count)
    out[:, 1] = share(word_weight > 0)
    out[:, 2] = share(begin_weight > 0)
    out[:, 3] = np.log1p(by_word(weight))
    out[:, 4] = top
    out[:, 5] = np.log1p(hits)
    out[:, 6] = share(you)
    out[:, 7] = share(near)
    out[:, 8] = in_text(1)
    out[:, 9] = share((in_word(1) == size) & (size > 2))
    out[:, 10] = in_text(4)
    out[:, 11] = in_text(5)
    out[:, 12] = share(hidden)
    out[:, 13] = share(hidden & hit)
    out[:, 14] = in_text(2)
    out[:, 15] = share(size > 14)
    return out


@dataclass(frozen=True)
class Boosted:
    """Boosted regression trees of equal depth on binned features, logistic loss."""

    edges: list[np.ndarray]
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # feature and bin by inner node, value by leaf
    base: float
    depth: int

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def raw(self, x: np.ndarray) -> np.ndarray:
        binned, out = self.bins(x), np.full(len(x), self.base)
        every = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[every, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, *, trees: int = 60, depth: int = 3, rate: float = 0.15, n_bins: int = 32, ridge: float = 1.0) -> Boosted:
    """Fits on rows in memory; their number is the caller's bound."""
    edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, n_bins + 1)[1:-1])) for i in range(x.shape[1])]
    p = min(max(y.mean(), 1e-4), 1 - 1e-4)
    model = Boosted(edges, [], float(np.log(p / (1 - p))), depth)
    binned, score = model.bins(x), np.full(len(x), model.base)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, n_bins, np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            local = node - first
            best = np.full(n, 1e-9)
            for f in range(x.shape[1]):
                key = local * (n_bins + 1) + binned[:, f]
                gs = np.bincount(key, g, n * (n_bins + 1)).reshape(n, -1).cumsum(1)
                hs = np.bincount(key, h, n * (n_bins + 1)).reshape(n, -1).cumsum(1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                gain[(hs < 0.5) | (total_h - hs < 0.5)] = 0
                b = gain.argmax(1)
                better = gain[np.arange(n), b] > best
                best[better] = gain[np.arange(n), b][better]
                feature[first : first + n][better], cut[first : first + n][better] = f, b[better]
            node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > cut[node])
        local = node - (2**depth - 1)
        leaf = rate * np.bincount(local, g, 2**depth) / (np.bincount(local, h, 2**depth) + ridge)
        score += leaf[local]
        model.trees.append((feature, cut, leaf))
    return model


def isotonic(raw: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pooled adjacent violators: ascending raw scores and the calibrated value at each."""
    order = np.argsort(raw, kind="stable")
    stack: list[list[float]] = []
    for r, v in zip(raw[order], y[order], strict=True):
        stack.append([v, 1.0, r, r])
        while len(stack) > 1 and stack[-2][0] / stack[-2][1] >= stack[-1][0] / stack[-1][1]:
            v2, n2, _, r2 = stack.pop()
            stack[-1][0] += v2
            stack[-1][1] += n2
            stack[-1][3] = r2
    x = np.array([r for s in stack for r in (s[2], s[3])])
    return x, np.repeat([s[0] / s[1] for s in stack], 2)


@dataclass(frozen=True)
class Model:
    lexicon: Lexicon
    trees: Boosted | None
    steps: tuple[np.ndarray, np.ndarray]
    constant: float = 0.0

    def scores(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        if self.trees is None:
            return np.full(len(at) - 1, self.constant)
        raw = self.trees.raw(features(data, at, self.lexicon))
        # A trace of the uncalibrated score keeps the order within a step.
        return np.clip(0.99 * np.interp(raw, *self.steps) + 0.01 / (1 + np.exp(-raw)), 0, 1)


def held_out(doc_id: Column) -> Column:
    """The fold whose labels are never learned from: crc32 of the id as text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, *, sample_rows: int = 20_000, lexicon_terms: int = 400, parts: int = 10) -> Model:
    """Learns lexicon, trees and calibration from labelled documents outside the held-out fold.

    The sample, at most `sample_rows` labelled ids by a hash of the id, is the only bound: its features
    (a few MB) are fitted in the driver. The fit is crossed: the sample is dealt into `parts` by a hash of
    the id; each part's features use a lexicon learned from the others, and the scores that are calibrated are
    those of trees learned from the others. A repeated id counts as toxic if any of its rows is, and its row with the smallest text hash is
    the one learned from. Null ids and null labels are not learned from; without two classes the score is constant.
    """
    spark = docs.sparkSession
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).dropna()
    known = known.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).toPandas()
    if ids["toxic"].nunique() < 2:
        return Model(Lexicon(np.zeros(0, np.uint64), np.zeros(0)), None, (np.zeros(1), np.zeros(1)), float(ids["toxic"].max() if len(ids) else 0))
    ids["part"] = (mix(ids["doc_id"].to_numpy(np.int64).view(np.uint64)) % np.uint64(parts)).astype(np.int32)
    bounded = spark.createDataFrame(ids).select("doc_id", F.col("toxic").cast("int").alias("toxic"), F.col("part").cast("int").alias("part"))
    texts = doc_texts(docs).join(F.broadcast(bounded), "doc_id").withColumn("hash", F.xxhash64("text"))
    texts = texts.groupBy("doc_id").agg(*(F.min_by(c, "hash").alias(c) for c in ("text", "toxic", "part"))).select("text", "toxic", "part")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column(0))
            toxic, part = b.column(1).to_numpy(), b.column(2).to_numpy()
            for i, j in blocks(at, _BLOCK):
                some, ends = data[at[i] : at[j]], at[i : j + 1] - at[i]
                if not len(some):
                    continue
                _, _, whole, begin, rows, _, _ = _terms(some, ends)
                term = np.concatenate([whole, begin.ravel()])
                row = np.tile(rows, 1 + len(PREFIXES))
                pair = np.unique(np.stack([term, row.astype(np.uint64)], 1)[term != 0], axis=0)
                row = pair[:, 1].astype(np.int64)
                for p in np.unique(part[i:j]).tolist():
                    own = part[i:j][row] == p
                    term, where, n = np.unique(pair[own, 0], return_inverse=True, return_counts=True)
                    bad = np.bincount(where, toxic[i:j][row[own]], len(term)).astype(np.int64)
                    yield pa.record_batch({"term": pa.array(term.view(np.int64)), "part": pa.array(np.full(len(term), p, np.int32)), "bad": pa.array(bad), "n": pa.array(n.astype(np.int64))})

    sums = [F.sum(F.when(F.col("part") != p, F.col(c)).otherwise(0)).alias(f"{c}{p}") for p in range(parts) for c in ("bad", "n")]
    # -1: nothing is left out.
    counts = texts.mapInArrow(trimmed(counted), "term long, part int, bad long, n long").groupBy("term").agg(F.sum("bad").alias("bad-1"), F.sum("n").alias("n-1"), *sums)
    counts = staged(counts.where("`bad-1` >= 3"))

    def lexicon(without: int) -> Lexicon:
        used = ids[ids["part"] != without]
        bad_total, total = int(used["toxic"].sum()), len(used)
        bad, n = F.col(f"bad{without}"), F.col(f"n{without}")
        odds = F.log((bad + 0.5) / (n - bad + 0.5)) - F.lit(float(np.log((bad_total + 0.5) / (total - bad_total + 0.5))))
        found = counts.where((bad >= 3) & (bad >= 0.5 * n)).select("term", odds.alias("weight")).where("weight > 2")
        found = found.orderBy(F.desc("weight"), "term").limit(lexicon_terms).toPandas()
        term = found["term"].to_numpy(np.int64).view(np.uint64)
        order = np.argsort(term)
        return Lexicon(term[order], found["weight"].to_numpy(float)[order])

    lexicons = [lexicon(p) for p in range(parts)]
    columns = ", ".join(f"f{i} double" for i in range(N_FEATURES))

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in sorted(set(b.column("part").to_pylist())):
                own = b.filter(pa.array(b.column("part").to_numpy() == p))
                data, at = text_bytes(own.column("text"))
                x = np.concatenate([features(data[at[i] : at[j]], at[i : j + 1] - at[i], lexicons[p]) for i, j in blocks(at, _BLOCK)])
                yield pa.record_batch({"y": own.column("toxic"), "part": own.column("part")} | {f"f{i}": pa.array(x[:, i]) for i in range(N_FEATURES)})

    rows = texts.mapInArrow(trimmed(measured), f"y int, part int, {columns}").toPandas().sort_values([f"f{i}" for i in range(N_FEATURES)])
    x, y, part = rows.filter(regex="^f").to_numpy(float), rows["y"].to_numpy(float), rows["part"].to_numpy()
    whole = lexicon(-1)
    if len(set(y)) < 2:
        return Model(whole, None, (np.zeros(1), np.zeros(1)), float(y.max(initial=0)))
    trees = fit_trees(x, y)
    raw = trees.raw(x)
    for p in range(parts):
        if len(set(y[part != p])) == 2:
            raw[part == p] = fit_trees(x[part != p], y[part != p]).raw(x[part == p])
    return Model(whole, trees, isotonic(raw, y))


def score(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted of every row, from the whole text alone; no shuffle.

    Null text is empty and scored as such; repeated ids are scored row by row; an empty table gives none.
    """

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column("text"))
            s = np.concatenate([np.zeros(0), *(model.scores(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in blocks(at, _BLOCK))])
            yield pa.record_batch({"doc_id": b.column("doc_id"), "held_out": b.column("held_out"), "score": pa.array(s), "predicted": pa.array((s >= threshold).astype(np.int32))})

    rows = doc_texts(docs, held_out(F.col("doc_id").cast("long")).alias("held_out"))
    return rows.mapInArrow(trimmed(scored), "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: Model, *, threshold: float = 0.3) -> DataFrame:
    """The documents, with all their columns, whose score is below the threshold.

    Null text is scored as an empty one and stays null; of repeated rows each is judged by itself.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        data, at = text_bytes(texts)
        return pa.array(np.concatenate([np.zeros(0), *(model.scores(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in blocks(at, _BLOCK))]))

    return docs.where(scored(F.coalesce(F.col("text").cast("string"), F.lit(""))) < threshold)
