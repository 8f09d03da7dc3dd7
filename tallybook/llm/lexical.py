"""Ranked lexical search: documents with one bag of query terms are one class, and a class is scored once."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import blocks, doc_texts, lowered, ship, staged, text_bytes, trimmed, words

#: A term: digits, A-Z, a-z and everything outside ASCII; in UTF-8 these are whole bytes.
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
_SOLID = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])
#: What stands for a null id inside numpy; it sorts last, as null does.
_NONE = np.iinfo(np.int64).max
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Sums and parts of sums that one numpy step works on.
_CELLS = 1 << 20


def terms_of(text: str | None) -> list[str]:
    return [t.translate(_LOWER) for t in TERM.findall(text or "")]


class Vocabulary:
    """The terms of a block of items, found in bytes by hash and then compared byte by byte."""

    def __init__(self, terms: list[str]):
        data, at = text_bytes(pa.array(terms, pa.string()))
        _, _, value, _ = words(data, at, _SOLID[data])
        order = np.argsort(value)
        self.hash, self.index = value[order], order
        if (self.hash[1:] == self.hash[:-1]).any():
            raise ValueError("two terms of one block of items have one hash; use smaller blocks")
        self.data, self.start, self.size = data, at[:-1], np.diff(at)

    def find(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Terms in all of each row, and row and term index of those that belong to the vocabulary."""
        data = lowered(data)
        start, end, value, before = words(data, at, _SOLID[data])
        place = np.minimum(np.searchsorted(self.hash, value), len(self.hash) - 1)
        met = np.flatnonzero(self.hash[place] == value)
        term, start, size = self.index[place[met]], start[met], (end - start)[met]
        same = size == self.size[term]
        for k in range(int(self.size.max(initial=0))):
            rest = np.flatnonzero(same & (size > k))
            same[rest] = data[start[rest] + k] == self.data[self.start[term[rest]] + k]
        row = np.searchsorted(before, met, "right") - 1
        return np.diff(before), row[same], term[same]


def bags(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """doc_id, n (terms of the whole text), and terms (indexes into the vocabulary, ascending) with tfs."""
    known = Vocabulary(vocabulary)
    size = len(vocabulary)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column("text"))
            for i, j in blocks(at):
                n, row, term = known.find(data[at[i] : at[j]], at[i : j + 1] - at[i])
                pair, tf = np.unique(row * size + term, return_counts=True)
                offsets = pa.array(np.searchsorted(pair, np.arange(j - i + 1) * size).astype(np.int32))
                yield pa.record_batch(
                    {
                        "doc_id": b.column("doc_id").slice(i, j - i),
                        "n": pa.array(n.astype(np.int64)),
                        "terms": pa.ListArray.from_arrays(offsets, pa.array((pair % size).astype(np.int32))),
                        "tfs": pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32))),
                    }
                )

    return doc_texts(docs).mapInArrow(trimmed(counted), "doc_id long, n long, terms array<int>, tfs array<int>")


def classes(bags_: DataFrame, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """One row per distinct bag and m: m, terms, tfs, and members, the k smallest ids in order.

    Rows are dealt by a hash and meet only if bag and m are equal. Equal scores rank by id, so nobody needs more than k
    members; they are cut to k before rows move, so a bag that very many documents share stays small.
    """
    with_m = bags_.where(F.size("terms") > 0).withColumn("m", F.expr(f"10L + (90L * n * {n_docs}L) div {max(n_terms, 1)}L"))
    keyed = with_m.withColumn("hash", F.xxhash64("m", "terms", "tfs"))
    same = ["hash", "m", "terms", "tfs"]
    place = F.row_number().over(Window.partitionBy(*same).orderBy(F.col("doc_id").asc_nulls_last()))
    few = keyed.select(*same, "doc_id").withColumn("place", place).where(F.col("place") <= k)
    gathered = few.groupBy(*same).agg(F.sort_array(F.collect_list(F.struct("place", "doc_id"))).alias("members"))
    return gathered.select("m", "terms", "tfs", F.col("members.doc_id").alias("members"))


def _best(item: np.ndarray, score: np.ndarray, doc: np.ndarray, k: int) -> np.ndarray:
    """Indexes of the k best documents of each item, best first."""
    order = np.lexsort((doc, -score, item))
    of = item[order]
    first = np.concatenate([[True], of[1:] != of[:-1]]) if len(of) else np.zeros(0, bool)
    place = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    return order[place < k]


def _ranges(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For ranges of so many places from a first one: (number of the range, place), range by range."""
    which = np.repeat(np.arange(len(size)), size)
    return which, first[which] + np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size)


def _ranked(classes_: DataFrame, items: list[np.ndarray], weights: np.ndarray, k: int) -> DataFrame:
    """item (index), doc_id and score of candidates: every task gives its k best of each item."""
    count = len(items)
    by_term = np.argsort(term := np.concatenate([*items, np.zeros(0, np.int64)]).astype(np.int64), kind="stable")
    of_item = np.repeat(np.arange(count), [len(i) for i in items])[by_term]
    starts = np.searchsorted(term[by_term], np.arange(len(weights) + 1))

    def scored(m: np.ndarray, at: np.ndarray, terms: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        """Scores of classes by items: a class's part for a term is computed once, then added to each item with it."""
        row = np.repeat(np.arange(len(m)), np.diff(at))
        tf = tfs.astype(np.int64)
        part = weights[terms] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[row]))
        which, place = _ranges(starts[terms], starts[terms + 1] - starts[terms])
        cell, part = row[which] * count + of_item[place], part[which]
        # Two sums of halves: each is exact in a double, whatever 64-bit score they make.
        low, high = (np.bincount(cell, x, len(m) * count) for x in (part & 0xFFFFFFFF, part >> 32))
        return ((high.astype(np.int64) << 32) + low.astype(np.int64)).reshape(len(m), count)

    def candidates(m, at, terms, tfs, to, members):
        score = scored(m, at, terms, tfs)
        last = max(0, len(score) - k)
        row, item = np.nonzero((score >= np.partition(score, last, axis=0)[last]) & (score > 0))
        which, place = _ranges(to[row], to[row + 1] - to[row])
        return item[which], score[row[which], item[which]], members[place]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = tuple(np.zeros(0, np.int64) for _ in range(3))
        for b in batches:
            m, (at, to) = b.column("m").to_numpy(), (b.column(c).offsets.to_numpy().astype(np.int64) for c in ("terms", "members"))
            at, to = at - at[0], to - to[0]
            terms, tfs = (b.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
            members = b.column("members").flatten().fill_null(_NONE).to_numpy()
            adds = np.concatenate([[0], np.cumsum(starts[terms + 1] - starts[terms])])[at] + np.arange(len(at)) * count
            for i, j in blocks(adds, _CELLS):
                inside = slice(at[i], at[j])
                found = candidates(m[i:j], at[i : j + 1] - at[i], terms[inside], tfs[inside], to[i : j + 1], members)
                both = tuple(np.concatenate(x) for x in zip(best, found, strict=True))
                keep = _best(*both, k)
                best = tuple(x[keep] for x in both)
        if len(best[0]):
            item, score, doc = best
            yield pa.record_batch({"item": pa.array(item), "doc_id": pa.array(doc, mask=doc == _NONE), "score": pa.array(score)})

    return classes_.mapInArrow(trimmed(task), "item long, doc_id long, score long")


def search(docs: DataFrame, items: DataFrame, *, k: int = 10, block_items: int = 1000) -> DataFrame:
    """item_id, rank, doc_id and score of the k best documents with a score above 0 for each item.

    Items are the stated queries; they come to the driver in blocks of `block_items` and each
    block is one pass over all documents. Texts are reduced to their counts of the block's
    terms. Documents with equal counts and an equal m form a class (see classes), which is
    scored once for all items; its members follow in order of their ids. Weights need the counts of documents
    by term, which are sums combined on the map side.

    A document without text has no terms; so has an item, which then has no rows. Rows that repeat a
    document rank one behind the other; rows that repeat an item are items of their own. A document
    without an id ranks behind its equals. Negative ids are ids as any other. Empty tables give no rows.
    """
    ship(docs.sparkSession)
    texts = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    found, block = None, []
    for row in texts.toLocalIterator():
        block.append((row.item_id, terms_of(row.text)))
        if len(block) == block_items:
            found, block = _with(found, _search_block(docs, block, k)), []
    if block or found is None:
        found = _with(found, _search_block(docs, block, k))
    return found


def _with(before: DataFrame | None, more: DataFrame) -> DataFrame:
    return more if before is None else before.unionByName(more)


def _search_block(docs: DataFrame, block: list[tuple[int | None, list[str]]], k: int) -> DataFrame:
    spark = docs.sparkSession
    vocabulary = sorted({t for _, terms in block for t in terms})
    if not vocabulary:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    index = {t: i for i, t in enumerate(vocabulary)}
    counts = staged(bags(docs, vocabulary))
    n_docs, n_terms = counts.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict.fromkeys(range(len(vocabulary)), 0)
    df |= {r.term: r["count"] for r in counts.select(F.explode("terms").alias("term")).groupBy("term").count().collect()}
    weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[i] + 1))) for i in range(len(vocabulary))], np.int64)
    wanted = [np.array(sorted({index[t] for t in terms}), np.int64) for _, terms in block]
    ranked = _ranked(classes(counts, n_docs, n_terms, k), wanted, weights, k)
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    best = ranked.withColumn("rank", place).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, item) for i, (item, _) in enumerate(block)], "item long, item_id long")
    return best.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")  # a block's items, no more
