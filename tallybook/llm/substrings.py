"""Removal of repeated passages: FM-indexes over the contexts of shared anchors, searched backwards."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .shared import _ODD, _powers, blocks, grams, like, mix, slices, staged, text_bytes, trimmed, with_rest, words

ANCHORS = "anchor long, seg long, doc_id long, key long, pos int, left int"


class WaveletMatrix:
    """Rank of any symbol in a sequence; one packed bit vector and its counts per level."""

    def __init__(self, values: np.ndarray):
        self.n = len(values)
        self.levels = max(1, int(values.max(initial=0)).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = ((values >> level) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(128 - self.n % 64, bool)]), bitorder="little").view("<u8")
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(int(self.n - bit.sum()))
            values = np.concatenate([values[~bit], values[bit]])
        symbols = np.arange(1 << self.levels, dtype=np.int64)
        self.first = self._descend(symbols, np.zeros(len(symbols), np.int64))

    def _descend(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (packed, counts, zeros) in enumerate(zip(self.words, self.counts, self.zeros, strict=True)):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = counts[word] + np.bitwise_count(packed[word] & mask)
            at = np.where((symbols >> (self.levels - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._descend(symbols, at) - self.first[symbols]


class FMIndex:
    """Index of segments, each with a weight, for searches that add symbols on the left.

    `symbols` holds all segments one after the other, every one closed by a 0 of its own rank. Equal
    symbols must mean equal words; symbol 1 stands for words that occur once and is never matched.
    """

    def __init__(self, symbols: np.ndarray, weights: np.ndarray):
        n = len(symbols)
        ends = symbols == 0
        rank = symbols + ends.sum()
        rank[ends] = np.arange(ends.sum())
        width = 1
        while True:  # prefix doubling; a segment's own end makes its suffixes distinct
            key = rank.astype(np.int64) * (n + int(symbols.max()) + 2)
            key[:-width] += rank[width:] + 1
            order = np.argsort(key, kind="stable")
            fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
            rank = np.empty(n, np.int64)
            rank[order] = fresh
            width *= 2
            if fresh[-1] == n - 1 or width >= n:
                break
        self.matrix = WaveletMatrix(symbols[order - 1])
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(symbols))])
        self.weight_before = np.concatenate([[0], np.cumsum(weights[order])])

    def first(self, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.starts[symbol], self.starts[symbol + 1]

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.starts[symbol] + both[: len(low)], self.starts[symbol] + both[len(low) :]

    def weight(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return self.weight_before[high] - self.weight_before[low]


def repeated_windows(symbols: np.ndarray, begin: np.ndarray, end: np.ndarray, anchor: np.ndarray, index: FMIndex, size: int) -> np.ndarray:
    """For each segment symbols[begin:end] a bit per window around its anchor place: does it occur again?

    Bit o stands for the window that starts o words before the anchor. Matching statistics are found
    from the right end: a search grows to the left while the matched weight is two or more. Where it
    ends, all windows inside the match are known, and the next search starts at the last end that can
    still give a new window. All segments advance together.
    """
    masks = np.zeros(len(begin), np.int64)
    live = np.arange(len(begin))
    stop, left = end.copy(), end.copy()
    low, high = np.zeros(len(begin), np.int64), np.zeros(len(begin), np.int64)
    live = live[stop - begin >= size]
    while len(live):
        at = left[live] - 1
        inside = at >= begin[live]
        symbol = np.where(inside, symbols[np.maximum(at, 0)], 0)
        fresh = left[live] == stop[live]
        known = symbol > 1
        new_low, new_high = index.first(np.where(known, symbol, 0))
        grow = np.flatnonzero(known & ~fresh)
        if len(grow):
            new_low[grow], new_high[grow] = index.extend(symbol[grow], low[live[grow]], high[live[grow]])
        good = known & (index.weight(new_low, new_high) >= 2)
        ok = live[good]
        left[ok], low[ok], high[ok] = at[good], new_low[good], new_high[good]
        ended = live[~good]
        length = stop[ended] - left[ended]
        full = length >= size
        done = ended[full]
        # Windows that start at left .. stop - size; bits anchor - start, which are consecutive.
        high_bit = np.minimum(anchor[done] - left[done], 62)
        low_bit = np.maximum(anchor[done] - (stop[done] - size), 0)
        masks[done] |= np.where(high_bit >= low_bit, (np.int64(2) << high_bit) - (np.int64(1) << low_bit), 0)
        stop[done] = left[done] + size - 1
        stop[ended[~full]] -= 1
        left[ended] = stop[ended]
        keep = (stop[live] - begin[live] >= size) & (stop[live] > anchor[live])
        live = live[keep]
    return masks


def _slide(values: np.ndarray, width: int, better) -> np.ndarray:
    """The best of each run of `width` values, for every start."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = better(out[:-step], out[step:])
        have += step
    return out


def _anchors(data: np.ndarray, at: np.ndarray, size: int, gram: int):
    """Anchor hash, segment hash, row, word place in the row and words on the left, of every anchor.

    Of the grams in each window the smallest hashes are anchors, so equal windows have equal anchors at
    equal places. The segment is what all windows around the anchor cover.
    """
    _, _, word, before = words(data, at)
    none = np.zeros(0, np.int64)
    if len(word) < size:
        return none, none, none, none, none
    reach = size - gram
    g = grams(word, gram)
    row_of = np.repeat(np.arange(len(at) - 1), np.diff(before))
    fits = lambda n: row_of[: len(word) - n + 1] == row_of[n - 1 :]
    g = np.where(fits(gram), g, np.uint64(2**64 - 1))
    least = np.where(fits(size), _slide(g, reach + 1, np.minimum), np.uint64(0))
    padded = np.concatenate([np.zeros(reach, np.uint64), least, np.zeros(reach, np.uint64)])
    p = np.flatnonzero((_slide(padded, reach + 1, np.maximum)[: len(g)] == g) & fits(gram))
    row = row_of[p]
    first, last = np.maximum(p - reach, before[row]), np.minimum(p + size, before[row + 1])
    powers, inverse = _powers(len(word).bit_length())
    total = np.zeros(len(word) + 1, np.uint64)
    np.cumsum(word * powers[: len(word)], out=total[1:])
    seg = mix((total[last] - total[first]) * inverse[first] + (p - first).astype(np.uint64) * _ODD + (last - first).astype(np.uint64))
    return g[p].view(np.int64), seg.view(np.int64), row, p - before[row], p - first


Task = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def removals(docs: DataFrame, *, size: int = 35, gram: int = 12, shard_words: int = 400_000, then: tuple[Task, list[str]] | None = None) -> DataFrame:
    """doc_id, text, rest (the other columns as one struct), n_words, removed (a byte per word) of every
    document.

    A word is removed if a window of `size` words of one document covers it whose word sequence starts
    at another place too, in any document. 1. Anchors: the smallest gram hashes of every window, with a
    hash of the context that holds all windows around them. 2. Anchors met at two or more places stay;
    equal contexts become one segment with a weight. 3. Segments are dealt by anchor into shards of at most
    `shard_words` words (or one anchor's segments), each gets an FM-index, and every segment of weight one is
    searched backwards in its shard. Symbols hold anchor and place beside the word, so a match is another place.
    4. Every occurrence takes its segment's windows, and its document loses the words they cover.

    Null text is empty: no words. Short texts keep all. Repeated rows count as places of their own. An
    empty table gives none; other columns are ignored. `then` is a task that goes on with these rows in the same
    Python worker, and the columns it leaves.
    """
    rows = with_rest(docs).withColumn("key", F.xxhash64("doc_id", "text"))
    reach = size - gram

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, at = text_bytes(b.column("text"))
            for i, j in blocks(at):
                anchor, seg, row, pos, left = _anchors(data[at[i] : at[j]], at[i : j + 1] - at[i], size, gram)
                where = pa.array(row + i)
                yield pa.record_batch(
                    {
                        "anchor": pa.array(anchor),
                        "seg": pa.array(seg),
                        "doc_id": b.column("doc_id").take(where),
                        "key": b.column("key").take(where),
                        "pos": pa.array(pos.astype(np.int32)),
                        "left": pa.array(left.astype(np.int32)),
                    }
                )

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {k: [] for k in ("anchor", "seg", "n", "left", "words")}
            for text, parts in zip(b.column("text").to_pylist(), b.column("parts").to_pylist(), strict=True):
                raw = text.encode()
                data = np.frombuffer(raw, np.uint8)
                start, end, _, _ = words(data, np.array([0, len(data)]))
                for p in parts:
                    if p["pos"] >= len(start):
                        continue
                    first, last = p["pos"] - p["left"], min(p["pos"] + size, len(start))
                    out["words"].append(raw[start[first] : end[last - 1]])
                    for k in ("anchor", "seg", "n", "left"):
                        out[k].append(p[k])
            yield pa.record_batch({k: pa.array(v, pa.binary() if k == "words" else pa.int32() if k == "left" else pa.int64()) for k, v in out.items()})

    def searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def flush(part: pa.Table) -> pa.RecordBatch:
            part = part.combine_chunks()
            data, at = text_bytes(part["words"].cast(pa.string()))
            _, _, word, before = words(data, at)
            anchor = part["anchor"].to_numpy()
            left = part["left"].to_numpy().astype(np.int64)
            lengths = np.diff(before)
            row = np.repeat(np.arange(len(anchor)), lengths)
            place = np.arange(len(word)) - before[row] - left[row]
            symbol = mix(word ^ mix(anchor.view(np.uint64)[row] + (place + size).astype(np.uint64)))
            _, inverse, count = np.unique(symbol, return_inverse=True, return_counts=True)
            weight = part["n"].to_numpy()
            total = np.bincount(inverse, weight[row])
            code = np.where(total >= 2, np.cumsum(total >= 2) + 1, 1)
            begin = before[:-1] + np.arange(len(anchor))
            end = begin + lengths
            symbols = np.zeros(len(word) + len(anchor), np.int64)
            symbols[np.arange(len(word)) + row] = code[inverse]
            weights = np.zeros(len(symbols), np.int64)
            weights[np.arange(len(word)) + row] = weight[row]
            alone = np.flatnonzero(weight == 1)  # the others' windows occur again as they are
            masks = repeated_windows(symbols, begin[alone], end[alone], (begin + left)[alone], FMIndex(symbols, weights), size)
            keep = pa.array(alone)
            return pa.record_batch({"anchor": part["anchor"].chunk(0).take(keep), "seg": part["seg"].chunk(0).take(keep), "mask": pa.array(masks)})

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            table = pa.Table.from_batches(held)
            anchor = table["anchor"].to_numpy()
            sizes = np.cumsum(2 * size - gram + np.zeros(len(anchor), np.int64))
            new = np.flatnonzero(anchor[1:] != anchor[:-1]) + 1  # an anchor's segments stay together
            done = 0
            while sizes[-1] - (sizes[done - 1] if done else 0) > shard_words:
                limit = (sizes[done - 1] if done else 0) + shard_words
                fits = new[(new > done) & (sizes[new - 1] <= limit)]
                cut = fits[-1] if len(fits) else next(iter(new[new > done]), 0)
                if not cut:
                    break
                yield flush(table.slice(done, cut - done))
                done = cut
            held = table.slice(done).to_batches()
        if held:
            yield flush(pa.Table.from_batches(held))

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        offset = np.arange(reach + 1)
        for batch in batches:
            for b in slices(batch):
                n_words, removed = [], []
                for text, hits in zip(b.column("text").to_pylist(), b.column("hits"), strict=True):
                    n = len(text.encode().split())
                    gone = bytes(n)
                    if hits.is_valid and len(hits):
                        pos, mask = (c.to_numpy() for c in hits.values.flatten())
                        start = (pos[:, None] - offset)[(mask[:, None] >> offset) & 1 == 1]
                        start = start[(start >= 0) & (start + size <= n)]
                        change = np.bincount(start, minlength=n + 1) - np.bincount(start + size, minlength=n + 1)
                        gone = (np.cumsum(change)[:n] > 0).astype(np.uint8).tobytes()
                    n_words.append(n)
                    removed.append(gone)
                yield pa.record_batch({"doc_id": b.column("doc_id"), "text": b.column("text"), "rest": b.column("rest"), "n_words": pa.array(n_words, pa.int64()), "removed": pa.array(removed, pa.binary())})

    row = ["doc_id", "key"]
    of_anchor, of_seg = Window.partitionBy("anchor"), Window.partitionBy("anchor", "seg")
    bare = rows.select("doc_id", "text", "key")
    places = bare.mapInArrow(trimmed(listed), ANCHORS).withColumn("met", F.count("*").over(of_anchor)).where("met > 1")
    places = places.withColumn("alike", F.min("seg").over(of_anchor) == F.max("seg").over(of_anchor))
    places = places.withColumn("n", F.count("*").over(of_seg)).withColumn("turn", F.row_number().over(of_seg.orderBy("doc_id", "key", "pos")))
    places = staged(places.drop("met"))
    every_window = F.lit((1 << (reach + 1)) - 1)
    same = lambda other: [rows["doc_id"].eqNullSafe(other["doc_id"]), rows["key"] == other["key"]]
    chosen = places.where("turn = 1 and not alike").groupBy(row).agg(F.collect_list(F.struct("anchor", "seg", "n", "pos", "left")).alias("parts"))
    segments = rows.join(chosen, same(chosen)).select("text", "parts").mapInArrow(trimmed(cut_out), "anchor long, seg long, n long, left int, words binary")
    segments = segments.repartition("anchor").sortWithinPartitions("anchor", "seg")
    masks = segments.mapInArrow(trimmed(searched), "anchor long, seg long, mask long").where("mask <> 0").groupBy("anchor", "seg").agg(F.max("mask").alias("mask"))
    copied = places.where("alike or n > 1").select(*row, "pos", every_window.cast("long").alias("mask"))
    found = places.where("not alike and n = 1").join(masks, ["anchor", "seg"]).select(*row, "pos", "mask").unionByName(copied)
    hits = found.groupBy(row).agg(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), "mask")).alias("hits"))
    joined = rows.join(hits, same(hits), "left").select(rows["doc_id"], "text", "rest", "hits")
    schema = StructType([*joined.schema.fields[:3], StructField("n_words", LongType()), StructField("removed", BinaryType())])
    if then is None:
        return joined.mapInArrow(trimmed(marked), schema)
    task, left = then
    return joined.mapInArrow(trimmed(lambda batches: task(marked(batches))), StructType([schema[c] for c in left]))


def kept(text: str, removed: bytes) -> str:
    """The words that stay, joined by single spaces."""
    all_words = text.encode().split()  # bytes split at space and \x09-\x0D alone
    return b" ".join(compress(all_words, (x == 0 for x in removed)) if any(removed) else all_words).decode()


def digests(removed: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            gone = b.column("removed").to_pylist()
            yield pa.record_batch(
                {
                    "doc_id": b.column("doc_id"),
                    "n_words": b.column("n_words"),
                    "n_removed": pa.array([x.count(1) for x in gone], pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(kept(t, x).encode()).hexdigest() for t, x in zip(b.column("text").to_pylist(), gone, strict=True)], pa.string()),
                }
            )

    return removed.drop("rest").mapInArrow(trimmed(hashed), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def shortened(docs: DataFrame) -> DataFrame:
    """All documents with all their columns; texts that lose words become the kept ones, joined by spaces.
    Null text becomes empty."""

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in slices(batch):
                pairs = zip(b.column("text").to_pylist(), b.column("removed").to_pylist(), strict=True)
                texts = [kept(t, x) if 1 in x else t for t, x in pairs]
                yield pa.record_batch({"doc_id": b.column("doc_id"), "text": pa.array(texts, pa.string()), "rest": b.column("rest")})

    return like(removals(docs, then=(applied, ["doc_id", "text", "rest"])), docs)
