"""Packing of token streams into windows by order-preserving dynamic programming."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .shared import doc_texts, trimmed
from .tokens import coder, default_path

SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, padding long"
)


def cuts(ends: np.ndarray, penalties: np.ndarray, window: int, least: int) -> list[int]:
    """Which of the ascending cut places `ends` to use; the last is always used.

    Minimises padding plus penalties, where a window of n tokens is padded to `window`, or not at all
    if n is a power of two of at least `least`. The padding of an ordinary window is linear in its
    start, so the best start is the head of a monotone queue over the places within reach; the few
    powers of two are looked up. Neighbouring places must be at most `window` apart.
    """
    place = [0, *ends.tolist()]
    extra = [0, *penalties.tolist()]
    powers = [p for p in (1 << k for k in range(window.bit_length())) if least <= p < window]
    index_of = {0: 0}
    n = len(place)
    cost, came, key = [0] * n, [0] * n, [0] * n
    queue, head = [0] * n, 0
    tail = 1
    for j in range(1, n):
        b = place[j]
        reach = b - window
        while place[queue[head]] < reach:
            head += 1
        i = queue[head]
        best = key[i] + window - b
        for p in powers:
            k = index_of.get(b - p)
            if k is not None and cost[k] < best:
                best, i = cost[k], k
        best += extra[j]
        cost[j], came[j], key[j] = best, i, best + b
        index_of[b] = j
        value = best + b
        while tail > head and key[queue[tail - 1]] >= value:
            tail -= 1
        queue[tail] = j
        tail += 1
    out, j = [], n - 1
    while j:
        out.append(place[j])
        j = came[j]
    return out[::-1]


def _places(ids: list[np.ndarray], ends_sentence: np.ndarray, window: int, penalty: tuple[int, int]):
    """Cut places of a run of documents: their ends (free), ends of sentences, and forced ones."""
    stream = np.concatenate(ids)
    ends = np.cumsum([len(x) for x in ids])
    sentence = np.flatnonzero(ends_sentence[stream]) + 1
    kind = np.zeros(len(stream) + 1, np.int8)
    kind[sentence] = 1
    kind[ends] = 2
    at = np.flatnonzero(kind)
    gaps = np.diff(at, prepend=0)
    if (gaps > window).any():
        forced = [np.arange(e - g + window, e, window) for e, g in zip(at[gaps > window], gaps[gaps > window], strict=True)]
        kind[np.concatenate(forced)] = 3
        at = np.flatnonzero(kind)
    price = np.array([0, penalty[0], 0, penalty[1]])
    return stream, at, price[kind[at]]


def pack(
    docs: DataFrame,
    *,
    path: str | None = None,
    window: int = 1024,
    end_id: int = 0,
    sentence_penalty: int = 4,
    forced_penalty: int = 64,
    least_power: int = 128,
    run_tokens: int = 1 << 20,
) -> DataFrame:
    """Packs all documents, in the order they are stored, into windows of at most `window` tokens.

    Every task packs the documents of its own split, in runs of about `run_tokens` tokens, so nothing
    is shuffled and memory is bounded by a run plus one document; a window never spans two runs, and a
    task that is repeated gives the same windows. Cuts lie between documents, after a sentence, or,
    where a sentence is longer than a window, every `window` tokens. Each id lies in exactly one piece.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and
    padding (of the piece's window). Null text is empty and gives a piece with the end id alone; repeated
    doc_ids are packed one by one; a null doc_id stays null; an empty table gives no rows.
    """
    path = path or default_path()

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        ends_sentence = code.ends_sentence
        sequence = TaskContext.get().partitionId() << 40
        names: list = []
        ids: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal sequence
            stream, at, price = _places(ids, ends_sentence, window, (sentence_penalty, forced_penalty))
            cut = np.array(cuts(at, price, window, least_power))
            ends = np.cumsum([len(x) for x in ids])
            piece_ends = np.union1d(cut, ends)
            piece_starts = np.concatenate([[0], piece_ends[:-1]])
            doc = np.searchsorted(ends, piece_starts, "right")
            seq = np.searchsorted(cut, piece_starts, "right")
            lengths = np.diff(cut, prepend=0)
            plain = (lengths & (lengths - 1)) != 0
            data, four = stream.tobytes(), 4
            crc = [zlib.crc32(data[four * a : four * b]) for a, b in zip(piece_starts.tolist(), piece_ends.tolist(), strict=True)]
            doc_start = np.concatenate([[0], ends[:-1]])
            cut_start = np.concatenate([[0], cut[:-1]])
            out = pa.record_batch(
                {
                    "doc_id": pa.array(names, pa.int64()).take(pa.array(doc)),
                    "start": pa.array(piece_starts - doc_start[doc], pa.int64()),
                    "length": pa.array(piece_ends - piece_starts, pa.int64()),
                    "ids_crc32": pa.array(crc, pa.int64()),
                    "doc_tokens": pa.array(np.diff(ends, prepend=0)[doc], pa.int64()),
                    "sequence_id": pa.array(sequence + seq, pa.int64()),
                    "offset": pa.array(piece_starts - cut_start[seq], pa.int64()),
                    "padding": pa.array(np.where(plain, window - lengths, 0)[seq], pa.int64()),
                }
            )
            sequence += len(cut)
            return out

        tail = np.array([end_id], "<u4")
        for batch in batches:
            for name, text in zip(batch.column(0), batch.column(1), strict=True):
                names.append(name.as_py())
                ids.append(np.concatenate([code.ids(text.as_py() or ""), tail]))
                held += len(ids[-1])
                if held >= run_tokens:
                    yield flush()
                    names, ids, held = [], [], 0
        if names:
            yield flush()

    return doc_texts(docs).mapInArrow(trimmed(packed), SCHEMA)
