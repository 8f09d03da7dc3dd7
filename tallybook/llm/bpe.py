"""BPE encoding and decoding with reuse of content-defined chunks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BLOCK, _byte_values, _powers, blocks, doc_texts, mix, slices, text_bytes
from .tokens import coder, default_path

def cores(data: np.ndarray, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, start, stop and hash of the core of every chunk of the rows' bytes.

    A chunk ends where a rolling hash of the last 16 bytes has `bits` zero bits, and at a row's end, so
    equal passages get equal chunks wherever they stand. Its core reaches from its first to its last
    place at which the tokenizer always splits: before a single space between two printable ASCII
    characters, and at a row's ends. What lies between two cores is the join to be repaired.
    """
    none = np.zeros(0, np.int64)
    n = len(data)
    if n == 0:
        return none, none, none, np.zeros(0, np.uint64)
    gear = (_byte_values()[data] >> np.uint64(32)).astype(np.uint32)
    for width in (1, 2, 4, 8):
        shifted = gear << np.uint32(width)
        gear = gear.copy()
        gear[width:] += shifted[:-width]
    cut = np.flatnonzero((gear >> np.uint32(32 - bits)) == 0) + 1
    bounds = np.union1d(cut, at)
    print_ = (data > 32) & (data < 127)
    safe = np.zeros(n + 1, bool)
    safe[1 : n - 1] = (data[1:-1] == 32) & print_[:-2] & print_[2:]
    safe[at] = True
    safe = np.flatnonzero(safe)
    first = np.searchsorted(safe, bounds[:-1], "left")
    last = np.searchsorted(safe, bounds[1:], "right") - 1
    some = last > first
    start, stop = safe[np.minimum(first[some], len(safe) - 1)], safe[last[some]]
    powers, inverse = _powers(n.bit_length())
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_byte_values()[data] * powers[:n], out=total[1:])
    row = np.searchsorted(at, start, "right") - 1
    return row, start, stop, mix((total[stop] - total[start]) * inverse[start])


def encode(docs: DataFrame, *, path: str | None = None, bits: int = 8) -> DataFrame:
    """doc_id, ids (unsigned 32-bit, little-endian, as binary) and decoded (their text) of every row.

    Texts are dealt so that those with the same smallest line hash, that is mostly copies of each other,
    come to one task; a partition that grows too large is split. A task lists the chunks of its texts,
    encodes the core of a chunk that occurs more than once when it first needs it and reuses the ids, and
    encodes the rest of each text: what is its own, and the joins between cores. The ids are then decoded;
    where the result is not the text (two chunks with one hash), the whole text is encoded anew. So the
    ids are those of encoding whole texts, however the rows are dealt.

    Null text is empty and has no ids; repeated rows are kept; an empty table gives none. Memory: one
    batch of texts, 8 bytes a chunk, and the ids of repeated chunks.
    """
    path = path or default_path()
    rows = doc_texts(docs).withColumn("like", F.array_min(F.transform(F.split("text", "\n"), lambda line: F.xxhash64(line))))

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(path)
        before = np.zeros(0, np.uint64)
        made: dict[int, np.ndarray] = {}
        for batch in batches:
            data, at = text_bytes(batch.column("text"))
            parts = [cores(data[at[i] : at[j]], at[i : j + 1] - at[i], bits) for i, j in blocks(at)]
            first = [i for i, _ in blocks(at)]
            row = np.concatenate([np.zeros(0, np.int64), *(p[0] + i for p, i in zip(parts, first, strict=True))])
            start = np.concatenate([np.zeros(0, np.int64), *(p[1] + at[i] for p, i in zip(parts, first, strict=True))])
            stop = np.concatenate([np.zeros(0, np.int64), *(p[2] + at[i] for p, i in zip(parts, first, strict=True))])
            chunk = np.concatenate([np.zeros(0, np.uint64), *(p[3] for p in parts)])
            known, which, count = np.unique(chunk, return_inverse=True, return_counts=True)
            again = ((count > 1) | np.isin(known, before))[which]
            before = np.union1d(before, known)
            row, start, stop, chunk = row[again], start[again], stop[again], chunk[again]
            edge = np.searchsorted(row, np.arange(batch.num_rows + 1))
            begin = 0
            for b in slices(batch, "text", BLOCK):
                ids, texts = [], []
                for i in range(begin, begin + b.num_rows):
                    own = slice(edge[i], edge[i + 1])
                    spans = zip((start[own] - at[i]).tolist(), (stop[own] - at[i]).tolist(), chunk[own].tolist(), strict=True)
                    found, text = repaired(code, data[at[i] : at[i + 1]].tobytes(), spans, made)
                    ids.append(found.tobytes())
                    texts.append(text)
                begin += b.num_rows
                yield pa.record_batch({"doc_id": b.column("doc_id"), "ids": pa.array(ids, pa.binary()), "decoded": pa.array(texts, pa.string())})

    return rows.hint("rebalance", "like").select("doc_id", "text").mapInArrow(encoded, "doc_id long, ids binary, decoded string")


def repaired(code, data: bytes, spans: Iterable[tuple[int, int, int]], made: dict[int, np.ndarray]) -> tuple[np.ndarray, str]:
    """Ids of a text and the text they decode to. spans: start, stop and hash of its repeated cores in
    order; made: ids by hash, completed here. Everything between cores is encoded in place."""
    out, at = [], 0
    for start, stop, chunk in spans:
        if start > at:
            out.append(code.ids(data[at:start].decode("utf-8", "replace")))
        if chunk not in made:
            made[chunk] = code.ids(data[start:stop].decode("utf-8", "replace"))
        out.append(made[chunk])
        at = stop
    if at < len(data):
        out.append(code.ids(data[at:].decode("utf-8", "replace")))
    ids = np.concatenate(out).astype("<u4") if out else np.zeros(0, "<u4")
    decoded = code.fast.decode_bytes(ids.tolist())
    if decoded != data:
        ids = code.ids(data.decode())
        decoded = code.fast.decode_bytes(ids.tolist())
    return ids, decoded.decode("utf-8", "replace")


def digests(encoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256."""
    return encoded.select(
        "doc_id",
        F.expr("octet_length(ids) div 4").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
