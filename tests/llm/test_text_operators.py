"""Packing, passages, similarity groups, tokens: against brute force over whole texts."""

import hashlib
import itertools
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallybook.llm import bpe, jaccard, packing, substrings
from tallybook.llm.tokens import default_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


def ids_of(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids


def packed_bytes(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def check_packing(tokenizer, texts, rows):
    pieces = defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
    expected = defaultdict(list)
    for name, text in texts:
        expected[name].append([*ids_of(tokenizer, text), 0])
    assert set(pieces) == set(expected)
    for name, wanted in expected.items():
        got = sorted(pieces[name], key=lambda r: (r.start, r.sequence_id))
        if len(wanted) > 1:  # repeated rows: every piece comes as often as its row
            assert len(got) % len(wanted) == 0 and sum(r.length for r in got) == sum(map(len, wanted))
            continue
        assert [r.start for r in got] == list(itertools.accumulate([0] + [r.length for r in got]))[:-1]
        for r in got:
            own = wanted[0][r.start : r.start + r.length]
            assert zlib.crc32(packed_bytes(own)) == r.ids_crc32 and r.doc_tokens == len(wanted[0])
        assert sum(r.length for r in got) == len(wanted[0])
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (r.sequence_id, r.offset)), lambda r: r.sequence_id):
        at = 0
        for r in group:
            assert r.offset == at
            at += r.length
        assert at <= 1024


def test_packing(tokenizer, docs, texts, no_docs):
    check_packing(tokenizer, texts, packing.pack(docs).collect())
    assert packing.pack(no_docs).isEmpty()


def test_packing_of_the_table(spark, tokenizer):
    rows = packing.pack(spark.read.parquet(f"{SMALL}/documents.parquet")).collect()
    check_packing(tokenizer, [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()], rows)
    padding = sum({r.sequence_id: r.padding for r in rows}.values())
    assert padding <= 0.03 * sum(r.length for r in rows)


def test_cuts_are_the_cheapest():
    rng = np.random.default_rng(0)
    for _ in range(50):
        ends = np.cumsum(rng.integers(1, 9, 12))
        price = rng.integers(0, 4, 12)
        window, least = 16, 2

        def cost(chosen, ends=ends, price=price):
            total, before = 0, 0
            for i in chosen:
                n = int(ends[i]) - before
                if n > window:
                    return 10**9
                power = n & (n - 1) == 0 and n >= least
                total += int(price[i]) + (0 if power else window - n)
                before = int(ends[i])
            return total

        best = min(cost([*c, 11]) for k in range(12) for c in itertools.combinations(range(11), k))
        got = packing.cuts(ends, price, window, least)
        assert cost([list(ends).index(g) for g in got]) == best


def removed_by_brute_force(texts, size=35):
    split = [WORD.findall(t or "") for _, t in texts]
    count = Counter(tuple(w[i : i + size]) for w in split for i in range(len(w) - size + 1))
    out = []
    for (name, _), w in zip(texts, split, strict=True):
        gone = bytearray(len(w))
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = b"\1" * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((name, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


def test_repeated_passages(docs, texts, no_docs):
    assert rows_of(substrings.digests(substrings.removals(docs))) == removed_by_brute_force(texts)
    assert substrings.digests(substrings.removals(no_docs)).isEmpty()


def test_repeated_passages_of_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in table.collect()]
    assert rows_of(substrings.digests(substrings.removals(table))) == removed_by_brute_force(texts)


def test_fm_index_counts_every_pattern():
    rng = np.random.default_rng(1)
    segments = [rng.integers(2, 5, rng.integers(3, 30)) for _ in range(40)]
    weights = rng.integers(1, 4, 40)
    symbols = np.concatenate([np.append(s, 0) for s in segments])
    index = substrings.FMIndex(symbols, np.concatenate([np.append(np.full(len(s), w), 0) for s, w in zip(segments, weights, strict=True)]))
    for _ in range(300):
        pattern = rng.integers(2, 5, rng.integers(1, 6))
        low, high = index.first(pattern[-1:])
        for c in pattern[-2::-1]:
            low, high = index.extend(np.array([c]), low, high)
        text = lambda s: "".join(map(str, s))
        wanted = sum(w * sum(text(s).startswith(text(pattern), i) for i in range(len(s))) for s, w in zip(segments, weights, strict=True))
        assert index.weight(low, np.maximum(low, high))[0] == wanted


def groups_by_brute_force(texts):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for _, t in texts:
        w = WORD.findall((t or "").translate(lower))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    name = [i for i, _ in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i in range(len(texts)):
        if name[i] is not None:
            least[root(i)] = min(name[i], least.get(root(i), name[i]))
    return sorted(((name[i], len(sets[i]), least.get(root(i))) for i in range(len(texts))), key=repr)


def test_groups(docs, texts, no_docs):
    assert rows_of(jaccard.groups(docs)) == groups_by_brute_force(texts)
    assert jaccard.groups(no_docs).isEmpty()


def test_groups_of_the_table(spark):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert rows_of(jaccard.groups(table)) == groups_by_brute_force([(r.doc_id, r.text) for r in table.collect()])


def test_groups_of_many_small_sets(spark):
    """Sets of one to twelve shingles on both sides of the boundary, with many near copies."""
    import random

    rng = random.Random(5)
    texts = []
    for i in range(120):
        w = [f"w{rng.randrange(3)}{k}" for k in range(rng.randrange(1, 16))]
        texts.append((i, " ".join(w)))
    assert rows_of(jaccard.groups(spark.createDataFrame(texts, "doc_id long, text string"))) == groups_by_brute_force(texts)


def test_boundary_follows_cost():
    assert jaccard.boundary([], 75) == 0
    assert jaccard.boundary([(6, 1000)], 75) >= 6
    assert jaccard.boundary([(120, 1000)], 75) < 120


def tokens_by_tokenizer(tokenizer, texts):
    out = []
    for name, text in texts:
        ids = ids_of(tokenizer, text)
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        out.append((name, len(ids), hashlib.sha256(packed_bytes(ids)).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()))
    return sorted(out, key=repr)


def test_tokens(tokenizer, docs, texts, no_docs):
    assert rows_of(bpe.digests(bpe.encode(docs))) == tokens_by_tokenizer(tokenizer, texts)
    assert bpe.digests(bpe.encode(no_docs)).isEmpty()


@pytest.mark.parametrize("bits", [3, 8])
def test_tokens_of_the_table(spark, tokenizer, bits):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    wanted = tokens_by_tokenizer(tokenizer, [(r.doc_id, r.text) for r in table.collect()])
    assert rows_of(bpe.digests(bpe.encode(table, bits=bits))) == wanted


def test_a_long_run_takes_the_other_library():
    from tallybook.llm.tokens import coder

    text = " " * 600_000 + "x"
    code = coder(default_path())
    assert code.ids(text).tolist() == code.exact.encode(text, add_special_tokens=False).ids
