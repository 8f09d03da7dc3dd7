"""Hard negatives against brute force over every pair, in Python's integers."""

import math
import random

import numpy as np
import pytest

from tallybook.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row int, dim string, x int, bands string, side int, shard int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, label, 1, "d", 2, "b", 3, 4) for i, v, label in rows], SCHEMA).repartition(3)


def brute(rows, every):
    good = [
        (i, label, [math.floor(256 * float(np.float32(c))) for c in v])
        for i, v, label in rows
        if i is not None and label is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)
    ]
    out = []
    for i, label, x in good:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(x, y, strict=True)), j, other == label) for j, other, y in good if j != i and len(x) == len(y))
        for p, pid, _ in [s for s in scored if s[2]][:5]:
            fit = [s for s in scored if not s[2] and -30 * p <= -100 * s[0] <= -90 * p][:10]
            out += [(i, pid, r, j, -p, -s) for r, (s, j, _) in enumerate(fit, 1)]
    return sorted(out)


def make(n, dim, seed=0, scale=0.3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dim)) * scale
    return [(i, [float(np.float32(c)) for c in centres[i % 6] + rng.normal(size=dim) * scale], int(rng.integers(0, 4))) for i in range(n)]


ODD = [(900, None, 1), (910, [], 1), (920, [], 2), (911, [], 1), (930, [float("nan")] * 8, 1), (940, [None] * 8, 1), (950, [0.5] * 8, None), (None, [0.5] * 8, 1), (960, [0.0] * 8, 1), (970, [1.0, -2.0], 1), (971, [2.0, -1.0], 1), (972, [1.0, -1.0], 3)]


@pytest.mark.parametrize("shard_rows", [37, 8192])
def test_all_pairs(spark, shard_rows):
    rows = make(300, 8) + ODD
    rows += [(1000 + i, rows[3][1], 1 + i % 2) for i in range(60)] + [(20, rows[7][1], 2), (20, rows[8][1], 3)]
    found = negatives.hard_negatives(table(spark, rows), every=10, shard_rows=shard_rows)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 10)


def test_wide_components(spark):
    rows = [(i, [c * 3e6 for c in v], label) for i, v, label in make(60, 5, 3)] + make(60, 5, 4)[30:]
    found = negatives.hard_negatives(table(spark, rows), every=10)
    assert sorted(tuple(r) for r in found.collect()) == brute(rows, 10) != []


def test_empty(spark):
    assert negatives.hard_negatives(table(spark, []).limit(0)).isEmpty()
    assert negatives.hard_negatives(table(spark, [(100, [1.0], 1)])).isEmpty()


@pytest.mark.parametrize("size", [1, 100, 2**20, 2**29, 2**33, 2**60])
def test_fields_never_meet(size):
    rng = random.Random(size)
    pick = lambda: rng.choice([-size, size, 0, rng.randrange(-size, size + 1)])
    kind = np.int64 if size < 2**50 else object
    x = np.array([[pick() for _ in range(7)] for _ in range(40)], kind)
    packed = negatives.Packed(x, size)
    for _ in range(20):
        a = [pick() for _ in range(7)]
        wanted = [sum(p * q for p, q in zip(a, row, strict=True)) for row in x.tolist()]
        assert [int(s) for s in packed.products(np.array(a, kind))] == wanted
    assert packed.width in (4, 8) or size > 2**27
