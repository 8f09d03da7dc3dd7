"""Nearest neighbours and near copies of vectors against brute force."""

import math

import numpy as np
import pytest

from tallybook.llm import vectors

SCHEMA = "vec_id long, embedding array<float>, label int, dim string, id int, weight int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "d", 1, 2) for i, v in rows], SCHEMA)


def clustered(n, dim=24, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(max(1, n // 12), dim))
    x = centres[rng.integers(0, len(centres), n)] + rng.normal(size=(n, dim)) * rng.choice([0.02, 0.25, 1.0], n)[:, None]
    return x.astype(np.float32)


ODD = [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [None] + [1.0] * 23), (905, [float("inf")] * 24), (906, [1.0, 2.0]), (907, [2.0, 4.0])]


def links_of(rows, cosine):
    """Links and component of every id; ids must differ."""
    names = [i for i, _ in rows]
    link = {i: set() for i in names}
    good = [(i, np.array(v, np.float64)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    for a, (i, u) in enumerate(good):
        for j, v in good[:a]:
            if len(u) == len(v) and u @ v / math.sqrt((u @ u) * (v @ v)) >= cosine:
                link[i].add(j)
                link[j].add(i)
    component = {i: i for i in names}
    for i in sorted(names):
        if component[i] == i:
            stack = [i]
            while stack:
                for k in link[stack.pop()]:
                    if component[k] > i:
                        component[k] = i
                        stack.append(k)
    return sorted((i, len(link[i]), component[i], component[i] == i) for i in names)


@pytest.mark.parametrize("block_rows", [40, 8192])
def test_near_copies(spark, block_rows):
    x = clustered(400)
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + ODD
    rows += [(1000 + i, rows[3][1]) for i in range(60)] + [(1100, [10 * c for c in rows[3][1]])]
    got = sorted(tuple(r) for r in vectors.near_copies(table(spark, rows), block_rows=block_rows).collect())
    wanted = links_of([(i, v and [c if c is None else float(np.float32(c)) for c in v]) for i, v in rows], 0.95)
    found = sum(g[1] for g in got) / sum(w[1] for w in wanted)
    assert [g[0] for g in got] == [w[0] for w in wanted] and found >= 0.97
    assert all(g[1] <= w[1] for g, w in zip(got, wanted, strict=True))
    assert sum(g[2] == w[2] for g, w in zip(got, wanted, strict=True)) >= 0.97 * len(wanted)


def test_near_copies_of_odd_tables(spark):
    empty = table(spark, []).limit(0)
    assert vectors.near_copies(empty).isEmpty() and vectors.nearest(empty).isEmpty()
    got = {r.vec_id: tuple(r)[1:] for r in vectors.near_copies(table(spark, ODD)).collect()}
    assert got == {i: (1, 906, i == 906) if i in (906, 907) else (0, i, True) for i, _ in ODD}
    twice = sorted(tuple(r) for r in vectors.near_copies(table(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.01])])).collect())
    assert twice == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]


def test_calibrated_count_keeps_the_recall():
    rng = np.random.default_rng(6)
    width, need = vectors.calibrated(0.95, 64, 16, 0.99)
    u = rng.normal(size=(2000, 64))
    u /= np.linalg.norm(u, axis=1)[:, None]
    w = rng.normal(size=u.shape)
    w -= (w * u).sum(1)[:, None] * u
    w /= np.linalg.norm(w, axis=1)[:, None]
    v = 0.95 * u + math.sqrt(1 - 0.95**2) * w
    d = vectors.directions_of(64, 16)
    assert ((np.abs((u - v) @ d.T) <= width).sum(1) >= need).mean() > 0.98


@pytest.mark.parametrize("shard_rows", [150, 8192])
def test_nearest(spark, shard_rows):
    x = clustered(600, seed=1) * np.linspace(0.5, 3, 600)[:, None]
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)] + ODD
    rows += [(2000 + i, rows[40][1]) for i in range(30)]  # ties
    got = {}
    for r in vectors.nearest(table(spark, rows), shard_rows=shard_rows, least=60).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    good = [(i, np.array(v)) for i, v in rows if v and len(v) == 24 and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    ids, m = np.array([i for i, _ in good]), np.stack([v for _, v in good])
    hits = total = 0
    for q in [i for i in ids if i % 20 == 0]:
        score = m @ m[list(ids).index(q)]
        order = [k for k in np.lexsort((ids, -score)) if ids[k] != q][:20]
        mine = sorted(got[q])
        assert [r for r, _, _ in mine] == list(range(1, 21))
        keys = [(-round(s, 9), i) for _, i, s in mine]
        assert keys == sorted(keys)
        assert all(abs(s - score[list(ids).index(i)]) < 1e-9 for _, i, s in mine)
        hits += len({ids[k] for k in order} & {i for _, i, _ in mine})
        total += 20
    assert set(got) == {i for i in ids if i % 20 == 0} and hits / total >= 0.9


def test_few_candidates(spark):
    got = vectors.nearest(table(spark, [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, -0.5]), (20, [float("nan"), 1.0])]))
    assert [tuple(r) for r in got.orderBy("rank").collect()] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]


def test_rows_that_repeat_an_id_link_by_their_own_vectors(spark):
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 0.01]), (3, [0.01, 1.0]), (1, [1.0, 0.0])]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in vectors.near_copies(table(spark, rows)).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 1, 1)]


def test_equal_vectors_rank_by_id(spark):
    rows = [(20 * i, [float(c) for c in v]) for i, v in enumerate(clustered(40, dim=64))]
    rows += [(1000 + i, rows[0][1]) for i in range(30)]
    found = [r for r in vectors.nearest(table(spark, rows)).collect() if r.query_id == 0]
    ranked = [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)]
    same = [i for i, s in ranked if s == ranked[0][1]]
    assert same == sorted(same) and len(ranked) == 20
