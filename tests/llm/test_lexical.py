"""Ranked search against brute force over every document."""

import math
import random
from collections import Counter

import pytest

from tallybook.llm import lexical


def brute(docs, items, k=10):
    rows = [(i, lexical.terms_of(t)) for i, t in docs]
    n_docs, total = sum(bool(t) for _, t in rows), sum(len(t) for _, t in rows)
    df = Counter(t for _, terms in rows for t in set(terms))
    out = []
    for item, text in items:
        wanted, ranked = set(lexical.terms_of(text)), []
        for i, terms in rows:
            if not terms:
                continue
            tf, m = Counter(terms), 100 - 90 + (90 * len(terms) * n_docs) // total
            score = 0
            for t in wanted:
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1000000000 * tf[t]) // (1000 * tf[t] + 8 * m))
            if score > 0:
                ranked.append((-score, i is None, i or 0, i))
        out += [(item, rank, r[3], -r[0]) for rank, r in enumerate(sorted(ranked)[:k], 1)]
    return sorted(out, key=repr)


def rows_of(frame):
    return sorted((tuple(r) for r in frame.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


ITEMS = [(1, "alpha1 beta2 É-zeta9"), (2, None), (3, " ,;"), (4, "uno UNO una"), (5, "alpha1"), (5, "beta2"), (6, "missing words"), (-7, "base x"), (8, "stop don t")]


@pytest.fixture(scope="module")
def items(spark):
    rows = [(i, t, 1, 2.0, "z", 3) for i, t in ITEMS]
    return spark.createDataFrame(rows, "item_id long, text string, rank int, score double, term string, doc_id int")


def more(texts):
    rng = random.Random(9)
    few = [("alpha1 beta2 " + " ".join(rng.choice(["alpha1", "gamma", "ézeta9", "É"]) for _ in range(rng.randrange(1, 9)))) for _ in range(12)]
    return [*texts, *((100 + i, few[i % 12]) for i in range(80)), (-3, few[0]), (None, few[0]), (2**62, few[0]), (300, "alpha1\0beta2_alpha1")]


@pytest.mark.parametrize("block_items", [1000, 2])
def test_search(spark, texts, items, block_items):
    docs = more(texts)
    frame = spark.createDataFrame([(i, t, "en", 1, 2, "h", "m") for i, t in docs], "doc_id long, text string, lang string, n int, m int, hash string, terms string")
    found = lexical.search(frame.repartition(5), items, block_items=block_items)
    assert rows_of(found) == brute(docs, ITEMS)


def test_a_class_is_scored_once(spark):
    docs = spark.createDataFrame([(i, "hot words here") for i in range(500)] + [(1000, "other words")], "doc_id long, text string")
    counts = lexical.bags(docs.repartition(7), ["here", "hot", "words"]).cache()
    kept = {(tuple(r.terms), tuple(r.tfs)): list(r.members) for r in lexical.classes(counts, 501, 1502, 10).collect()}
    assert kept == {((0, 1, 2), (1, 1, 1)): list(range(10)), ((2,), (1,)): [1000]}


def test_empty(spark, docs, no_docs, items):
    assert lexical.search(no_docs, items).isEmpty() and lexical.search(docs, items.limit(0)).isEmpty()
    assert lexical.search(docs, items.where("text is null")).isEmpty()
