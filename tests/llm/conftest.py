"""Documents with everything that may go wrong, and brute force to hold the operators against."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, rest string, anchor int, n double, like string"


def words(rng, n):
    return [rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi".split()) + str(rng.randrange(400)) for _ in range(n)]


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text); nulls, empty and long texts, copies, near copies, shared passages, repeated rows."""
    rng = random.Random(3)
    base, passage = words(rng, 120), " ".join(words(rng, 50))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "One"), (6, "a b c d"), (7, "A b C d"), (8, "a b c")]
    rows += [(10 + i, " ".join(base[:i * 12] + ["edit%d" % i] + base[i * 12 + 1 :])) for i in range(8)]
    rows += [(20 + i, " ".join(words(rng, 30)) + "\n" + passage + "  " + " ".join(words(rng, 25))) for i in range(5)]
    rows += [(30, "una " * 35), (31, "dos " * 60), (32, "　wide space tres " * 12)]
    rows += [(40, " ".join(words(rng, 20_000))), (41, "x" * 60_000), (42, "é<|endoftext|>!? don't  \n\n  stop   ")]
    rows += [(43, " ".join(base)), (43, " ".join(base)), (44, " ".join(base)), (None, "no id at all here now"), (50, passage), (51, passage.upper())]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "src", len(t or ""), "k", "r", 7, 1.5, "x") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
