"""Toxicity, secrets and personal data: held-out accuracy, and patterns against Python's own."""

import hashlib
import math
import re

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from tallybook.llm import pii, secrets, toxicity
from tallybook.llm.queries import op4_toxicity

SF = "/root/testdata/sf0.1"


def test_toxicity_of_held_out_documents(spark):
    got = op4_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic")
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    rows = got.join(labels, "doc_id").where("held_out").toPandas()
    bad, good = rows[rows.toxic == 1], rows[rows.toxic == 0]
    auc = (bad.score.values[:, None] > good.score.values[None]).mean()
    assert auc > 0.97 and bad.predicted.mean() > 0.85 and good.predicted.mean() < 0.03
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.3) == (rows.predicted == 1)).all()


def test_toxicity_learns_nothing_from_the_held_out_fold(spark, docs):
    fold = [r.id for r in spark.range(400).where(toxicity.held_out(F.col("id"))).collect()]
    labels = spark.createDataFrame([(i, i % 2, 1) for i in fold], "doc_id long, toxic int, quality int")
    model = toxicity.fit(docs, labels)
    assert model.trees is None
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and {r.score for r in rows} == {0.0}


def test_toxicity_of_odd_tables(spark, docs, no_docs):
    text = [(i, ("you stupid trash " if i % 3 == 0 else "calm and plain words ") * 3) for i in range(120)]
    table = spark.createDataFrame(text, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)] + [(None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.fit(table, labels)
    assert toxicity.score(no_docs, model).isEmpty() and toxicity.score(docs, model).count() == docs.count()
    kept = toxicity.accepted(table.withColumn("rest", F.lit(1)), model)
    assert kept.columns == ["doc_id", "text", "rest"]
    assert {r.doc_id % 3 == 0 for r in kept.collect()} == {False}


def test_isotonic_is_monotone():
    rng = np.random.default_rng(2)
    raw = rng.normal(size=300)
    x, y = toxicity.isotonic(raw, (rng.random(300) < 1 / (1 + np.exp(-raw))).astype(float))
    assert (np.diff(x) >= 0).all() and (np.diff(y) >= -1e-12).all()


PLAIN = {
    "assign": (r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
    "access": (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
    "hex": (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
}
TEXTS = [
    None,
    "",
    'token = "abcdef" Password:12345 PASSWORD: "123456" api_key==xy/z+1 apikey\t=nothing1 ſecret=abcdefgh',
    "AKIA" + "A" * 16 + " AKIA" + "B" * 15 + " xAKIA" + "9" * 40,
    "0" * 23 + " " + "ab" * 12 + "g" + "0123456789abcdef" * 3,
    "é" * 50 + "secret = Zm9vYmFyYmF6cXV4 tail",
    "word " * 30_000 + "token:abcdef",
]


def test_secrets_by_patterns(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(2, TEXTS[2], "x")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, spans string"), None).collect()
    for r in got:
        text = TEXTS[r.doc_id] or ""
        spans = [(m.start(), k, m.end()) for k, (p, ok) in PLAIN.items() for m in re.finditer(p, text) if ok(m)]
        spans.sort(key=lambda s: (s[0], list(PLAIN).index(s[1])))
        joined = ",".join(f"{k}:{a}:{b}" for a, k, b in spans)
        assert r.spans == joined and r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[1] == k for s in spans) for k in PLAIN)
    assert len(got) == len(rows)


def test_network_finds_what_the_patterns_miss():
    rng = np.random.default_rng(4)
    key = lambda n: "".join(rng.choice(list("0123456789abcdefABCDEFGHXYZ"), n))
    word = lambda: "".join(rng.choice(["th", "er", "an", "ing", "ion", "st"], 9))
    windows, y = [], []
    for i in range(600):
        text = f"some words here {key(24) if i % 2 else word()} and more"
        start = text.index("here ") + 5
        windows += secrets.windows(text, start, text.index(" and"))
        y.append(i % 2)
    net = secrets.train(secrets.encode(windows), np.array(y, float))
    assert ((net.chance(secrets.encode(windows)) >= net.threshold) == np.array(y)).mean() > 0.97
    text = "x " + key(30) + " y"
    assert [s[0] for s in secrets.spans(text, [], net)] == ["learned"]
    assert secrets.redact(text, secrets.spans(text, [], net)) == "x [secret] y"


def test_candidates_know_every_span_over_them():
    text = "password=" + "k" * 24 + "." + ".".join("0123456789abcdef01234567" for _ in range(6)) + " and " + "Zm9vYmFyYmF6cXV4" + " end"
    base = secrets.base_spans(text)
    found = list(secrets.candidates(text, base))
    assert found[0] == (0, 33, True)
    for start, end, hit in found:
        assert hit == any(a < end and b > start for _, a, b in base)
    assert [hit for _, _, hit in found] == [True] * 7 + [False]


def test_long_candidates_are_seen_whole():
    text = "x " + "ab" * 100 + "Q9" + " y"
    seen = secrets.windows(text, 2, 204)
    inner = [w[secrets.BEFORE : secrets.BEFORE + secrets.INSIDE] for w in seen]
    assert "".join(inner[:-1]) + inner[-1][-2:] == text[2:204] and inner[-1].endswith("Q9") and len({len(w) for w in seen}) == 1
    assert secrets.windows("k" * 16, 0, 16) == ["\0" * 24 + "k" * 16 + "\0" * 24 + "\0" * 8]


def test_recall_is_kept_or_the_network_refused():
    rng = np.random.default_rng(2)
    noise = secrets.encode(["".join(rng.choice(list("abcdef"), secrets.WIDTH)) for _ in range(400)])
    net = secrets.train(noise, rng.integers(0, 2, 400).astype(float))
    assert net.recall in (0.0, None) or (net.recall >= 0.98 and net.threshold >= 0.5)


def test_secrets_keep_documents(spark, docs, no_docs):
    net = secrets.fit(spark.read.parquet(f"{SF}/documents.parquet"))
    assert net is not None
    assert secrets.cleaned(docs, net).count() == docs.count() and secrets.cleaned(docs, net).schema.names == docs.schema.names
    assert secrets.fit(no_docs) is None and secrets.scan(no_docs, None).isEmpty()
    table = spark.read.parquet(f"{SF}/documents.parquet")
    added = secrets.scan(table, net).where("spans like '%learned%'").count()
    assert added < 0.002 * table.count()


PERSONAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def fine(kind, match):
    d = re.sub("[^0-9]", "", match)
    return {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in match.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


CASES = [
    None,
    "",
    "a.b%c@x.y.z. a@b c@d.e_f@g.h @x.y a@@b.c é@é.fr x@y.z@q.r a@b.c-@d.e",
    "1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 001.02.3.255 9.9.9 1..2.3.4 12345678901.1.1.1",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111 4012888888881881 1234 5678",
    "+1 (415) 555-2671 +1 +12 3 +44 20 7946 0958. +123456789012345678 +1(2)3-4.5 6 7 8 9 0",
    "é" * 40 + " me@site.org 10.0.0.1",
    "a" * 50_000 + " " + "1" * 50_000 + "." + "x." * 20_000 + "@b" + ".c" * 20_000,
]


def test_personal_data_by_patterns(spark, no_docs):
    rows = [(i, t, "v") for i, t in enumerate(CASES)] + [(3, CASES[3], "v"), (None, CASES[3], "v")]
    got = pii.scan(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()
    assert len(got) == len(rows)
    for r in got:
        text = CASES[3 if r.doc_id is None else r.doc_id] or ""
        spans = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PERSONAL.items()) for m in re.finditer(p, text) if fine(k, m[0])]
        joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text[:50]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[3] == k for s in spans) for k in PERSONAL)
    assert pii.scan(no_docs).isEmpty()


@pytest.fixture(scope="module")
def revealing(spark):
    rows = [(i, f"filler{i} projectzebra boss{i % 2}@firm.example signed{i} today") for i in range(6)]
    rows += [(100 + i, f"common words about nothing number{i} today") for i in range(600)]
    rows += [(1400 + i, f"other writers{i} wrote someone{i}@else.example today words") for i in range(40)]
    rows += [(1500 + i, "copied onlyonce copy@firm.example passage") for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_revealing_terms_become_spans(spark, revealing):
    found = pii.scan(revealing)
    by = {r.doc_id: r.spans for r in found.collect()}
    assert all("term:" in by[i] for i in range(6))
    assert not any("term:" in by[i] for i in by if i >= 100)  # common terms, unique ones, and copies of one passage
    clean = {r.doc_id: r.text for r in pii.sanitised(revealing, found).collect()}
    assert clean[0] == "filler0 [term] [email] signed0 today" and clean[100] == "common words about nothing number0 today"


def test_personal_data_runs_no_python(spark, revealing):
    plan = pii.scan(revealing)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|CartesianProduct", plan)


def test_many_matches_in_one_text(spark):
    text = " ".join(f"writer{i} mails someone{i}@host{i % 50}.example about +1 (555) 010-{i:05d} today" for i in range(3000))
    table = spark.createDataFrame([(1, text), (2, "")], "doc_id long, text string")
    found = pii.scan(table)
    got = {r.doc_id: r for r in found.collect()}
    spans = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PERSONAL.items()) for m in re.finditer(p, text) if fine(k, m[0])]
    joined = ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))
    assert got[1].base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and got[1].n_email == got[1].n_phone == 3000
    out, at = [], 0
    for s in sorted(got[1]["all"]):
        if s.start >= at:
            out.append(text[at : s.start] + f"[{pii.KINDS[s.kind]}]")
        at = max(at, s.end)
    clean = {r.doc_id: r.text for r in pii.sanitised(table, found).collect()}
    assert clean == {1: "".join(out) + text[at:], 2: ""}


@pytest.mark.parametrize("source", ["made", "given"])
def test_revealing_terms_against_brute_force(spark, revealing, source):
    table = revealing if source == "made" else spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    table = table.select("doc_id", "text")
    support, share, bits, reach = 2, 0.5, 6.0 if source == "made" else 3.0, 80
    got = {r.doc_id: r for r in pii.scan(table, bits=bits).collect()}
    texts = {r.doc_id: r.text or "" for r in table.collect()}
    term = regex.compile(pii.TERM)
    base, near = {}, []
    for i, text in texts.items():
        base[i] = [(m.start(), m.end(), m[0]) for k, p in PERSONAL.items() for m in re.finditer(p, text) if fine(k, m[0])]
        for a, b, entity in base[i]:
            low, left, right = max(a - reach, 0), text[max(a - reach, 0) : a], text[b : b + reach]
            left = regex.sub(r"^[\p{L}\p{N}_-]+", "", left) if low else left
            right = regex.sub(r"[\p{L}\p{N}_-]+$", "", right) if len(right) == reach else right
            found = [(a - len(left) + m.start(), a - len(left) + m.end(), m[0].lower()) for m in term.finditer(left)]
            found += [(b + m.start(), b + m.end(), m[0].lower()) for m in term.finditer(right)]
            near += [(i, entity, tuple(w for _, _, w in found), t) for t in found]
    docs_of, entity_docs, term_docs = {}, {}, {}
    for i, entity, context, t in near:
        docs_of.setdefault((entity, t[2]), {}).setdefault(context, set()).add(i)
        entity_docs.setdefault(entity, set()).add(i)
    for text in texts.values():
        for w in {m[0] for m in term.finditer(text.lower())}:
            term_docs[w] = term_docs.get(w, 0) + 1
    revealed = set()
    for (entity, word), by in docs_of.items():
        given = min(sum(map(len, by.values())) / term_docs.get(word, math.inf), 1)
        apart = len({min(got[i].key for i in group) for group in by.values()})
        if apart >= support and given >= share and math.log2(given * len(texts) / len(entity_docs[entity])) >= bits:
            revealed.add((entity, word))
    wanted = {i: set() for i in texts}
    for i, entity, _, (a, b, word) in near:
        if (entity, word) in revealed and not any(a < e and s < b for s, e, _ in base[i]):
            wanted[i].add((a, b))
    assert {i: {(s.start, s.end) for s in r["all"] if pii.KINDS[s.kind] == "term"} for i, r in got.items()} == wanted
    assert revealed or source == "given"


def test_network_learns_from_every_window(spark, monkeypatch):
    """No part of the labelled windows is left out, however many there are, and shards learn together."""
    rng = np.random.default_rng(8)
    key = lambda: "".join(rng.choice(list("0123456789abcdefABCDEFGHXYZ"), 24))
    word = lambda: "".join(rng.choice(["th", "er", "an", "ing", "ion", "st"], 9))
    texts = [f"has password={key()} and" for _ in range(300)] + [f"has only {word()} and" for _ in range(900)]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen = []
    collect = type(table).collect

    def counted(frame):
        rows = collect(frame)
        if frame.columns == ["shard", "n", "state"]:
            seen.append((len(rows), sum(r["n"] for r in rows)))
        return rows

    monkeypatch.setattr(type(table), "collect", counted)
    net = secrets.fit(table, shard=200)
    distinct = {w for t in texts for a, b, _ in secrets.candidates(t, secrets.base_spans(t)) for w in secrets.windows(t, a, b)}
    assert len(seen) == 8 and len(set(seen)) == 1 and seen[0][0] > 2
    assert 0.65 * len(distinct) < seen[0][1] < 0.85 * len(distinct)
    assert net.recall >= 0.98 and net.threshold >= 0.5
    again = secrets.fit(table.repartition(5), shard=200)
    assert (again.threshold, again.line) == (net.threshold, net.line)
