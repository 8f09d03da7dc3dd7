"""The pipeline: every stage's decisions take effect; and the entry works without the subpackage."""

import os
import subprocess
import sys

import corpus_pipeline as P
from tallybook.llm import packing, secrets
from tallybook.llm.shared import components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    names, before = [n for n, _ in P.STAGES], docs
    frames = {}
    for name, stage in P.STAGES:
        frames[name] = before = stage(spark, before, SF).cache()
        if name != names[-1]:
            assert before.dtypes == docs.dtypes
    ids = {n: [r.doc_id for r in f.select("doc_id").collect()] for n, f in frames.items()}
    clean = ids["toxicity"]
    assert sum(labels.get(i) == 1 for i in clean) <= 0.2 * sum(labels.values()) and len(clean) > 0.8 * docs.count()
    assert sum(labels.get(i) == 0 for i in clean) > 0.95 * sum(v == 0 for v in labels.values())
    groups = ids["ngram_jaccard"]
    assert len(groups) == len(set(groups)) < len(clean)
    texts = {r.doc_id: r.text for r in frames["ngram_jaccard"].collect()}
    assert len(set(texts.values())) == len(texts)
    assert sorted(ids["substring_dedup"]) == sorted(ids["secret_scans"]) == sorted(groups)
    shorter = {r.doc_id: r for r in frames["substring_dedup"].collect()}
    assert any(len(shorter[i].text) < len(texts[i]) for i in texts)
    assert all(len(r.text) == r.n_chars for r in shorter.values())
    for r in frames["secret_scans"].collect():
        assert not secrets.base_spans(r.text)
    assert set(ids["packing"]) == set(groups)


def test_run_is_the_stages(spark):
    got = P.run(spark, SF)
    assert got.columns == packing.SCHEMA.replace(" long", "").split(", ") and got.count() > 0


def test_stages_take_empty_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.isEmpty()


def test_rows_that_repeat_go(spark):
    text = "one two three four five six seven eight nine ten"
    docs = spark.createDataFrame([(1, text), (1, text), (2, text), (3, None), (None, "alone")], "doc_id long, text string")
    assert sorted((r.doc_id or 0 for r in P.keep_one_of_each_group(spark, docs, SF).collect())) == [0, 1, 3]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(500, 300), (300, 400), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(201)} | {300: 300, 400: 300, 500: 300}


def test_entry_without_the_subpackage(tmp_path):
    root = os.path.dirname(os.path.abspath(P.__file__))
    code = (
        "import sys; sys.modules['tallybook.llm'] = None; import __spark_entry__ as e;"
        "assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline'] and e.oracle_sql()"
    )
    assert subprocess.run([sys.executable, "-c", code], cwd=root, timeout=120).returncode == 0


def test_every_query_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert {n.split("_")[0] for n in names if n.startswith("op")} >= {f"op{i}" for i in range(1, 14)} and "pipeline" in names
