"""Scans that write their rows once give what they give without a folder, and read nothing twice."""

import time
from datetime import date
from decimal import Decimal as D

import pytest

from tallybook.plans import registry

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["scan_text_info", "scan_text_rejects", "scan_text_verifications", "qfx_transactions", "qfx_balances"])
def test_scans_derive_their_rows_once(spark, tmp_path, monkeypatch, bag, name):
    query = registry.queries()[name]
    monkeypatch.setattr(registry, "_folder", lambda star, what: None)
    lazy = bag(query(spark, FOLDER))
    monkeypatch.setattr(registry, "_folder", lambda star, what: str(tmp_path / what))
    staged = query(spark, FOLDER)
    assert not [file for file in staged.inputFiles() if "orders" in file or "lineitem" in file]
    assert bag(staged) == lazy != []


def _recorded(monkeypatch, module, seen):
    plain = module.staging

    def staging(*args, **options):
        stage = plain(*args, **options)

        def record(table, name):
            seen[name] = table
            return stage(table, name)

        return record

    monkeypatch.setattr(module, "staging", staging)


def test_lines_are_derived_once(spark, tmp_path, monkeypatch):
    """F3 to F7, F9: both what looks for quotes and what carries marks reads the staged lines."""
    from tallybook.operators import scan_text
    from tallybook.plans import books

    (tmp_path / "main.book").write_text('2024-01-01 * "a\nb"\n  Assets:A 1 USD\n2024-01-02 close Assets:A\n')
    seen = {}
    _recorded(monkeypatch, scan_text, seen)
    book = books.text_book(spark, str(tmp_path / "main.book"), folder=str(tmp_path / "stage"))
    assert book.postings.count() == book.transactions.count() == 1
    for name in ("quotes", "rows"):
        assert not [file for file in seen[name].inputFiles() if file.endswith("main.book")], name
    assert dict(seen["rows"].dtypes)["_no_mark"] == "bigint"


def test_only_values_are_staged(spark, tmp_path, monkeypatch):
    """F8: of the tags that hold no value, only a chunk's last row is written."""
    from tallybook.operators import scan_qfx

    tags = ["OFX>", "STMTTRNRS>", "CURDEF>USD", "BANKACCTFROM>", "ACCTID>1", "/BANKACCTFROM>", "STMTTRN>", "DTPOSTED>20240101", "TRNAMT>2", "/STMTTRN>", "/STMTTRNRS>"]
    rows = spark.createDataFrame([(0, 0, n, tag) for n, tag in enumerate(tags)], "file long, chunk long, pos long, token string")
    accounts = spark.createDataFrame([("1", "Assets:One")], "key string, value string")
    seen = {}
    _recorded(monkeypatch, scan_qfx, seen)
    book = scan_qfx.scan_qfx(rows, accounts, folder=str(tmp_path / "stage"))
    assert [(r.account, r.cp_quantity) for r in book.postings.collect()] == [("Assets:One", 2)]
    assert sorted(r.tag for r in seen["rows"].collect()) == ["ACCTID", "CURDEF", "DTPOSTED", "STMTTRNRS", "TRNAMT"]


def test_marks_with_few_values_are_carried_as_others(spark, bag):
    """F3 to F9: a mark carried as a number, before the first one, on rows that do not count, and over chunks."""
    from pyspark.sql import functions as F

    from tallybook.functions.order import carry_forward

    data = [(0, 0, 1, None, True), (0, 0, 2, "b", True), (0, 0, 3, "a", False), (0, 0, 4, None, True), (0, 1, 5, None, True), (0, 1, 6, "b", True), (1, 0, 7, None, True)]
    rows = spark.createDataFrame(data, "file long, chunk long, pos long, k string, line boolean")
    marks = {"m": F.col("k"), "n": F.when(F.col("k") == "a", False)}
    plain = carry_forward(rows, marks, counts=F.col("line"))
    coded = carry_forward(rows, marks, counts=F.col("line"), among={"m": ("b", "a"), "n": (True, False)}, keep=F.col("line"))
    assert bag(coded) == bag(plain.filter("line"))
    assert bag(coded.filter("pos in (1, 4)"), "pos", "m", "m_no", "n", "n_no") == [(1, None, None, None, None), (4, "a", 2, False, 2)]


def test_a_scan_stages_what_its_tables_show(spark, tmp_path, monkeypatch, bag):
    """F4 to F6: lines that only other tables show are not written, whether a text goes on over chunks or not; flags of quotes
    are found once."""
    from tallybook.operators import scan_text

    text = ['2024-01-01 * "One"', "  Assets:A 1 USD", "  Assets:B", "2024-01-02 open Assets:A", "  Assets:C 3 USD", 'include "a', "  Assets:D 4 USD", '.book"', "  Assets:E",
            '2024-01-03 * "Two', 'more" #t', "  Assets:F 5 USD", "; cut", "  Assets:G", 'include "b.book"', "2024-01-04 close Assets:A", "  Assets:H"]
    rows = [(file, n // 6, n, line) for file in (0, 1) for n, line in enumerate(text)]
    lines = spark.createDataFrame(rows, "file_no long, chunk long, pos long, line string")
    whole = scan_text.scan_text(lines)
    kinds = {"transactions": {"*"}, "postings": {"posting"}, "verifications": {"open", "close"}, "includes": {"include"}, "rejects": {"posting"}}
    for name, of in kinds.items():
        seen = {}
        with monkeypatch.context() as patch:
            _recorded(patch, scan_text, seen)
            book = scan_text.scan_text(lines, str(tmp_path / name), (name,))
            assert "line" not in seen["quotes"].columns and not seen["quotes"].filter("_ending is null").count()
        assert bag(getattr(book, name)) == bag(getattr(whole, name)) != []
        # Before its first mark a chunk cannot tell what it belongs to.
        known = seen["rows"].filter("_keep and _value_text = false")
        assert {r.kind for r in known.collect()} <= of, name
        assert [other for other in kinds if getattr(book, other) is not None] == [name]
    both = scan_text.scan_text(lines, str(tmp_path / "both"), ("transactions", "postings"))
    assert bag(both.postings) == bag(whole.postings) and bag(both.transactions) == bag(whole.transactions)
    assert sorted({r.path for r in whole.includes.collect()}) == ["a\n  Assets:D 4 USD\n.book", "b.book"]


def test_a_scan_carries_marks_its_tables_need(spark, tmp_path, monkeypatch, bag):
    """what opened a run of postings is carried for tables that show postings alone."""
    from tallybook.operators import scan_text

    text = ['2024-01-01 * "One', 'more" #t', "  Assets:A 1 USD", "2024-01-02 open Assets:A", "  Assets:B", '2024-01-03 * "Two"']
    lines = spark.createDataFrame([(0, n // 2, n, line) for n, line in enumerate(text)], "file_no long, chunk long, pos long, line string")
    whole = scan_text.scan_text(lines)
    for name, carried in (("transactions", False), ("includes", False), ("postings", True), ("rejects", True)):
        seen = {}
        with monkeypatch.context() as patch:
            _recorded(patch, scan_text, seen)
            book = scan_text.scan_text(lines, str(tmp_path / name), (name,))
        assert ("_no_mark" in seen["rows"].columns) == carried, name
        assert bag(getattr(book, name)) == bag(getattr(whole, name)), name
    assert bag(whole.transactions, "statement_no", "narration", "tags") == [(2, "One\nmore", "#t"), (6, "Two", None)]
    assert bag(whole.rejects, "statement_no") == [(5,)]


def test_books_are_reconciled_from_staged_parts(spark, tmp_path, monkeypatch, bag):
    """items are read, completed and dated before they are compared, share by share, with the same rows."""
    query = registry.queries()["reconcile_books"]
    monkeypatch.setattr(registry, "_folder", lambda star, what: None)
    lazy = bag(query(spark, FOLDER))
    monkeypatch.setattr(registry, "_folder", lambda star, what: str(tmp_path / what))
    monkeypatch.setattr(registry, "_ROWS_PER_PASS", 2500)
    staged = query(spark, FOLDER)
    assert not [file for file in staged.inputFiles() if "orders" in file or "lineitem" in file]
    assert bag(staged) == lazy != []
    assert sorted(part.name for part in (tmp_path / "reconciled").iterdir()) == [f"{name}-{n}" for name in ("a", "b", "missing") for n in range(3)]


def test_reconciling_in_parts_finds_what_one_pass_finds(spark, tmp_path, bag):
    """copies, nulls, headers that are missing or come twice, gaps; books in parts of different numbers."""
    from tallybook.model import POSTINGS, TRANSACTIONS
    from tallybook.operators.complete import complete_transactions
    from tallybook.operators.reconcile import reconcile, shares
    from tallybook.sinks.tables import staging_parts

    def book(extra, off):
        rows = []
        for no in [*range(40), None, 7, 8]:
            rows += [(1, no, 0, f"A{(no or 0) % 5}", D(3), "P", D((no or 0) % 4 + (off if no == 9 else 0)), "USD"), (2, no, 0, "B", None, None, None, None)]
        rows += [(3, 5, 0, "C", D(1), None, D(1), "USD"), (4, 6, 0, None, D(1), "P", D(1), "USD")] + extra
        return spark.createDataFrame(rows, POSTINGS)

    def headers(late):
        rows = [(no, 0, date(2024, 1, 1 + no % 7 + (no == late)), "n", None) for no in [*range(38), 3, 8]]
        return spark.createDataFrame(rows, TRANSACTIONS)

    raw_a, raw_b = book([], 0), book([(5, 50, 0, "Z", D(1), "P", D(1), "USD")], 1)
    heads_a, heads_b = headers(-1), headers(11)
    whole = bag(reconcile(complete_transactions(raw_a), heads_a, complete_transactions(raw_b), heads_b))
    assert whole and len(whole) < raw_a.count()
    for n_a, n_b in ((1, 1), (3, 3), (4, 2)):
        parts_a, parts_b = shares(raw_a, n_a, "transaction_no"), shares(raw_b, n_b, "transaction_no")
        assert sum(part.count() for part in parts_a) == raw_a.count()
        stage = staging_parts(spark, str(tmp_path / f"{n_a}-{n_b}"))
        parts = reconcile([*map(complete_transactions, parts_a)], heads_a, [*map(complete_transactions, parts_b)], heads_b, stage)
        assert bag(parts) == whole
    alone = reconcile(complete_transactions(raw_a), heads_a, complete_transactions(raw_b), heads_b, staging_parts(spark, str(tmp_path / "alone")))
    assert bag(alone) == whole


def test_a_staged_part_leaves_no_shuffle_files(spark, tmp_path, bag):
    """what a part shuffled goes once it is written; the session keeps its settings."""
    from tallybook.sinks import tables

    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(n).getName() for n in range(files.size()) if files.apply(n).getName().startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(tables._CLEANUP, None)
    parts = [spark.range(n, 1000, 3).repartition(4, "id").groupBy("id").count() for n in range(3)]
    whole = tables.staging_parts(spark, str(tmp_path))(parts, "ids")
    until = time.time() + 30
    while (left := shuffled() - before) and time.time() < until:
        time.sleep(0.2)
    assert not left
    assert bag(whole) == [(n, 1) for n in sorted(range(1000), key=lambda n: repr((n, 1)))]
    assert spark.conf.get(tables._CLEANUP, None) == setting


def test_items_are_not_shuffled_for_few_suppliers(spark, monkeypatch, bag):
    """suppliers are broadcast if they are few, whatever Spark takes their places to need."""
    from tallybook.plans import star as S

    def plan(rows):
        return rows._jdf.queryExecution().executedPlan().toString()

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        items = S._item_postings(S.Star(spark, FOLDER))
        assert "BroadcastHashJoin [l_suppkey" in plan(items)
        monkeypatch.setattr(S, "_FEW_SUPPLIERS", 1)
        many = S._item_postings(S.Star(spark, FOLDER))
        assert "SortMergeJoin [l_suppkey" in plan(many)
        assert bag(many) == bag(items)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
