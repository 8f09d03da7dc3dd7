"""Readers: stable keys, headers in any order, files in any number, faulty statements, exact products."""

from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tallybook.functions.money import price_times_quantity
from tallybook.functions.order import LINES_PER_FILE, carry_forward, ordinal
from tallybook.model import RAW
from tallybook.plans import books, registry
from tallybook.plans.star import Star
from tallybook.sources.csv import read_activities
from tallybook.sources.qfx import read_tags
from tallybook.sources.text import read_book_lines

HEAD = "Processed,Settled,Tran Types,Description,Price,Quantity,Amount\n"
OTHER = "Processed,Settled,Tran Types,Description,Quantity,Price,Amount\n"


def activity_files(tmp_path, n=40):
    (tmp_path / "sym.csv").write_text("Fund,FND\n")
    rows = "".join(f"2024-01-0{i % 9 + 1},2024-01-0{i % 9 + 1},BUY,Fund,2.5,{i + 1},-{i + 1}.00\n" for i in range(n))
    (tmp_path / "a.csv").write_text(HEAD + rows)
    (tmp_path / "b.csv").write_text(OTHER + "2024-02-01,2024-02-01,BUY,Fund,7,3.5,-9.00\n")
    return [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")]


def book(spark, tmp_path, **options):
    paths = activity_files(tmp_path)
    return books.activities_book(spark, paths, str(tmp_path / "sym.csv"), "A1", "Ann", "CAD", **options)


def test_columns_are_found_in_each_file(spark, tmp_path, bag):
    got = book(spark, tmp_path)
    assert got.rejects.isEmpty()
    units = [q for q, in bag(got.postings.filter("cp_commodity = 'FND'"), "cp_quantity")]
    assert sorted(map(float, units)) == sorted([float(i + 1) for i in range(40)] + [7.0])


def test_an_absent_column_is_named(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Processed,Settled\n1,2\n")
    with pytest.raises(ValueError, match="Tran Types"):
        books.activities_book(spark, str(tmp_path / "x.csv"), str(tmp_path / "x.csv"), "A", "B", "CAD")


@pytest.mark.parametrize("kind", ["csv", "qfx"])
def test_keys_do_not_depend_on_splits(spark, tmp_path, kind):
    if kind == "csv":
        got = book(spark, tmp_path)
    else:
        moves = "".join(f"<STMTTRN><DTPOSTED>20240105<TRNAMT>{i}<NAME>n</STMTTRN>" for i in range(300))
        body = f"<OFX><STMTTRNRS><STMTRS><CURDEF>CAD<BANKACCTFROM><ACCTID>1</BANKACCTFROM>{moves}</STMTRS></STMTTRNRS></OFX>"
        (tmp_path / "s.qfx").write_text(body)
        (tmp_path / "names.csv").write_text("1,Assets:Bank\n")
        got = books.statement_book(spark, str(tmp_path / "s.qfx"), str(tmp_path / "names.csv"))
    keys = {r[0] for r in got.transactions.select("statement_no").collect()}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        used = {r[0] for r in got.postings.select("transaction_no").collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert keys == used and len(keys) == (41 if kind == "csv" else 300)


def plan_of(frame):
    frame.collect()
    return frame._jdf.queryExecution().executedPlan().toString()


def test_rows_are_numbered_where_they_are_read(spark, tmp_path):
    """Only the counts of splits move; no exchange holds a row's columns."""
    paths = activity_files(tmp_path, n=400)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_activities(spark, paths)
        got = sorted((r.file, r.row_no, r.quantity) for r in rows.collect())
        plan = plan_of(rows)
        tags = plan_of(read_tags(spark, paths))
        lines = plan_of(read_book_lines(spark, paths[0]))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == [(0, i + 1, str(i + 1)) for i in range(400)] + [(1, LINES_PER_FILE + 1, "7")]
    moved = [line for line in plan.splitlines() if "Exchange" in line and "Broadcast" not in line]
    assert moved and not any("description" in line or "hashpartitioning(path, 4), REPARTITION" in line for line in moved)
    assert "SortMergeJoin" not in plan
    for other in (tags, lines):
        assert "hashpartitioning" not in other


def test_many_paths_are_merged(spark, monkeypatch):
    from tallybook.sources import files

    names = [f"hdfs://store/folder/{i:06d}.csv" for i in range(200_000)]
    rows = spark.createDataFrame([(names[i], i) for i in range(0, 200_000, 1000)], "path string, i long")
    merged = files.with_file_numbers(rows, names)
    assert all(r.file == r.i for r in merged.collect())
    assert "BroadcastHashJoin" not in merged._jdf.queryExecution().sparkPlan().toString()
    few = files.with_file_numbers(rows.limit(5), names[:10_000])
    assert "BroadcastHashJoin" in few._jdf.queryExecution().sparkPlan().toString()
    with pytest.raises(Exception, match="no such file"):
        files.with_file_numbers(rows, names[:10]).collect()


def test_headers_come_from_the_first_bytes(spark, tmp_path):
    from tallybook.sources.files import _scanned_first_lines, first_lines

    (tmp_path / "a b.csv").write_bytes(b"\xef\xbb\xbfOne,Two\r\n" + b"x" * 100_000)
    (tmp_path / "c.csv").write_bytes(b"")
    (tmp_path / "d.csv").write_bytes(b"only")
    found = spark.read.text(str(tmp_path)).inputFiles()
    got = {path.rsplit("/")[-1]: line for path, line in first_lines(spark, found, per_task=1)}
    assert got == {"a%20b.csv": b"\xef\xbb\xbfOne,Two\r", "d.csv": b"only"}
    # Spark's own reader leaves this mark out.
    assert {line for _, line in _scanned_first_lines(spark, found)} == {b"One,Two\r", b"only"}


def test_a_mark_before_the_header_is_not_part_of_it(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEAD + "1,2,BUY,é,2,3,-6\n", encoding="utf-8-sig")
    for multiline in (False, True):
        (row,) = read_activities(spark, str(tmp_path / "a.csv"), multiline=multiline).collect()
        assert (row.processed, row.description, row.malformed) == ("1", "é", False)


@pytest.mark.parametrize("size", [7, 60, 100_000])
def test_charsets_are_told_by_their_marks(spark, tmp_path, bag, size):
    body = "OFXHEADER:100\n<OFX><STMTTRNRS><STMTRS><CURDEF>CAD<BANKACCTFROM><ACCTID>1</BANKACCTFROM><STMTTRN><DTPOSTED>20240105<TRNAMT>-1.50<NAME>Café ‰㰀</STMTTRN></STMTRS></STMTTRNRS></OFX>"
    (tmp_path / "names.csv").write_text("1,Assets:Bank\n")
    narrow = body.replace("㰀", "")
    texts = {"utf-8": body.encode(), "mark": body.encode("utf-8-sig"), "le": b"\xff\xfe" + body.encode("utf-16-le"), "be": b"\xfe\xff" + body.encode("utf-16-be"), "1252": narrow.encode("cp1252")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        for name, data in texts.items():
            (tmp_path / f"{name}.qfx").write_bytes(data)
            book = books.statement_book(spark, str(tmp_path / f"{name}.qfx"), str(tmp_path / "names.csv"), encoding="1252" if name == "1252" else None)
            told = "Café ‰" if name == "1252" else "Café ‰㰀"
            assert bag(book.transactions, "narration") == [(told,)] and bag(book.postings, "cp_quantity", "account") == [("-1.5", "Assets:Bank")]
            assert book.rejects.isEmpty()
        every = books.statement_book(spark, [str(tmp_path / f"{n}.qfx") for n in ("mark", "le", "be", "1252")], str(tmp_path / "names.csv"), encoding="1252")
        assert sorted(bag(every.transactions, "narration")) == [("Café ‰",)] + [("Café ‰㰀",)] * 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_more_decimals_than_the_type_holds_are_no_amount(spark, bag):
    from tallybook.functions.money import parse_money

    texts = ["0.00000000016", "0.0000000001", "$1,234.50000000000000", "1.", ".5", "-.00000000001", "1234567890123456.1234567890000"]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", parse_money(F.col("t")).alias("m")).collect()
    assert {r.t: r.m and format(r.m.normalize(), "f") for r in got} == dict(zip(texts, [None, "0.0000000001", "1234.5", "1", "0.5", None, "1234567890123456.123456789"], strict=True))


def test_summary_comes_with_the_writing(spark, tmp_path, bag):
    from tallybook.operators.summary import import_summary
    from tallybook.sinks.tables import write_tables

    got = book(spark, tmp_path)
    counts = write_tables(got, str(tmp_path / "out"))
    (summary,) = import_summary(got).collect()
    assert counts["transactions"] == summary.transactions == 41 and counts["postings"] == summary.postings and counts["rejects"] == 0
    assert bag(spark.read.parquet(str(tmp_path / "out" / "postings"))) == bag(got.postings)


def test_folder_keeps_the_scan_and_foreign_files(spark, tmp_path):
    folder = str(tmp_path / "staged")
    assert book(spark, tmp_path, folder=folder).transactions.count() == 41
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS"):
        book(spark, tmp_path, folder=folder)


def test_cells_with_line_breaks(spark, tmp_path, bag):
    (tmp_path / "sym.csv").write_text("Fund,FND\n")
    (tmp_path / "a.csv").write_text(HEAD + '2024-01-01,2024-01-01,BUY,"Fund\nb",2,3,-6\n')
    got = books.activities_book(spark, str(tmp_path / "a.csv"), str(tmp_path / "sym.csv"), "A", "B", "CAD", multiline=True)
    assert got.rejects.isEmpty() and bag(got.transactions, "narration")[0][0].endswith("Fund\nb")


CELLS = (
    HEAD
    + '1,2,BUY,"Fund\nb",2,3,-6\n'
    + '1,2,BUY,"a ""quoted""\r\n\r\n, ""end""","x\ny",3,-6\n'
    + '1,2,SELL,5" disk,2,3,-6\n'  # a quote within a cell is text
    + '\n1,2,SELL,"closed" and more,2,3,-6\n'
    + '1,2,BUY,"""\n""",2,3,"-6\n"\n'
    + "1,2,few cells\n"
    + '1,2,BUY,last,2,3,"never closed\n1,2,BUY,inside,2,3,4\n'
)


@pytest.mark.parametrize("size", [5, 33, 200, 100_000])
def test_cells_over_line_ends_in_any_splits(spark, tmp_path, size):
    (tmp_path / "a.csv").write_text(CELLS, newline="")
    (tmp_path / "b.csv").write_text(OTHER + '1,2,BUY,"p\nq",7,"3\n",1\n')
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        rows = read_activities(spark, [str(tmp_path / "a.csv"), str(tmp_path / "b.csv")], multiline=True)
        got = sorted(tuple(r) for r in rows.select("row_no", "description", "price", "quantity", "amount", "malformed").collect())
        assert spark.read.text(str(tmp_path / "a.csv")).rdd.getNumPartitions() > 50 or size > 5
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got[:5] == [
        (1, "Fund\nb", "2", "3", "-6", False),
        (3, 'a "quoted"\n\n, "end"', "x\ny", "3", "-6", False),
        (7, '5" disk', "2", "3", "-6", False),
        (9, got[3][1], "2", "3", "-6", False),
        (10, '"\n"', "2", "3", "-6\n", False),
    ]
    assert got[5][0] == 13 and got[5][-1] and got[6][0] == 14 and got[7] == (LINES_PER_FILE + 1, "p\nq", "3\n", "7", "1", False)
    assert len(got) == 8


def test_statement_faults_are_rejects(spark, tmp_path, bag):
    move = "<STMTTRN><DTPOSTED>20240105<TRNAMT>1<NAME>n</STMTTRN>"
    held = "<LEDGERBAL><BALAMT>1<DTASOF>20240131</LEDGERBAL>"
    body = (
        f"<STMTTRNRS><STMTRS><CURDEF>CAD<BANKACCTFROM><ACCTID>9</BANKACCTFROM>{move}</STMTTRNRS>"
        f"<OFX>{move}<STMTTRNRS><STMTRS><BANKACCTFROM><ACCTID>2</BANKACCTFROM>{move}{held}</STMTRS></STMTTRNRS>"
        f"<STMTTRNRS><STMTRS><CURDEF>CAD{move}{held}</STMTRS></STMTTRNRS></OFX>"
    )
    (tmp_path / "s.qfx").write_text(body)
    (tmp_path / "names.csv").write_text("1,Assets:Bank\n")
    got = books.statement_book(spark, str(tmp_path / "s.qfx"), str(tmp_path / "names.csv"))
    assert got.postings.isEmpty() and got.verifications.isEmpty()
    assert bag(got.rejects, "account", "reason") == sorted(
        [("2", "no currency")] * 2 + [(None, "no account")] * 2 + [(None, "outside a statement")], key=repr
    )


def test_includes_by_uri_and_repeated(spark, tmp_path, bag):
    (tmp_path / "y.book").write_text("2024-01-01 open Assets:Y\n")
    (tmp_path / "main.book").write_text(f'include "file://{tmp_path}/y.book"\n' * 3 + "2024-01-01 open Assets:X\n")
    got = books.text_book(spark, str(tmp_path / "main.book"))
    assert bag(got.verifications, "file_no", "account") == [(0, "Assets:X"), (1, "Assets:Y")]


def test_many_small_files_are_numbered(spark):
    """100,000 files of a line each: no single task orders them, and the ranks have no gaps."""
    rows = spark.range(100_000).select(F.col("id").alias("file"), F.lit(0).alias("chunk"), F.lit(7).alias("pos"))
    placed = carry_forward(rows, {"last": F.lit("x")})
    assert "SinglePartition" not in placed._jdf.queryExecution().toString()
    assert placed.filter(F.col("number") != F.col("file") * LINES_PER_FILE + 1).isEmpty()
    ranked = ordinal(placed, "number", "rank")
    assert ranked.filter("rank <> file").isEmpty()


def test_text_scans_have_no_single_task(spark):
    star = Star(spark, "/root/testdata/sf0.001")
    for name, query in registry._QUERIES.items():
        if name.startswith("scan_text"):
            assert "SinglePartition" not in query(star)._jdf.queryExecution().toString(), name


@pytest.mark.parametrize(
    ("price", "quantity", "cost"),
    [
        ("0.0004999996", "1", "0"),
        ("0.0005", "1", "0.001"),
        ("0.0005", "-1", "-0.001"),
        ("1234567.1234567891", "3.3333333333", "4115223.745"),
        ("9e19", "9e19", None),
        ("99999999999999999", "0.5", "49999999999999999.5"),
        (None, "1", None),
    ],
)
def test_price_times_quantity(spark, price, quantity, cost):
    one = lambda v: F.lit(v and format(Decimal(v), "f")).cast(RAW)
    got = spark.range(1).select(price_times_quantity(one(price), one(quantity))).first()[0]
    assert got == (cost and Decimal(cost))


def test_balances_are_ordered(spark):
    rows = registry.queries()["balances_tc"](spark, "/root/testdata/sf0.001").collect()
    assert [(r[0], r[1]) for r in rows] == sorted((r[0], r[1]) for r in rows)
