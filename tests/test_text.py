"""Plain-text books: statements, runs of postings, file splits, includes, round trip."""

import re
from datetime import date

import pytest
from pyspark.sql import functions as F

from tallybook.functions.order import LINES_PER_FILE
from tallybook.functions.text import resolve_path
from tallybook.operators.complete import complete_transactions
from tallybook.operators.render import render_transactions
from tallybook.operators.scan_text import scan_text, transactions_without_postings
from tallybook.plans import books
from tallybook.sinks.text import write_lines
from tallybook.sources.text import included_files, read_lines

BOOK = """\
option "title" "Mine" ; a comment
; a comment line
2024-01-02 open Assets:Bank:Main
2024-01-05 * "Lunch" #food #out
  Expenses:Food 12.50 USD
  Assets:Bank:Main ; the rest
2024-01-06 * "Buy shares"
  Assets:Broker 3 ABC @@ 30.00 USD
  ; cut
  Assets:Bank:Main
2024-01-07 * "Nothing under it"
2024-01-08 * "Free" ; no tags
  Assets:Gifts @@ 1 USD
  Assets:Été:Zoë-1 -2.5 X_1

2024-01-31 balance Assets:Bank:Main -42.50 USD;end
2024-02-01 close Assets:Bank:Main
2024-02-02 event "place" "Home"
2024-02-03 custom "budget" 12
2024-02-30 open Assets:NoSuchDay
2024-02-04 open Assets:A trailing
  Assets:Stray 1
Words that mean nothing
2024-02-05 * "never ends
\t
"""


@pytest.fixture(scope="module")
def book(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("book") / "main.book"
    path.write_text(BOOK.replace("\n", "\r\n"))
    return books.text_book(spark, str(path))


def test_transactions(book, bag):
    assert sorted(bag(book.transactions)) == [
        (4, 0, date(2024, 1, 5), "Lunch", "#food #out"),
        (7, 0, date(2024, 1, 6), "Buy shares", None),
        (11, 0, date(2024, 1, 7), "Nothing under it", None),
        (12, 0, date(2024, 1, 8), "Free", None),
    ]
    assert bag(transactions_without_postings(book), "narration") == [("Nothing under it",)]


def test_postings(book, bag):
    assert sorted(bag(book.postings.drop("file_no"))) == [
        (5, 4, "Expenses:Food", "12.5", "USD", "12.5", "USD"),
        (6, 4, "Assets:Bank:Main", None, None, None, None),
        (8, 7, "Assets:Broker", "3", "ABC", "30", "USD"),
        (13, 12, "Assets:Gifts", None, None, "1", "USD"),
        (14, 12, "Assets:Été:Zoë-1", "-2.5", "X_1", "-2.5", "X_1"),
    ]


def test_other_statements(book, bag):
    assert sorted(bag(book.verifications.drop("file_no"))) == [
        (3, date(2024, 1, 2), 0, "Assets:Bank:Main", None, None),
        (16, date(2024, 1, 31), 1, "Assets:Bank:Main", "-42.5", "USD"),
        (17, date(2024, 2, 1), 2, "Assets:Bank:Main", None, None),
    ]
    assert sorted(bag(book.informationals.drop("file_no"))) == [
        (1, None, 4, "title", "Mine"),
        (18, date(2024, 2, 2), 3, "place", "Home"),
        (19, date(2024, 2, 3), 5, None, ' "budget" 12'),
    ]
    assert sorted(bag(book.rejects, "statement_no", "reason")) == [
        (10, "posting without a transaction"),
        (21, "not a complete statement"),
        (22, "not a complete statement"),
        (24, "not a complete statement"),
    ]


def write_long_book(path, transactions):
    """A book whose runs of postings are long enough to cross small splits."""
    lines, expected, number = [], [], 0
    for n in range(transactions):
        lines.append(f'2024-01-{n % 28 + 1:02d} * "T{n}"')
        header = len(lines)
        for leg in range(n % 40):
            lines.append(f"  Assets:A{leg} {leg}.5 USD")
            expected.append((len(lines), header, f"Assets:A{leg}"))
        if n % 3 == 0:
            lines.append("; note")
    path.write_text("\n".join(lines) + "\n")
    return expected


def test_runs_and_numbers_hold_across_file_splits(spark, tmp_path, bag):
    expected = write_long_book(tmp_path / "long.book", 400)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = read_lines(spark, str(tmp_path / "long.book"))
        assert lines.select("chunk").distinct().count() > 50
        scanned = scan_text(lines.withColumn("file_no", F.lit(0).cast("long")))
        got = bag(scanned.postings, "statement_no", "transaction_no", "account")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got) == expected


LONG_TEXTS = """\
2024-01-01 * "First
  Assets:NotAPosting 1 USD

; no comment
end" #tag ; "quoted" comment
  Assets:A 1 USD
  Assets:B
2024-01-02 event "place
of" "here
and there"
2024-01-03 event "whole" "
here"
option "ti
tle" "value" ; odd " quote
include "part
.book"
2024-01-04 * "
"
  Assets:C
2024-01-05 * "never ends
2024-01-06 * "Whole" #a
  Assets:D
; a comment with one quote "
2024-13-01 * "no such day
2024-01-07 * "Also whole"
  Assets:E
2024-01-08 event "wrong
end" #tag
  Assets:Stray
2024-01-09 * "a "b" c
2024-01-10 close Assets:D
2024-01-11 * "to the end
of the book
"""


@pytest.mark.parametrize("size", [7, 40, 100_000])
def test_texts_over_line_ends(spark, tmp_path, bag, size):
    (tmp_path / "texts.book").write_text(LONG_TEXTS)
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        lines = read_lines(spark, str(tmp_path / "texts.book"))
        assert (lines.select("chunk").distinct().count() > 20) == (size < 30)
        book = scan_text(lines.withColumn("file_no", F.lit(0).cast("long")))
        got = {t: bag(getattr(book, t)) for t in ("transactions", "informationals", "includes")}
        postings, rejects = bag(book.postings, "statement_no", "transaction_no", "account"), bag(book.rejects, "statement_no", "line", "reason")
        closed = bag(book.verifications, "statement_no", "account")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert sorted(got["transactions"]) == [
        (5, 0, date(2024, 1, 1), "First\n  Assets:NotAPosting 1 USD\n\n; no comment\nend", "#tag"),
        (18, 0, date(2024, 1, 4), "\n", None),
        (21, 0, date(2024, 1, 6), "Whole", "#a"),
        (25, 0, date(2024, 1, 7), "Also whole", None),
    ]
    assert sorted(postings) == [(6, 5, "Assets:A"), (7, 5, "Assets:B"), (19, 18, "Assets:C"), (22, 21, "Assets:D"), (26, 25, "Assets:E")]
    assert sorted(got["informationals"], key=lambda r: r[0]) == [
        (10, 0, date(2024, 1, 2), 3, "place\nof", "here\nand there"),
        (12, 0, date(2024, 1, 3), 3, "whole", "\nhere"),
        (14, 0, None, 4, "ti\ntle", "value"),
    ]
    assert got["includes"] == [(16, 0, "part\n.book")]
    assert sorted(rejects) == [
        (20, '2024-01-05 * "never ends', "not a complete statement"),
        (28, '2024-01-08 event "wrong\nend" #tag', "not a complete statement"),
        (29, "  Assets:Stray", "posting without a transaction"),
        (30, '2024-01-09 * "a "b" c', "not a complete statement"),
        (32, '2024-01-11 * "to the end', "not a complete statement"),
    ]
    assert closed == [(31, "Assets:D")]


def test_states_against_a_plain_machine(spark):
    """Random lines, read one after the other, against the running sums."""
    import random

    from tallybook.functions.quotes import text_events

    rng = random.Random(4)
    kinds = ['2024-01-01 * "a', '2024-01-01 * "a"', '2024-01-01 * "', 'b"', 'c" "d', 'plain', '"', 'x" "y"', 'no" end"', '2024-01-01 event "p" "q', "; comment"]
    ends = {'b"': "end", 'c" "d': "again", '"': "end", 'x" "y"': "second", '2024-01-01 * "': "end"}
    opening = {'2024-01-01 * "a', '2024-01-01 * "', '2024-01-01 event "p" "q'}
    rows, expected = [], set()
    for file in range(30):
        book = [rng.choice(kinds) for _ in range(60)]
        following = [next((ends.get(t, "no") for t in book[i + 1 :] if '"' in t), "no") for i in range(60)]
        is_open = False
        for i, text in enumerate(book):
            inside = is_open and (ends.get(text, "no") if '"' in text else following[i]) != "no"
            if '"' in text:
                goes_on = ends.get(text) == "again" if inside else text in opening
                if inside and not (goes_on and following[i] != "no"):
                    expected.add((file, i, "last"))
                if not inside and goes_on and following[i] != "no":
                    expected.add((file, i, "first"))
                is_open = goes_on
            rows.append((file, i // rng.choice([1, 7]) if file % 2 else i // 9, i, text))
    for n, row in enumerate(rows):  # chunks of a file have to follow its lines
        if n and rows[n - 1][0] == row[0] and rows[n - 1][1] > row[1]:
            rows[n] = (row[0], rows[n - 1][1], *row[2:])
    lines = spark.createDataFrame(rows, "file_no long, chunk long, pos long, line string")
    got = sorted((r.file_no, r.pos, r.text) for r in text_events(lines, "file_no").collect())
    # Where a text goes on behind an end, that is no end.
    ons = {(f, p // 4) for f, p, _ in got if p % 4 == 3}
    found = {(f, p // 4, "first") for f, p, _ in got if p % 4 == 0} | {(f, p // 4, "last") for f, p, text in got if not text and (f, p // 4) not in ons}
    assert found == expected


def test_includes_are_read_once_in_reading_order(spark, tmp_path, bag):
    (tmp_path / "sub dir").mkdir()
    main, one, two, three = (
        tmp_path / "main.book",
        tmp_path / "sub dir" / "one+1.book",
        tmp_path / "sub dir" / "two.book",
        tmp_path / "three.book",
    )
    main.write_text(f'include "sub dir/one+1.book" ; first\n2024-01-01 open Assets:M\ninclude "{three}"\n')
    one.write_text('2024-01-01 open Assets:One\ninclude "two.book"\n')
    two.write_text('include "../main.book"\n2024-01-01 open Assets:Two\n')
    three.write_text('include "sub dir/two.book"\n2024-01-01 open Assets:Three\n')
    files = included_files(spark, str(main))
    assert [re.sub(".*/", "", f) for f in files] == ["main.book", "one+1.book", "two.book", "three.book"]
    book = books.text_book(spark, str(main))
    # A number holds the file and the line's place in it.
    assert sorted(bag(book.verifications, "statement_no", "file_no", "account")) == [
        (2, 0, "Assets:M"),
        (LINES_PER_FILE + 1, 1, "Assets:One"),
        (2 * LINES_PER_FILE + 2, 2, "Assets:Two"),
        (3 * LINES_PER_FILE + 2, 3, "Assets:Three"),
    ]
    assert len(bag(book.includes, "path")) == 5


def test_staged_lines_give_the_same_tables(spark, book, tmp_path, bag):
    (tmp_path / "main.book").write_text(BOOK)
    staged = books.text_book(spark, str(tmp_path / "main.book"), folder=str(tmp_path / "stage"))
    for name in ("transactions", "postings", "verifications", "informationals", "includes", "rejects"):
        assert bag(getattr(staged, name)) == bag(getattr(book, name)), name
    plan = staged.transactions._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(kind" in plan


def test_paths():
    assert resolve_path("file:/a/b/main.book", "c/d.book") == "file:/a/b/c/d.book"
    assert resolve_path("file:/a/b/main.book", "../d.book") == "file:/a/d.book"
    assert resolve_path("s3a://bucket/a/main.book", "/x.book") == "s3a://bucket/x.book"
    assert resolve_path("/a/main.book", "hdfs://h/x.book") == "hdfs://h/x.book"


def test_rendered_book_scans_to_the_same_postings(spark, tmp_path, bag):
    from tallybook.plans import star
    from tallybook.plans.star import Star

    tables = Star(spark, "/root/testdata/sf0.001")
    # A cost in the commodity of the units is not written, so leave such legs out; headers
    # stand before the first complete posting, so incomplete transactions are left out too.
    postings = star.postings(tables)
    open_ = postings.filter("tc_commodity is null and cp_commodity is not null")
    postings = postings.join(open_.select("transaction_no").distinct(), "transaction_no", "left_anti")
    completed = complete_transactions(postings).filter("tc_commodity_final is not null")
    transactions = star.transactions(tables)
    folder = str(tmp_path / "out")
    write_lines(render_transactions(transactions, completed, numbered=False), folder, files=5)
    lines = read_lines(spark, folder)
    order = lines.select("file").distinct().orderBy("file").collect()
    numbers = spark.createDataFrame([(r["file"], n) for n, r in enumerate(order)], "file string, file_no long")
    scanned = scan_text(lines.join(F.broadcast(numbers), "file"))
    names = scanned.transactions.select(F.col("statement_no").alias("transaction_no"), "narration")
    got = scanned.postings.join(names, "transaction_no").selectExpr(
        "narration", "account", "cast(cp_quantity as decimal(38,2)) q", "cp_commodity c",
        "cast(tc_quantity as decimal(38,2)) t", "tc_commodity d",
    )
    originals = transactions.select(F.col("statement_no").alias("transaction_no"), "narration")
    want = completed.join(originals, "transaction_no").selectExpr(
        "narration", "account", "cp_quantity_final q", "cp_commodity_final c",
        "tc_quantity_final t", "tc_commodity_final d",
    )
    assert got.count() > 1000
    # A run that continues in the next output file is the document's, not the file's.
    cut = scanned.rejects.count()
    assert got.exceptAll(want).isEmpty()
    assert want.exceptAll(got).count() == cut
