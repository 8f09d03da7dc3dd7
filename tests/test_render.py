"""Rendering of transactions and assertions."""

from datetime import date
from decimal import Decimal

from tallybook.model import TRANSACTIONS, VERIFICATIONS
from tallybook.operators.complete import complete_transactions, normalise_verifications
from tallybook.operators.render import render_transactions, render_verifications
from tallybook.sinks.text import write_lines
from tallybook.sources.rows import table
from test_complete import postings


def test_document(spark, tmp_path):
    transactions = table(
        spark,
        [
            (0, 0, date(2024, 1, 2), "Second", None),
            (1, 0, date(2024, 1, 1), "First", "#a #b"),
            (2, 0, date(2024, 1, 3), "Empty", None),
            (3, 0, date(2024, 1, 4), "Half", None),
        ],
        TRANSACTIONS,
    )
    book = postings(
        spark,
        (0, "Assets:A", "2", "ABC", "30", "USD"),
        (0, "Assets:B"),
        (1, "Assets:A", "5.555", "USD", "5.555", "USD"),
        (3, "Assets:C", "1", "ABC"),
        (3, "Assets:D", "1", "ABC", "2", "USD"),
        (9, "Assets:NoHeader", "1", "USD", "1", "USD"),
    )
    # The gap in transaction 3 is filled, so make one that is not: no cost at all.
    book = book.filter("not (transaction_no = 3 and account = 'Assets:D')")
    lines = render_transactions(transactions, complete_transactions(book))
    write_lines(lines, str(tmp_path / "out"), files=3)
    written = [
        line
        for part in sorted((tmp_path / "out").glob("part-*"))
        for line in part.read_text().splitlines()
    ]
    assert written == [
        "",
        '1: 2024-01-01 * "First" #a #b',
        "  Assets:A 5.56 USD",
        "",
        '0: 2024-01-02 * "Second" ',
        "  Assets:A 2.00 ABC @@ 30.00 USD",
        "  Assets:B -30.00 USD",
        "Nothing",
        "Nothing",
    ]


def test_verifications(spark, bag):
    day = date(2024, 1, 31)
    rows = [
        (1, 0, day, 0, "Assets:A", None, None),
        (2, 0, day, 1, "Assets:A", Decimal("-1.5"), "USD"),
        (3, 0, day, 2, "Assets:A", None, None),
        (4, 0, day, 1, "Assets:A", None, None),
        (5, 0, day, 0, "Assets:A", Decimal("1"), "USD"),
        (6, 0, day, 3, "Assets:A", None, None),
    ]
    lines, rejects = render_verifications(normalise_verifications(table(spark, rows, VERIFICATIONS)))
    assert bag(lines, "line") == [
        ("2024-01-31 balance Assets:A -1.50 USD",),
        ("2024-01-31 close Assets:A",),
        ("2024-01-31 open Assets:A",),
    ]
    assert bag(rejects, "action") == [(0,), (1,), (3,)]
