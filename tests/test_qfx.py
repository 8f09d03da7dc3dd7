"""Bank and credit-card statement files."""

from datetime import date

from tallybook.plans import books

HEADER = b"OFXHEADER:100\r\nDATA:OFXSGML\r\nCHARSET:1252\r\n\r\n"


def bank(account, moves, balance="100.00", currency="CAD"):
    return (
        f"<STMTTRNRS><TRNUID>0<STATUS><CODE>0</STATUS><STMTRS><CURDEF>{currency}<BANKACCTFROM>"
        f"<BANKID>1<ACCTID>{account}<ACCTTYPE>CHECKING</BANKACCTFROM><BANKTRANLIST><DTSTART>20240101"
        + "".join(moves)
        + f"</BANKTRANLIST><LEDGERBAL><BALAMT>{balance}<DTASOF>20240131</LEDGERBAL>"
        "<AVAILBAL><BALAMT>1<DTASOF>20240101</AVAILBAL></STMTRS></STMTTRNRS>"
    )


def move(amount, extra="", day="20240105120000[-5:EST]"):
    return f"<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>{day}<TRNAMT>{amount}<FITID>7{extra}</STMTTRN>"


def write(tmp_path, body, encoding="utf-8"):
    path = tmp_path / "s.qfx"
    path.write_bytes(HEADER + body.encode(encoding))
    names = tmp_path / "names.csv"
    names.write_text('001,"Assets:Bank"\n')
    return str(path), str(names)


def test_bank_and_card(spark, tmp_path, bag):
    card = (
        "<CREDITCARDMSGSRSV1><CCSTMTTRNRS><CCSTMTRS><curdef>USD<CCACCTFROM><acctid>C9</CCACCTFROM>"
        "<BANKTRANLIST>" + move("5.5", "<MEMO>only memo") + "</BANKTRANLIST>"
        "<LEDGERBAL><DTASOF>20240201<BALAMT>-7.25</LEDGERBAL></CCSTMTRS></CCSTMTTRNRS></CREDITCARDMSGSRSV1>"
    )
    body = (
        "<OFX><SIGNONMSGSRSV1></SIGNONMSGSRSV1><BANKMSGSRSV1>"
        + bank(
            "001",
            [
                move("-12.50", "<NAME> Tom &amp;amp; Co \r\n<MEMO>a &lt;b&gt;"),
                move("3", "<NAME>n<BANKACCTTO><ACCTID>999</BANKACCTTO>"),
                move("4"),
            ],
        )
        + bank("002", [move("1", "<NAME>x")], balance="0", currency="EUR")
        + "</BANKMSGSRSV1>"
        + card
        + "</OFX>"
    )
    path, names = write(tmp_path, body)
    book = books.statement_book(spark, path, names, consecutive=True)
    assert sorted(bag(book.transactions, "statement_no", "date", "narration")) == [
        (1, date(2024, 1, 5), "Tom &amp; Co / a <b>"),
        (2, date(2024, 1, 5), "n"),
        (3, date(2024, 1, 5), "PROBLEM"),
        (4, date(2024, 1, 5), "x"),
        (5, date(2024, 1, 5), "only memo"),
    ]
    assert sorted(bag(book.postings, "transaction_no", "account", "cp_quantity", "tc_commodity")) == [
        (1, "Assets:Bank", "-12.5", "CAD"),
        (2, "Assets:Bank", "3", "CAD"),
        (3, "Assets:Bank", "4", "CAD"),
        (4, "002", "1", "EUR"),
        (5, "C9", "5.5", "USD"),
    ]
    assert sorted(bag(book.verifications, "statement_no", "date", "account", "quantity", "commodity")) == [
        (6, date(2024, 1, 31), "Assets:Bank", "100", "CAD"),
        (7, date(2024, 1, 31), "002", "0", "EUR"),
        (8, date(2024, 2, 1), "C9", "-7.25", "USD"),
    ]


def test_windows_1252(spark, tmp_path, bag):
    body = "<OFX>" + bank("001", [move("1", "<NAME>Café €5")]) + "</OFX>"
    path, names = write(tmp_path, body, "cp1252")
    book = books.statement_book(spark, path, names, encoding="1252")
    assert bag(book.transactions, "narration") == [("Café €5",)]


def test_unreadable_cells_are_rejects(spark, tmp_path, bag):
    body = "<OFX>" + bank("001", [move("1.x"), move("1", day="2024"), move("2")], balance="") + "</OFX>"
    path, names = write(tmp_path, body)
    book = books.statement_book(spark, path, names)
    assert bag(book.postings, "cp_quantity") == [("2",)]
    assert bag(book.rejects, "account", "reason") == [
        ("Assets:Bank", "amount cannot be read"),
        ("Assets:Bank", "amount cannot be read"),
        ("Assets:Bank", "date cannot be read"),
    ]


def test_one_line_file_is_split(spark, tmp_path, bag):
    moves = [move(str(n), f"<NAME>m{n}") for n in range(500)]
    body = "<OFX>" + bank("001", moves) + bank("002", moves[:100]) + "</OFX>"
    path, names = write(tmp_path, body)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        book = books.statement_book(spark, path, names, consecutive=True)
        got = sorted(bag(book.postings, "transaction_no", "account", "cp_quantity"))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [(n, a, int(float(q))) for n, a, q in got] == [
        (n + 1, "Assets:Bank" if n < 500 else "002", n % 500) for n in range(600)
    ]


def test_reconcile_statement_with_book(spark, tmp_path, bag):
    path, names = write(
        tmp_path, "<OFX>" + bank("001", [move("-12.50"), move("9")], currency="USD") + "</OFX>"
    )
    (tmp_path / "main.book").write_text(
        '2024-01-05 * "Lunch"\n  Assets:Bank -12.5 USD\n  Expenses:Food\n'
    )
    statement = books.verify(books.statement_book(spark, path, names))
    if spark.conf.get("spark.checkpoint.dir", None):
        folder = books.shared_folder(spark, "completed")
        assert folder.startswith(spark.conf.get("spark.checkpoint.dir"))
    else:
        folder = str(tmp_path / "completed")
    own = books.verify(books.text_book(spark, str(tmp_path / "main.book")), folder=folder)
    assert bag(statement.not_in(own), "account", "cp_quantity_final") == [("Assets:Bank", "9")]
    assert own.imbalances.isEmpty()
