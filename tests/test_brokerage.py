"""Brokerage CSV files: every template, rejects, numbering and lookups."""

from datetime import date

import pytest

from tallybook.functions.money import parse_money, price_times_quantity
from tallybook.operators.summary import import_summary
from tallybook.plans import books
from tallybook.sinks.text import append_commodities
from tallybook.sources.csv import ACTIVITY_COLUMNS, CLOSED_COLUMNS, HOLDINGS_COLUMNS, US_COLUMNS
from tallybook.sources.lookups import lookup_table, read_account_names, read_symbols

POSTED = ("account", "cp_quantity", "cp_commodity", "tc_quantity", "tc_commodity")
CASH = "Assets:Investments:Me:9:Cash"
SEC = "Assets:Investments:Me:9:Securities"
TODO = "Assets:Investments:Me:TODO"


def income(kind):
    return f"Income:Investments:Me:Taxable:{kind}"


def write_csv(path, columns, rows, extra=()):
    """Rows as dicts by our column name; ``extra`` lines are added as they are."""

    def cell(value):
        return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n') else value

    lines = [",".join(columns)]
    for row in rows:
        lines.append(",".join(cell(row.get(name, "")) for name in columns.values()))
    path.write_text("\n".join([*lines, *extra]) + "\n")
    return str(path)


def legs_by_transaction(book, bag):
    out = {}
    for number, place, *leg in bag(book.postings, "transaction_no", "statement_no", *POSTED):
        out.setdefault(number, []).append((place, tuple(leg)))
    return [[leg for _, leg in sorted(out[number])] for number in sorted(out)]


def us(description, symbol="ABC", amount="-100.00", quantity="2", day="1-5-2024", details=""):
    return {
        "description": description,
        "security_id": symbol,
        "net_amount": amount,
        "quantity": quantity,
        "settlement_date": day,
        "details": details,
    }


@pytest.fixture(scope="module")
def us_book(spark, tmp_path_factory):
    rows = [
        us("BUY ABC", amount="-$1,234.5675", quantity="1,000.0005", details="x"),
        us("SELL ABC", amount="50", quantity="2"),
        us("SELL ABC", symbol=""),
        us("CASH DIVIDEND RECEIVED now", amount="3.5"),
        us("YOUR ASSET TRANSFERRED", symbol="", amount="7"),
        us("YOUR ASSET TRANSFERRED", amount="-7"),
        us("FOREIGN TAX WITHHELD AT   THE SOURCE", amount="-1"),
        us("FOREIGN TAX WITHHELD AT THE SOURCE", amount="-1"),
        us("BUY ABC", quantity="two"),
        us("BUY ABC", day="2024-01-05"),
        us("ADVISORY FEES", amount="none"),
        us("MAINTENANCE FEE", amount="-9"),
    ]
    path = write_csv(tmp_path_factory.mktemp("us") / "us.csv", US_COLUMNS, rows, ["1,2,3"])
    return books.us_book(spark, path, "9", "Me", "USD", consecutive=True)


def test_us_legs(us_book, bag):
    assert legs_by_transaction(us_book, bag) == [
        [(SEC, "1000.001", "ABC", "1234.568", "USD"), (CASH, "-1234.568", "USD", None, None)],
        [
            (SEC, "-2", "ABC", None, None),
            (CASH, "50", "USD", None, None),
            (income("GainLoss"), None, None, None, None),
        ],
        [(CASH, "3.5", "USD", None, None), (income("Dividend"), None, None, None, None)],
        [(CASH, "7", "USD", None, None), (TODO, None, None, None, None)],
        [(SEC, "2", "ABC", "7", "USD"), (TODO, None, None, None, None)],
        [(CASH, "-1", "USD", None, None), ("Expenses:Investments:Me:ForeignTax", None, None, None, None)],
        [(SEC, "0", "Errortwo ABC", "100", "USD"), (CASH, "-100", "USD", None, None)],
        [(CASH, "-9", "USD", None, None), ("Expenses:Investments:Me:Fees", None, None, None, None)],
    ]


def test_us_numbers_count_headers_legs_and_skipped_rows(us_book, bag):
    numbers = [row[0] for row in bag(us_book.transactions, "statement_no")]
    # buy 0-2, sell 3-6, skipped 7, dividend 8-10, … as rows stand in the file
    assert sorted(numbers) == [0, 3, 8, 11, 14, 17, 21, 25]
    first = us_book.transactions.orderBy("statement_no").first()
    assert (first["date"], first["narration"]) == (date(2024, 1, 5), "BUY ABC-x")


def test_us_rejects_and_skipped(us_book, bag):
    assert bag(us_book.rejects, "description", "reason") == [
        ("", "wrong number of fields"),
        ("ADVISORY FEES", "net_amount is not a number"),
    ]
    assert bag(us_book.skipped, "description", "settlement_date") == [
        ("BUY ABC", "2024-01-05"),
        ("FOREIGN TAX WITHHELD AT THE SOURCE", "1-5-2024"),
        ("SELL ABC", "1-5-2024"),
    ]
    assert bag(import_summary(us_book)) == [(8, 17, 0)]


def act(code, description="Known", price="2.5", quantity="4", amount="-10.00", day="2024-01-05"):
    return {
        "tran_types": code,
        "description": description,
        "price": price,
        "quantity": quantity,
        "amount": amount,
        "settled": day,
    }


def test_activities(spark, tmp_path, bag):
    rows = [
        act("BUY"),
        act("SELL", description="Unknown", quantity="-4", amount="$1,000.00"),
        act("US CASH DIVIDEND", amount="5"),
        act("INTERNAL TRANSFER"),
        act("INTERNAL TRANSFER", quantity="0"),
        act("INTERNAL TRANSFER", amount="0"),
        act("INTERNAL TRANSFER", amount="0", quantity="0"),
        act("REINVESTED DIVIDEND", price="1.11111111", quantity="-3.33333333"),
        act("MF RETURN OF CAPITAL"),
        act("PARTNERS FEE NON REG'D"),
        act("NO SUCH CODE"),
        act("BUY", price="1e3"),
        act("BUY", day="05/01/2024"),
    ]
    path = write_csv(tmp_path / "a.csv", ACTIVITY_COLUMNS, rows)
    symbols = tmp_path / "symbols.csv"
    symbols.write_text('Known,OLD\n"Quoted",Q\nKnown,NEW\n')
    book = books.activities_book(spark, path, str(symbols), "9", "Me", "CAD")
    assert legs_by_transaction(book, bag) == [
        [(SEC, "4", "NEW", "10", "CAD"), (CASH, "-10", "CAD", None, None)],
        [
            (SEC, "-4", "UNKNOENSEC", None, None),
            (CASH, "1000", "CAD", None, None),
            (income("GainLoss"), None, None, None, None),
        ],
        [(CASH, "5", "USD", None, None), (income("Dividend"), None, None, None, None)],
        [
            (CASH, "-10", "CAD", None, None),
            (SEC, "4", "NEW", "10", "CAD"),
            (TODO, None, None, None, None),
        ],
        [(CASH, "-10", "CAD", None, None), (TODO, None, None, None, None)],
        [(SEC, "4", "NEW", "10", "CAD"), (TODO, None, None, None, None)],
        [(TODO, None, None, None, None)],
        [(SEC, "-3.333", "NEW", "3.704", "CAD"), (income("Dividend"), "-3.704", "CAD", None, None)],
        [(CASH, "-10", "CAD", None, None), ("Expenses:Investments:Me:Fees", None, None, None, None)],
    ]
    assert ("MutualFundDivident:Known",) not in bag(book.transactions, "narration")
    assert ("PartnersFeeNonRegistered:Known",) in bag(book.transactions, "narration")
    assert bag(book.rejects, "tran_types", "reason") == [
        ("BUY", "price is not a number"),
        ("BUY", "settled is not a date"),
        ("NO SUCH CODE", "unknown transaction type"),
    ]
    assert bag(book.skipped, "tran_types") == [("MF RETURN OF CAPITAL",)]


def closed(code, symbol="XYZ", quantity="5", cost="20", amount="30", price="1", day="2024-1-5"):
    return {
        "tran": code,
        "description": "d",
        "symbol": symbol,
        "quantity": quantity,
        "cost": cost,
        "amount": amount,
        "price": price,
        "settle_date": day,
    }


def test_closed(spark, tmp_path, bag):
    rows = [
        closed("BUY"),
        closed("BUY", symbol=""),
        closed("SEL", quantity="-5"),
        closed("CN"),
        closed("GST"),
        closed("ATI", symbol=""),
        closed("TSF", cost="-20"),
        closed("DVR", amount="0"),
        closed("DVR", amount="0", cost="0"),
        closed("DVU", symbol=" "),
        closed("ABC"),
        closed("BUY", price="free"),
    ]
    path = write_csv(tmp_path / "c.csv", CLOSED_COLUMNS, rows)
    book, named = books.closed_book(spark, path, "9", "Me", "CAD")
    assert legs_by_transaction(book, bag) == [
        [(SEC, "5", "XYZ", "20", "CAD"), (CASH, "-30", "CAD", None, None)],
        [
            (SEC, "-5", "XYZ", None, None),
            (CASH, "-30", "CAD", None, None),
            (income("GainLoss"), None, None, None, None),
        ],
        [(CASH, "-30", "CAD", None, None), (TODO, None, None, None, None)],
        [(CASH, "-30", "CAD", None, None), ("Expenses:Investments:Me:Fees", None, None, None, None)],
        [(CASH, "-30", "CAD", None, None), (TODO, None, None, None, None)],
        [(SEC, "5", "XYZ", "20", "CAD"), (TODO, None, None, None, None)],
        [(SEC, "5", "XYZ", "20", "CAD"), (income("Dividend"), None, None, None, None)],
        [(CASH, "-30", "USD", None, None), (income("Dividend"), None, None, None, None)],
    ]
    # Rows without postings still name their commodity; rejected and blank ones do not.
    assert bag(named) == [("XYZ", "d")] * 7
    append_commodities(named, str(tmp_path / "named"))
    append_commodities(named, str(tmp_path / "named"))
    assert spark.read.text(str(tmp_path / "named")).count() == 14


def test_holdings(spark, tmp_path, bag):
    rows = [
        {"client_name": "P", "account_number": "1", "holding": "CASH", "fund": "", "quantity": "$1,5", "book_value": "1"},
        {"client_name": "P", "account_number": "1", "holding": "CASH", "fund": "CAD", "quantity": "2", "book_value": "1"},
        {"client_name": "Q", "account_number": "2", "holding": "x", "symbol": "S", "fund": "F", "quantity": "3", "book_value": "1"},
        {"client_name": "Q", "account_number": "2", "holding": "x", "symbol": "S", "quantity": "3", "book_value": ""},
    ]
    path = write_csv(tmp_path / "h.csv", HOLDINGS_COLUMNS, rows)
    owners = lookup_table(spark, [("P", "Pat")])
    balances, rejects = books.holdings_balances(spark, path, owners, "2024-01-31", "USD")
    assert bag(balances, "account", "quantity", "commodity") == [
        ("Assets:Investments:Pat:1:Cash", "15", "USD"),
        ("Assets:Investments:Pat:1:Cash", "2", "CAD"),
        ("Assets:Investments:UNKNOWN:2:Securities", "3", "S"),
    ]
    assert bag(rejects, "reason") == [("book_value is not a number",)]


def test_lookup_quotes(spark, tmp_path, bag):
    path = tmp_path / "names.csv"
    path.write_text('"a,b",One\nc,"Two"\nc,Three\n')
    assert bag(read_account_names(spark, str(path)), "key", "value") == [("a,b", "One"), ("c", "Three")]
    path.write_text('"a",One\n')
    assert bag(read_symbols(spark, str(path)), "key", "value") == [('"a"', "One")]


def test_missing_column_is_named(spark, tmp_path):
    (tmp_path / "x.csv").write_text("Settled,Amount\n2024-01-05,1\n")
    with pytest.raises(ValueError, match="Processed"):
        books.read_activities(spark, str(tmp_path / "x.csv"))


@pytest.mark.parametrize(
    "text, value",
    [
        ("$1,234.50", "1234.5"),
        ("-$5", "-5"),
        ("+.5", "0.5"),
        ("5.", "5"),
        ("1e3", None),
        ("", None),
        ("(5)", None),
        ("5 ", None),
    ],
)
def test_parse_money(spark, bag, text, value):
    from pyspark.sql import functions as F

    assert bag(spark.range(1).select(parse_money(F.lit(text)))) == [(value,)]


def test_price_times_quantity_rounds_once(spark, bag):
    from pyspark.sql import functions as F

    def product(price, quantity):
        columns = [F.lit(v).cast("decimal(38,10)") for v in (price, quantity)]
        return bag(spark.range(1).select(price_times_quantity(*columns)))[0][0]

    assert product("0.00499999", "0.09999999") == "0"
    assert product("1.0005", "1") == "1.001"
    assert product("-1.0005", "1") == "-1.001"
    assert product("20000000000", "3") == "60000000000"
