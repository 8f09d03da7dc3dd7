"""The four brokerage exports: typed rows, rejects, and their expansion to postings.

Input rows hold the export's text columns under the names in ``sources.csv``, plus
``row_no``. Each ``import_*`` returns a ``Book``; ``rejects`` are rows that could
not be decoded, ``skipped`` rows that were decoded but make no posting.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.accounts import account_by_kind, account_name, as_column
from tallybook.functions.dates import month_first, year_first
from tallybook.functions.money import (
    force_negative,
    force_positive,
    parse_money,
    price_times_quantity,
    rescale,
    reverse_sign,
)
from tallybook.functions.text import strip
from tallybook.model import ACTION_BALANCE, RAW, Book
from tallybook.operators.legs import emit, leg, with_legs
from tallybook.operators.lookups import add_owners, add_symbols
from tallybook.operators.rules import (
    ACTIVITY_CODES,
    CLOSED_CODES,
    MISSING_ACTIVITY_SYMBOL,
    MISSING_SYMBOL,
    US_PREFIXES,
    Rule,
    of_rule,
    rule_by_code,
    rule_by_prefix,
)


def _judge(rows: DataFrame, faults: Sequence[tuple[Column, str]]) -> DataFrame:
    """Add ``reason``: the first fault of the row, null when it is in order."""
    checks = list(faults)
    if "malformed" in rows.columns:
        checks.insert(0, (F.col("malformed"), "wrong number of fields"))
    return rows.withColumn(
        "reason", F.coalesce(*[F.when(fault, F.lit(text)) for fault, text in checks])
    )


def _refused(rows: DataFrame, original: Sequence[str]) -> DataFrame:
    return rows.filter(F.col("reason").isNotNull()).select(*original, "reason")


def _not_a_number(name: str) -> tuple[Column, str]:
    return F.col(f"{name}_value").isNull(), f"{name} is not a number"


def _with_values(rows: DataFrame, *names: str) -> DataFrame:
    return rows.withColumns({f"{name}_value": parse_money(F.col(name)) for name in names})


def _with_rule(rows: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Add the fields of the row's rule. A refused row has no template, hence no legs."""
    fields = {
        name: of_rule(F.col("rule"), rules, name) for name in ("counter", "currency", "display")
    }
    template = F.when(F.col("reason").isNull(), of_rule(F.col("rule"), rules, "template"))
    return rows.withColumns({**fields, "template": template})


def _book(rows: DataFrame, rejects: DataFrame, original: Sequence[str], consecutive: bool) -> Book:
    transactions, postings, skipped = emit(rows, original, consecutive)
    return Book(transactions, postings, rejects=rejects, skipped=skipped)


def import_us(
    rows: DataFrame,
    account: Column | str,
    owner: Column | str,
    currency: Column | str,
    consecutive: bool = False,
) -> Book:
    """US brokerage rows, classified by how their description starts.

    Cash amounts are signed, quantities are not. A quantity that is not a number
    stays visible as zero units of a commodity named after the error. A settlement
    date that cannot be read leaves the row without postings.
    """
    original = rows.columns
    rows = _with_values(rows, "net_amount").withColumns(
        {
            "rule": rule_by_prefix(F.col("description")),
            "date": month_first(F.col("settlement_date")),
            "units": parse_money(F.col("quantity")),
        }
    )
    rows = _judge(rows, [_not_a_number("net_amount")])
    rejects = _refused(rows, original)

    security = F.when(F.col("security_id") == "", MISSING_SYMBOL).otherwise(F.col("security_id"))
    is_sale = F.col("template") == "sell"
    rows = _with_rule(rows, US_PREFIXES).withColumns(
        {
            "amount": rescale(F.col("net_amount_value")),
            "template": F.when(F.col("date").isNotNull(), F.col("template")),
            "commodity": F.when(
                F.col("units").isNull(), F.concat(F.lit("Error"), "quantity", F.lit(" "), security)
            ).otherwise(security),
            "units": rescale(F.coalesce("units", F.lit(0).cast(RAW))),
            "narration": strip(F.concat("description", F.lit("-"), "details")),
        }
    )
    amount, has_symbol = F.col("amount"), F.col("security_id") != ""
    units = F.when(is_sale, force_negative(F.col("units"))).otherwise(F.col("units"))
    cost = F.when(~is_sale, force_positive(amount)), F.when(~is_sale, as_column(currency))
    trades = F.col("template").isin("buy", "sell") & has_symbol
    moves_securities = (F.col("template") == "transfer") & has_symbol
    only_cash = (F.col("template") == "cash") | ((F.col("template") == "transfer") & ~has_symbol)
    rows = with_legs(
        rows,
        [
            (
                trades | moves_securities,
                leg(account_name("Securities", owner, account), (units, F.col("commodity")), cost),
            ),
            (trades | only_cash, leg(account_name("Cash", owner, account), (amount, currency))),
            (
                (is_sale & has_symbol) | moves_securities | only_cash,
                leg(account_by_kind(F.col("counter"), owner)),
            ),
        ],
    )
    return _book(rows, rejects, original, consecutive)


def import_activities(
    rows: DataFrame,
    symbols: DataFrame,
    account: Column | str,
    owner: Column | str,
    currency: Column | str,
    missing: str = MISSING_ACTIVITY_SYMBOL,
    consecutive: bool = False,
) -> Book:
    """Canadian activity rows; securities are found by description in ``symbols``."""
    original = rows.columns
    rows = _with_values(rows, "price", "quantity", "amount").withColumns(
        {
            "rule": rule_by_code(F.col("tran_types"), ACTIVITY_CODES),
            "date": year_first(F.col("settled")),
        }
    )
    # Only these two have a cost that is not in the row.
    costs = of_rule(F.col("rule"), ACTIVITY_CODES, "template").isin("transfer", "reinvest")
    cost = F.when(costs, price_times_quantity(F.col("price_value"), F.col("quantity_value")))
    numbers = F.col("price_value").isNotNull() & F.col("quantity_value").isNotNull()
    rows = rows.withColumn("product", cost)
    cost = F.col("product")
    rows = _judge(
        rows,
        [
            (F.col("rule").isNull(), "unknown transaction type"),
            _not_a_number("price"),
            _not_a_number("quantity"),
            _not_a_number("amount"),
            (F.col("date").isNull(), "settled is not a date"),
            (costs & numbers & cost.isNull(), "cost too large"),
        ],
    )
    rejects = _refused(rows, original)
    rows = _with_rule(add_symbols(rows, symbols, missing), ACTIVITY_CODES).withColumns(
        {
            "cash_amount": rescale(F.col("amount_value")),
            "units": rescale(F.col("quantity_value")),
            "cost": force_positive(cost),
            "used_currency": F.coalesce("currency", as_column(currency)),
            "narration": F.concat("display", F.lit(":"), "description"),
        }
    )
    template, amount, used = F.col("template"), F.col("cash_amount"), F.col("used_currency")
    trades, is_sale = template.isin("buy", "sell"), template == "sell"
    is_transfer, reinvests = template == "transfer", template == "reinvest"
    only_cash = template == "cash"
    cash = leg(account_name("Cash", owner, account), (amount, used))
    cost = F.when(template == "buy", force_positive(amount)).when(
        is_transfer | reinvests, F.col("cost")
    )
    rows = with_legs(
        rows,
        [
            (is_transfer & (F.col("amount_value") != 0), cash),
            (
                trades | reinvests | (is_transfer & (F.col("quantity_value") != 0)),
                leg(
                    account_name("Securities", owner, account),
                    (F.col("units"), F.col("symbol")),
                    (cost, F.when(~is_sale, used)),
                ),
            ),
            (trades | only_cash, cash),
            (
                is_sale | only_cash | is_transfer | reinvests,
                leg(
                    account_by_kind(F.col("counter"), owner),
                    (F.when(reinvests, reverse_sign(F.col("cost"))), F.when(reinvests, used)),
                ),
            ),
        ],
    )
    return _book(rows, rejects, original, consecutive)


def import_closed(
    rows: DataFrame,
    account: Column | str,
    owner: Column | str,
    currency: Column | str,
    consecutive: bool = False,
) -> Book:
    """Closed-account rows. A positive amount there means cash going out."""
    original = rows.columns
    rows = _judge_closed(rows)
    rejects = _refused(rows, original)
    has_symbol = F.col("symbol") != ""
    rows = _with_rule(rows, CLOSED_CODES).withColumns(
        {
            "cash_amount": reverse_sign(rescale(F.col("amount_value"))),
            "units": rescale(F.col("quantity_value")),
            "at_cost": force_positive(rescale(F.col("cost_value"))),
            "commodity": F.when(has_symbol, F.col("symbol")).otherwise(MISSING_SYMBOL),
            "used_currency": F.coalesce("currency", as_column(currency)),
            "narration": strip(F.concat("tran", F.lit(" - "), "description")),
        }
    )
    template, used = F.col("template"), F.col("used_currency")
    is_sale, is_transfer, is_dividend = (
        template == "sell",
        template == "transfer",
        template == "dividend",
    )
    trades = template.isin("buy", "sell") & has_symbol
    pays = F.col("amount_value") != 0
    moves_securities = (is_transfer & has_symbol) | (
        is_dividend & ~pays & (F.col("cost_value") != 0)
    )
    only_cash = (template == "cash") | (is_transfer & ~has_symbol) | (is_dividend & pays)
    rows = with_legs(
        rows,
        [
            (
                trades | moves_securities,
                leg(
                    account_name("Securities", owner, account),
                    (F.col("units"), F.col("commodity")),
                    (F.when(~is_sale, F.col("at_cost")), F.when(~is_sale, used)),
                ),
            ),
            (
                trades | only_cash,
                leg(account_name("Cash", owner, account), (F.col("cash_amount"), used)),
            ),
            (
                (is_sale & has_symbol) | moves_securities | only_cash,
                leg(account_by_kind(F.col("counter"), owner)),
            ),
        ],
    )
    return _book(rows, rejects, original, consecutive)


def closed_commodities(rows: DataFrame) -> DataFrame:
    """(symbol, description) of every accepted closed-account row that names a symbol.

    Whether the row makes postings does not matter.
    """
    accepted = _judge_closed(rows).filter(F.col("reason").isNull())
    return accepted.select(strip(F.col("symbol")).alias("symbol"), "description").filter(
        F.col("symbol") != ""
    )


def _judge_closed(rows: DataFrame) -> DataFrame:
    rows = _with_values(rows, "quantity", "cost", "price", "amount").withColumns(
        {"rule": rule_by_code(F.col("tran"), CLOSED_CODES), "date": year_first(F.col("settle_date"))}
    )
    return _judge(
        rows,
        [
            (F.col("rule").isNull(), "unknown transaction type"),
            _not_a_number("quantity"),
            _not_a_number("cost"),
            _not_a_number("price"),
            _not_a_number("amount"),
            (F.col("date").isNull(), "settle_date is not a date"),
        ],
    )


def import_holdings(
    rows: DataFrame, owners: DataFrame, date: Column | str, currency: Column | str
) -> tuple[DataFrame, DataFrame]:
    """(balance assertions, rejects) of holdings rows.

    A cash holding is counted in its fund, or in ``currency`` if it names none. The
    book value is not used, but a row whose book value cannot be read is rejected.
    """
    original = rows.columns
    rows = _with_values(rows, "quantity", "book_value")
    rows = _judge(rows, [_not_a_number("quantity"), _not_a_number("book_value")])
    rejects = _refused(rows, original)
    rows = add_owners(rows.filter(F.col("reason").isNull()), owners)
    is_cash = F.col("holding") == "CASH"
    owner, number = F.col("owner"), F.col("account_number")
    balances = rows.select(
        F.col("row_no").alias("statement_no"),
        F.lit(0).cast("long").alias("file_no"),
        as_column(date).cast("date").alias("date"),
        F.lit(ACTION_BALANCE).alias("action"),
        F.when(is_cash, account_name("Cash", owner, number))
        .otherwise(account_name("Securities", owner, number))
        .alias("account"),
        F.col("quantity_value").alias("quantity"),
        F.when(is_cash & (F.col("fund") != ""), F.col("fund"))
        .when(is_cash, as_column(currency))
        .otherwise(F.col("symbol"))
        .alias("commodity"),
    )
    return balances, rejects
