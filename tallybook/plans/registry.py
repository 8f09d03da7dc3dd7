"""Every operator as a named query over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.accounts import PATTERNS, account_by_kind
from tallybook.functions.money import parse_money
from tallybook.model import Book
from tallybook.operators import brokerage
from tallybook.operators.accounts import account_hierarchy, commodities
from tallybook.operators.balances import account_totals, account_totals_from_raw, balances_from_raw
from tallybook.operators.complete import (
    balancing_rows,
    complete_transactions,
    find_imbalances,
    imbalances,
    normalise_verifications,
)
from tallybook.operators.legs import default_cost_to_units
from tallybook.operators.lookups import add_owners, add_symbols, name_accounts
from tallybook.operators.reconcile import date_postings, reconcile, shares
from tallybook.operators.render import render_transactions, render_verifications
from tallybook.operators.scan_qfx import scan_qfx
from tallybook.operators.scan_text import scan_text, transactions_without_postings
from tallybook.operators.summary import import_summary
from tallybook.plans import star as S
from tallybook.plans.books import shared_folder
from tallybook.plans.star import Star
from tallybook.sinks.tables import staging_parts
from tallybook.sources.lookups import lookup_table

ACCOUNT, OWNER, CURRENCY = "U100", "Owner", "USD"
#: Items that reconciling takes in a pass, and how many passes it makes at most: each reads all items.
_ROWS_PER_PASS, _MOST_PASSES = 15_000_000, 3


def _us(star: Star) -> Book:
    return brokerage.import_us(S.us_rows(star), ACCOUNT, OWNER, CURRENCY)


def _activities(star: Star) -> Book:
    return brokerage.import_activities(
        S.activity_rows(star), S.symbols(star), ACCOUNT, OWNER, "CAD"
    )


def _closed(star: Star) -> Book:
    return brokerage.import_closed(S.closed_rows(star), ACCOUNT, OWNER, "CAD")


def _owners(star: Star) -> DataFrame:
    return lookup_table(star.spark, S.OWNERS.items())


def _holdings(star: Star) -> tuple[DataFrame, DataFrame]:
    return brokerage.import_holdings(S.holdings_rows(star), _owners(star), "2024-01-31", "USD")


def _folder(star: Star, name: str) -> str | None:
    """A folder for what a scan stages, if the session names a place for it."""
    return shared_folder(star.spark, name) if star.spark.conf.get("spark.checkpoint.dir", None) else None


def _book(star: Star, *tables: str) -> Book:
    return scan_text(S.book_lines(star), _folder(star, "lines"), tables)


def _qfx(star: Star) -> Book:
    return scan_qfx(S.statement_tags(star), S.account_names(star), consecutive=True, folder=_folder(star, "tags"))


def _completed(star: Star) -> DataFrame:
    return complete_transactions(S.postings(star))


def _reconciled(star: Star) -> DataFrame:
    folder = _folder(star, "reconciled")
    if folder is None:
        return reconcile(
            _completed(star),
            S.transactions(star),
            complete_transactions(S.other_postings(star)),
            S.other_transactions(star),
        )
    passes = min(_MOST_PASSES, 1 + star.rows("lineitem") // _ROWS_PER_PASS)
    # Passes bound what a task holds, so tables need not be dealt for that.
    star = replace(star, rows_per_task=None)
    return reconcile(
        [complete_transactions(part) for part in shares(S.postings(star), passes, "transaction_no")],
        S.transactions(star),
        [complete_transactions(part) for part in shares(S.other_postings(star), passes, "transaction_no")],
        S.other_transactions(star),
        staging_parts(star.spark, folder),
    )


def _scanned_postings(star: Star) -> DataFrame:
    book = _book(star, "transactions", "postings")
    headers = book.transactions.select(F.col("statement_no").alias("transaction_no"), "narration")
    return book.postings.join(headers, "transaction_no").select(
        "narration", "account", "cp_quantity", "cp_commodity", "tc_quantity", "tc_commodity"
    )


def _money(star: Star) -> DataFrame:
    return S.us_rows(star).select(
        "row_no", "net_amount", parse_money(F.col("net_amount")).alias("amount")
    )


def _account_names(star: Star) -> DataFrame:
    kinds = F.array(*[F.lit(kind) for kind in PATTERNS])
    return star.customer.select(
        "c_custkey", F.explode(kinds).alias("kind"), F.col("c_mktsegment").alias("owner")
    ).select(
        "c_custkey",
        "kind",
        account_by_kind(
            F.col("kind"), F.col("owner"), F.concat(F.lit("A"), F.col("c_custkey").cast("string"))
        ).alias("account"),
    )


def _symbol_lookup(star: Star) -> DataFrame:
    return add_symbols(S.activity_rows(star), S.symbols(star)).select(
        "row_no", "description", "symbol"
    )


def _account_lookup(star: Star) -> DataFrame:
    ids = star.customer.select("c_custkey", F.col("c_custkey").cast("string").alias("account"))
    return name_accounts(ids, S.account_names(star)).select("c_custkey", "account")


def _owner_lookup(star: Star) -> DataFrame:
    return add_owners(S.holdings_rows(star), _owners(star)).select(
        "row_no", "client_name", "owner"
    )


def _rejects(star: Star) -> DataFrame:
    parts = {
        "us": _us(star).rejects,
        "activities": _activities(star).rejects,
        "closed": _closed(star).rejects,
        "holdings": _holdings(star)[1],
    }
    tagged = [
        rejects.select(F.lit(name).alias("export"), "row_no", "reason")
        for name, rejects in parts.items()
    ]
    first, *rest = tagged
    for other in rest:
        first = first.unionByName(other)
    return first


def _summary(star: Star) -> DataFrame:
    book = _activities(star)
    return import_summary(
        Book(book.transactions, book.postings, verifications=_holdings(star)[0])
    )


def _qfx_postings(star: Star) -> DataFrame:
    return _qfx(star).postings


_QUERIES: dict[str, Callable[[Star], DataFrame]] = {
    # tables derived from the star schema
    "fx_transactions": S.transactions,
    "fx_postings": S.postings,
    # completing and balancing
    "complete_transactions": _completed,
    "balancing_rows": lambda s: balancing_rows(S.postings(s)),
    "imbalances": lambda s: imbalances(S.postings(s)),
    "imbalances_of_completed": lambda s: find_imbalances(_completed(s)),
    "normalise_verifications": lambda s: normalise_verifications(S.verifications(s)),
    "default_cost_to_units": lambda s: default_cost_to_units(S.postings(s)),
    # accounts, commodities, balances
    "account_hierarchy": lambda s: account_hierarchy(S.postings(s)),
    "commodities_cp": lambda s: commodities(_completed(s), "cp"),
    "commodities_tc": lambda s: commodities(_completed(s), "tc"),
    "account_totals_tc": lambda s: account_totals(_completed(s), "tc"),
    "account_totals_cp": lambda s: account_totals_from_raw(S.postings(s), "cp"),
    "balances_tc": lambda s: balances_from_raw(S.postings(s), "tc"),
    "balances_cp": lambda s: balances_from_raw(S.postings(s), "cp"),
    # two books
    "dated_postings": lambda s: date_postings(_completed(s), S.transactions(s)),
    "reconcile_books": _reconciled,
    # statement exports
    "us_transactions": lambda s: _us(s).transactions,
    "us_postings": lambda s: _us(s).postings,
    "us_skipped": lambda s: _us(s).skipped.select("row_no", "description"),
    "activities_transactions": lambda s: _activities(s).transactions,
    "activities_postings": lambda s: _activities(s).postings,
    "closed_transactions": lambda s: _closed(s).transactions,
    "closed_postings": lambda s: _closed(s).postings,
    "holdings_balances": lambda s: _holdings(s)[0],
    "import_rejects": _rejects,
    "import_summary": _summary,
    "commodity_side_output": lambda s: brokerage.closed_commodities(S.closed_rows(s)),
    "symbol_lookup": _symbol_lookup,
    "account_lookup": _account_lookup,
    "owner_lookup": _owner_lookup,
    "money_parse": _money,
    "account_names": _account_names,
    # text out
    "render_transactions": lambda s: render_transactions(S.transactions(s), _completed(s)),
    "render_verifications": lambda s: render_verifications(
        normalise_verifications(S.verifications(s))
    )[0],
    "render_verification_rejects": lambda s: render_verifications(
        normalise_verifications(S.verifications(s))
    )[1],
    # text in
    "scan_text_transactions": lambda s: _book(s, "transactions").transactions.drop("file_no"),
    "scan_text_postings": _scanned_postings,
    "scan_text_verifications": lambda s: _book(s, "verifications").verifications,
    "scan_text_info": lambda s: _book(s, "informationals").informationals.drop("statement_no"),
    "scan_text_includes": lambda s: _book(s, "includes").includes.select("path"),
    "scan_text_rejects": lambda s: _book(s, "rejects").rejects.select("line", "reason"),
    "scan_text_empty_headers": lambda s: transactions_without_postings(_book(s, "transactions", "postings")).select(
        "date", "narration", "tags"
    ),
    # bank statements
    "qfx_transactions": lambda s: _qfx(s).transactions,
    "qfx_postings": _qfx_postings,
    "qfx_balances": lambda s: _qfx(s).verifications,
    "qfx_rejects": lambda s: _qfx(s).rejects.select("account", "reason"),
}


def _bind(query: Callable[[Star], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: query(Star(spark, folder))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(query) for name, query in _QUERIES.items()}
