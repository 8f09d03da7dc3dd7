"""What one does with a book: complete it, report on it, import and reconcile statements."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any
from uuid import uuid4

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from tallybook.model import Book
from tallybook.operators import brokerage
from tallybook.operators.accounts import account_hierarchy, commodities
from tallybook.operators.balances import balances
from tallybook.operators.complete import (
    complete_transactions,
    find_imbalances,
    normalise_verifications,
)
from tallybook.operators.reconcile import reconcile
from tallybook.operators.render import render_transactions, render_verifications
from tallybook.operators.scan_qfx import scan_qfx
from tallybook.operators.scan_text import scan_text
from tallybook.sources.csv import read_activities, read_closed, read_holdings, read_us
from tallybook.sources.lookups import read_account_names, read_symbols
from tallybook.sources.qfx import read_tags
from tallybook.sources.text import read_book_lines


@dataclass(frozen=True)
class VerifiedBook:
    """A book with its postings completed. Reports are built when asked for."""

    book: Book
    postings: DataFrame

    @property
    def imbalances(self) -> DataFrame:
        return find_imbalances(self.postings)

    @property
    def accounts(self) -> DataFrame:
        return account_hierarchy(self.postings)

    def commodities(self, by: str) -> DataFrame:
        return commodities(self.postings, by)

    def balances(self, by: str) -> DataFrame:
        return balances(self.postings, by)

    def transaction_lines(self, numbered: bool = True) -> DataFrame:
        return render_transactions(self.book.transactions, self.postings, numbered)

    def verification_lines(self) -> tuple[DataFrame, DataFrame]:
        """(lines, rejects)."""
        if self.book.verifications is None:
            raise ValueError("this source makes no assertions")
        return render_verifications(normalise_verifications(self.book.verifications))

    def not_in(self, other: VerifiedBook) -> DataFrame:
        """Postings of this book that ``other`` lacks."""
        return reconcile(
            self.postings, self.book.transactions, other.postings, other.book.transactions
        )


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder for a staged table, under the one ``spark.checkpoint.dir`` names."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        raise ValueError("spark.checkpoint.dir names no shared folder; pass a folder yourself")
    return f"{base.rstrip('/')}/{name}-{uuid4().hex}"


def verify(book: Book, keep: bool = False, folder: str | None = None) -> VerifiedBook:
    """Complete a book.

    Several reports over one book each read its completed postings. ``keep`` persists
    them, spilling to disk; ``folder`` (see ``shared_folder``) writes them to a table
    and reads that, which also cuts the lineage.
    """
    completed = complete_transactions(book.postings)
    if folder is not None:
        completed.write.mode("errorifexists").parquet(folder)
        completed = completed.sparkSession.read.parquet(folder)
    elif keep:
        completed = completed.persist(StorageLevel.MEMORY_AND_DISK)
    return VerifiedBook(book, completed)


def text_book(spark: SparkSession, path: str, folder: str | None = None) -> Book:
    """A plain-text book with everything it includes.

    ``folder`` stages the classified lines, so that several tables of a large book
    cost one scan of its text.
    """
    return scan_text(read_book_lines(spark, path), folder)


def us_book(
    spark: SparkSession,
    paths: str | Sequence[str],
    account: str,
    owner: str,
    currency: str,
    multiline: bool = False,
    folder: str | None = None,
    **options: Any,
) -> Book:
    """``multiline`` and ``folder`` go to the reader, ``options`` to the importer."""
    rows = read_us(spark, paths, multiline=multiline, folder=folder)
    return brokerage.import_us(rows, account, owner, currency, **options)


def activities_book(
    spark: SparkSession,
    paths: str | Sequence[str],
    symbol_paths: str | Sequence[str],
    account: str,
    owner: str,
    currency: str,
    multiline: bool = False,
    folder: str | None = None,
    **options: Any,
) -> Book:
    return brokerage.import_activities(
        read_activities(spark, paths, multiline=multiline, folder=folder),
        read_symbols(spark, symbol_paths),
        account,
        owner,
        currency,
        **options,
    )


def closed_book(
    spark: SparkSession,
    paths: str | Sequence[str],
    account: str,
    owner: str,
    currency: str,
    multiline: bool = False,
    folder: str | None = None,
    **options: Any,
) -> tuple[Book, DataFrame]:
    """The book, and the (symbol, description) pairs of its rows."""
    rows = read_closed(spark, paths, multiline=multiline, folder=folder)
    return (
        brokerage.import_closed(rows, account, owner, currency, **options),
        brokerage.closed_commodities(rows),
    )


def holdings_balances(
    spark: SparkSession,
    paths: str | Sequence[str],
    owners: DataFrame,
    date: str,
    currency: str,
    multiline: bool = False,
    folder: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(balance assertions, rejects)."""
    rows = read_holdings(spark, paths, multiline=multiline, folder=folder)
    return brokerage.import_holdings(rows, owners, date, currency)


def statement_book(
    spark: SparkSession,
    paths: str | Sequence[str],
    account_paths: str | Sequence[str],
    encoding: str | None = None,
    consecutive: bool = False,
    folder: str | None = None,
) -> Book:
    """Bank and credit-card statements. ``folder`` stages the placed tags and the entries."""
    return scan_qfx(read_tags(spark, paths, encoding), read_account_names(spark, account_paths), consecutive, folder)
