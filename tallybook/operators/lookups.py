"""Lookups with a fallback: description to symbol, account id to name, client to owner.

No lookup is forced to be broadcast. Catalyst broadcasts the table when its size is
under ``spark.sql.autoBroadcastJoinThreshold`` and otherwise sort-merges, where
adaptive execution splits a key that many rows share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.accounts import as_column
from tallybook.operators.rules import MISSING_ACTIVITY_SYMBOL


def look_up(
    rows: DataFrame, table: DataFrame, on: str, into: str, default: Column | str
) -> DataFrame:
    """Add column ``into``: the table's ``value`` for ``key`` = ``on``, else ``default``.

    The table holds one row per key, as ``sources.lookups`` returns it.
    """
    entries = table.select(F.col("key").alias("_key"), F.col("value").alias("_value"))
    return (
        rows.join(entries, F.col(on) == F.col("_key"), "left")
        .withColumn(into, F.coalesce("_value", as_column(default)))
        .drop("_key", "_value")
    )


def add_symbols(
    rows: DataFrame, symbols: DataFrame, missing: str = MISSING_ACTIVITY_SYMBOL
) -> DataFrame:
    """Add ``symbol`` for a security's ``description``."""
    return look_up(rows, symbols, "description", "symbol", missing)


def name_accounts(rows: DataFrame, accounts: DataFrame) -> DataFrame:
    """Replace account ids that have a name by the name."""
    return look_up(rows, accounts, "account", "account", F.col("account"))


def add_owners(rows: DataFrame, owners: DataFrame, default: str = "UNKNOWN") -> DataFrame:
    """Add ``owner`` for a statement's ``client_name``."""
    return look_up(rows, owners, "client_name", "owner", default)
