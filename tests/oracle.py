"""Compare registered queries with their SQL, value by value."""

from __future__ import annotations

import datetime
from collections import Counter
from decimal import Decimal

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return connection


def _plain(value):
    if isinstance(value, Decimal):
        return format(value.normalize(), "f") if value else "0"
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def _bag(columns, rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def differences(df, connection, sql: str) -> dict:
    """Empty when the query and the SQL give the same rows under the same names."""
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    expected = _bag(names, cursor.fetchall())
    actual = _bag(df.columns, df.collect())
    found = {}
    if sorted(names) != sorted(df.columns):
        found["columns"] = (sorted(df.columns), sorted(names))
    if actual != expected:
        found["only in query"] = list((actual - expected).items())[:4]
        found["only in sql"] = list((expected - actual).items())[:4]
        found["counts"] = (sum(actual.values()), sum(expected.values()))
    elif not expected:
        found["empty"] = True
    return found
