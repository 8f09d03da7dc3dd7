"""What an import brought in."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.model import Book


def import_summary(book: Book) -> DataFrame:
    """One row: numbers of transactions, postings and balances."""
    tables = {
        "transactions": book.transactions,
        "postings": book.postings,
        "balances": book.verifications,
    }
    tagged = reduce(
        DataFrame.unionByName,
        [
            table.select(F.lit(name).alias("what"))
            for name, table in tables.items()
            if table is not None
        ],
    )
    return tagged.agg(
        *[F.count(F.when(F.col("what") == name, True)).alias(name) for name in tables]
    )
