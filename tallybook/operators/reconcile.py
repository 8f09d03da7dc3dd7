"""Compare two books."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MATCH_ON = [
    "date",
    "account",
    "cp_commodity_final",
    "cp_quantity_final",
    "tc_commodity_final",
    "tc_quantity_final",
]


def date_postings(completed: DataFrame, transactions: DataFrame) -> DataFrame:
    """Completed postings with the date of their transaction (null if it has none).

    A transaction with very many postings is a skewed left side of this left join,
    which adaptive execution splits.
    """
    dates = transactions.select(F.col("statement_no").alias("transaction_no"), "date")
    return completed.join(dates, "transaction_no", "left").select("transaction_no", *MATCH_ON)


def shares(table: DataFrame, n: int, *columns: str) -> list[DataFrame]:
    """The rows of a table in ``n`` shares; rows that are equal in these columns are in the same one."""
    share = F.pmod(F.xxhash64(*columns), F.lit(n))
    return [table.filter(share == of) for of in range(n)] if n > 1 else [table]


def _missing(a: DataFrame, b: DataFrame) -> DataFrame:
    # Sorting compares the first column first: a hash tells nearly all rows apart, dates and accounts do not.
    key = F.xxhash64(*MATCH_ON).alias("_key")
    # Not distinct(), which groups, and so sorts, by its columns in an order of its own.
    b = b.select(key, *MATCH_ON).dropna("any").groupBy("_key", *MATCH_ON).count().drop("count")
    a = a.select(key, "transaction_no", *MATCH_ON)
    return a.join(b, ["_key", *MATCH_ON], "left_anti").select("transaction_no", *MATCH_ON)


def reconcile(
    completed_a: DataFrame | Sequence[DataFrame],
    transactions_a: DataFrame,
    completed_b: DataFrame | Sequence[DataFrame],
    transactions_b: DataFrame,
    stage: Callable[[Iterable[DataFrame], str], DataFrame] | None = None,
) -> DataFrame:
    """Postings of book A that book B does not have.

    One-way and set-like: one equal posting in B answers any number in A. A null in
    any compared column never matches. Book B is therefore reduced to distinct rows
    without nulls first, with map-side combining, so copies in B cost nothing in the
    join; the reduction hashes on the join key, and the join reuses that shuffle.

    Postings are shuffled twice, by transaction and by all that is compared. ``stage``
    writes the parts of a table one by one and reads them back as one (see
    ``staging_parts``). With it the completed postings of a book may come in parts, as completed
    from ``shares`` of the raw ones; they are dated, and compared, in as many passes, of which only
    one has its shuffle files on disk.
    """
    if stage is None:
        return _missing(
            date_postings(completed_a, transactions_a), date_postings(completed_b, transactions_b)
        )
    parts_a, parts_b = (
        [completed] if isinstance(completed, DataFrame) else completed
        for completed in (completed_a, completed_b)
    )
    a = stage((date_postings(part, transactions_a) for part in parts_a), "a")
    b = stage((date_postings(part, transactions_b) for part in parts_b), "b")
    passes = max(len(parts_a), len(parts_b))
    pairs = zip(shares(a, passes, *MATCH_ON), shares(b, passes, *MATCH_ON), strict=True)
    return stage((_missing(*pair) for pair in pairs), "missing")
