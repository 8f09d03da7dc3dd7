"""Table shapes and fixed names shared by every module.

``cp`` is the commodity position of a posting (its units); ``tc`` is its total
cost (the value a transaction has to balance in).
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Account roots, separators and action codes of the book format.
ACCOUNT_ROOTS = ("Assets", "Liabilities", "Equity", "Income", "Expenses")
ACCOUNT_SEP = ":"
COST_SEP = "@@"
TRANSACTION_FLAG = "*"
ACTION_OPEN, ACTION_BALANCE, ACTION_CLOSE = 0, 1, 2
ACTION_EVENT, ACTION_OPTION, ACTION_CUSTOM = 3, 4, 5

#: Raw quantities keep ten decimals; completed quantities keep two.
RAW = "decimal(38,10)"
FINAL = "decimal(38,2)"

TRANSACTIONS = T.StructType(
    [
        T.StructField("statement_no", T.LongType()),
        T.StructField("file_no", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("narration", T.StringType()),
        T.StructField("tags", T.StringType()),
    ]
)

POSTINGS = T.StructType(
    [
        T.StructField("statement_no", T.LongType()),
        T.StructField("transaction_no", T.LongType()),
        T.StructField("file_no", T.LongType()),
        T.StructField("account", T.StringType()),
        T.StructField("cp_quantity", T.DecimalType(38, 10)),
        T.StructField("cp_commodity", T.StringType()),
        T.StructField("tc_quantity", T.DecimalType(38, 10)),
        T.StructField("tc_commodity", T.StringType()),
    ]
)

VERIFICATIONS = T.StructType(
    [
        T.StructField("statement_no", T.LongType()),
        T.StructField("file_no", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("action", T.IntegerType()),
        T.StructField("account", T.StringType()),
        T.StructField("quantity", T.DecimalType(38, 10)),
        T.StructField("commodity", T.StringType()),
    ]
)

INFORMATIONALS = T.StructType(
    [
        T.StructField("statement_no", T.LongType()),
        T.StructField("file_no", T.LongType()),
        T.StructField("date", T.DateType()),
        T.StructField("action", T.IntegerType()),
        T.StructField("attribute", T.StringType()),
        T.StructField("value", T.StringType()),
    ]
)

INCLUDES = T.StructType(
    [
        T.StructField("statement_no", T.LongType()),
        T.StructField("file_no", T.LongType()),
        T.StructField("path", T.StringType()),
    ]
)


class Measure(NamedTuple):
    """Column names of one way to value postings."""

    commodity: str
    quantity: str
    commodity_final: str
    quantity_final: str


def measure(by: str) -> Measure:
    """``cp`` (units) or ``tc`` (cost)."""
    if by not in ("cp", "tc"):
        raise ValueError(f"by must be 'cp' or 'tc', not {by!r}")
    return Measure(
        f"{by}_commodity",
        f"{by}_quantity",
        f"{by}_commodity_final",
        f"{by}_quantity_final",
    )


@dataclass(frozen=True)
class Book:
    """The typed tables one source yields. Every member is lazy."""

    transactions: DataFrame
    postings: DataFrame
    verifications: DataFrame | None = None
    informationals: DataFrame | None = None
    includes: DataFrame | None = None
    rejects: DataFrame | None = None
    skipped: DataFrame | None = None
