"""Rows held in memory to a typed table."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def table(spark: SparkSession, rows: Iterable[Sequence[Any]], schema: T.StructType) -> DataFrame:
    """A DataFrame of one of the schemas in ``tallybook.model``."""
    return spark.createDataFrame(list(rows), schema)
