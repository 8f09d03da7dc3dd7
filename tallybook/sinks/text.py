"""Text files of rendered lines and of commodity lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.operators.render import LINE_ORDER


def write_lines(
    lines: DataFrame, path: str, order: Sequence[str] = LINE_ORDER, files: int | None = None
) -> None:
    """Write ``line`` in document order; files in name order make the document.

    Lines are range-partitioned on the whole order, text included, so that neither a
    day nor a transaction with very many lines has to fit one task.
    """
    keys = [F.col(name).asc_nulls_last() for name in (*order, "line")]
    ranged = lines.repartitionByRange(files, *keys) if files else lines.repartitionByRange(*keys)
    ranged.sortWithinPartitions(*keys).select("line").write.mode("errorifexists").text(path)


def append_commodities(commodities: DataFrame, path: str) -> None:
    """Append ``symbol,description`` lines, written as they are, without quotes."""
    commodities.select(F.concat_ws(",", "symbol", "description").alias("value")).write.mode(
        "append"
    ).text(path)
