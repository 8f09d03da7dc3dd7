"""Date text in the three layouts statements use. Bad text gives null.

Each layout is brought to year-month-day and cast, which stays in generated code; a
format string would go through a formatter object for every row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def year_first(text: Column) -> Column:
    """``2024-01-05`` or ``2024-1-5``."""
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), text.try_cast("date"))


def month_first(text: Column) -> Column:
    """``1-5-2024`` or ``01-05-2024``."""
    layout = r"^(\d{1,2}-\d{1,2})-(\d{4})$"
    return F.when(text.rlike(layout), F.regexp_replace(text, layout, "$2-$1").try_cast("date"))


def compact(text: Column) -> Column:
    """The first eight characters as ``20240105``; a time after them is ignored."""
    return F.when(
        text.rlike(r"^\d{8}"),
        F.concat_ws(
            "-", F.substring(text, 1, 4), F.substring(text, 5, 2), F.substring(text, 7, 2)
        ).try_cast("date"),
    )
