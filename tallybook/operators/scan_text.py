"""Plain-text book lines to typed tables.

A line is one statement, unless a quoted text in it goes on over line ends. Postings belong to
the transaction header that opens their unbroken run of lines; "the line that opened the run" and
"inside a quoted text" are carried across file splits, so a file is never gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.order import carry_forward
from tallybook.functions.quotes import LINE, quote_flags, text_events, whole_texts
from tallybook.functions.text import (
    CUSTOM,
    HEADER,
    INCLUDE,
    LINE_END,
    STATEMENT,
    STATEMENT_WORD,
    TWO_QUOTED,
    VERIFICATION,
)
from tallybook.model import (
    ACTION_BALANCE,
    ACTION_CLOSE,
    ACTION_CUSTOM,
    ACTION_EVENT,
    ACTION_OPEN,
    ACTION_OPTION,
    RAW,
    Book,
)
from tallybook.operators.legs import default_cost_to_units
from tallybook.sinks.tables import staging


def _field(pattern: str, group: int) -> Column:
    """Group of a pattern; null when it did not take part."""
    return F.nullif(F.regexp_extract("line", pattern, group), F.lit(""))


def _date() -> Column:
    return F.substring("line", 1, 10).try_cast("date")


def _kind() -> Column:
    """Statement word of a line, ``posting``, ``blank``, ``comment``, ``other`` or ``reject``.

    A line that is a statement up to some point and then goes on, an indented line
    that is no posting, and a quoted text that does not end are rejects. Lines that
    resemble no statement are ``other`` and carry no meaning. Takes whole statements.
    """
    line = F.col("line")
    first = F.substring(F.ltrim("line", F.lit(" \t")), 1, 1)
    indented = line.startswith(" ") | line.startswith("\t")
    word = F.regexp_extract("line", STATEMENT_WORD, 1)
    # A statement word after a date that does not exist makes no statement.
    no_such_day = F.substring("line", 1, 1).between("0", "9") & _date().isNull()
    quotes = F.length("line") - F.length(F.replace("line", F.lit('"'), F.lit("")))
    return (
        F.when(first == "", "blank")
        .when(first == ";", "comment")
        .when(line.rlike(STATEMENT + LINE_END) & ~no_such_day, F.when(indented, "posting").otherwise(word))
        .when(indented, "reject")
        .when((word == "") | no_such_day, "other")
        .when(line.rlike(STATEMENT), "reject")
        .when(word.isin("*", "event", "option", "include") & (quotes % 2 == 1), "reject")
        .otherwise("other")
    )


def scan_text(lines: DataFrame, folder: str | None = None, tables: Sequence[str] = ()) -> Book:
    """Tables of a book given as ``file_no, chunk, pos, line``.

    Statement numbers are line numbers that run on over the files in ``file_no``
    order; a statement over several lines has the number of its last. A line end inside a quoted text is
    ``\\n`` in the tables. A header without postings keeps its transaction. A posting whose run was
    not opened by a header is a reject; a text that never ends is one reject, and reading goes on below it.

    Every table is a selection of the classified lines. With ``folder``, a shared
    folder, the lines are derived and written there once, then with their places and partitioned by kind of statement, and each table
    reads its own partition and the lines inside texts; without it, each table scans the text again.

    ``tables`` names those that are wanted, all if none is; others are not in the book. Every line is read, classified and
    numbered all the same, but lines that only other tables show are not staged, and what is staged for so few is not sorted by kind.
    """
    tables = tables or tuple(_KINDS_OF)
    by = {"rows": "kind"} if len(tables) > 2 else None
    stage = staging(lines.sparkSession, folder, by) if folder is not None else None
    # What looks for quotes reads flags alone, so that no line is read or searched for that again.
    classified = lines.select("file_no", "chunk", "pos", "line", _kind().alias("kind")).withColumns(quote_flags())
    if stage:
        classified = stage(classified, "lines")
    events = text_events(classified, "file_no", stage).withColumns({"kind": F.lit(None).cast("string"), "line": F.lit(None).cast("string")})
    none = {"text": F.lit(None).cast("boolean"), "starts": F.lit(None).cast("int"), "opener": F.lit(None).cast("string")}
    kinds = classified.select("file_no", "chunk", (F.col("pos") * 4 + LINE).alias("pos"), "line", "kind").withColumns(none)
    is_line = F.col("kind").isNotNull()
    # What lines inside a text look like is put right by the event behind it.
    opener = F.coalesce("opener", F.when(F.col("kind") != "posting", F.col("kind")))
    marks = {"text": F.col("_text"), "start": F.col("starts")}
    # Only tables that show postings ask what opened their run.
    if opened := any("posting" in _KINDS_OF[name] for name in tables):
        marks["mark"] = opener
    placed = carry_forward(
        kinds.unionByName(events).withColumnRenamed("text", "_text"),
        marks,
        file="file_no",
        counts=is_line,
        stage=stage,
        among={"mark": _KINDS, "text": (True, False), "start": (1,)},
        keep=is_line & _wanted(tables),
    )
    of_run = (F.col("mark"), F.col("mark_no")) if opened else (F.lit(None).cast("string"), F.lit(None).cast("long"))
    placed = placed.select(
        "file_no", F.col("number").alias("statement_no"), "kind", F.coalesce("text", F.lit(False)).alias("text"), of_run[0].alias("opener"), of_run[1].alias("opener_no"), "line", "start_no"
    )
    parts = placed.filter("text").select("start_no", "statement_no", "file_no", "line")
    joined = whole_texts(parts, "start_no", "statement_no", "file_no").withColumns(
        {
            "kind": F.when(_kind() == "other", "reject").otherwise(_kind()),
            "opener": F.lit(None).cast("string"),
        }
    )
    single = placed.filter(~F.col("text"))
    columns = (*_PLACE, "kind", "opener", "line")
    whole = single.select(*columns).unionByName(joined.select(*columns))
    found = {
        "transactions": _transactions(whole),
        "postings": _postings(single),
        "verifications": _verifications(single),
        "informationals": _informationals(whole),
        "includes": whole.filter(F.col("kind") == "include").select(
            *_PLACE, _field(INCLUDE, 1).alias("path")
        ),
        "rejects": _rejects(whole),
    }
    return Book(**{name: found[name] if name in tables else None for name in _KINDS_OF})


def _wanted(tables: Sequence[str]) -> Column:
    """Can a line be in one of the tables, as far as its own chunk tells: is it of one of their kinds, or inside a text.

    ``_value_text`` and ``_value_mark`` are null as long as an earlier chunk decides; such a line is kept.
    """
    kinds = sorted({kind for name in tables for kind in _KINDS_OF[name]} - {"posting"})
    under_header = F.col("_value_mark") == "*"
    wanted = F.coalesce("_value_text", F.lit(True)) | F.col("kind").isin(kinds)
    if "postings" in tables:
        wanted = wanted | ((F.col("kind") == "posting") & F.coalesce(under_header, F.lit(True)))
    if "rejects" in tables:
        wanted = wanted | ((F.col("kind") == "posting") & ~F.coalesce(under_header, F.lit(False)))
    return wanted


_PLACE = ("statement_no", "file_no")
#: What ``_kind`` gives, and ``text`` for the end of a text that is no header.
_KINDS = (
    "*", "open", "close", "balance", "event", "custom", "include", "option",
    "posting", "blank", "comment", "other", "reject", "text",
)

#: The kinds of lines each table shows.
_KINDS_OF = {
    "transactions": ("*",),
    "postings": ("posting",),
    "verifications": ("open", "close", "balance"),
    "informationals": ("event", "option", "custom"),
    "includes": ("include",),
    "rejects": ("reject", "posting"),
}


def _transactions(placed: DataFrame) -> DataFrame:
    return placed.filter(F.col("kind") == "*").select(
        *_PLACE,
        _date().alias("date"),
        _field(HEADER, 2).alias("narration"),
        _field(HEADER, 3).alias("tags"),
    )


def _postings(placed: DataFrame) -> DataFrame:
    # A posting has one, three, four (cost only) or six words.
    words = F.split(F.btrim(F.substring_index("line", ";", 1), F.lit(" \t")), "[ \t]+")
    written = placed.filter((F.col("kind") == "posting") & (F.col("opener") == "*")).select(
        *_PLACE, F.col("opener_no").alias("transaction_no"), words.alias("words")
    )
    n, word = F.size("words"), F.col("words")
    has_units, has_cost = n.isin(3, 6), n.isin(4, 6)
    return default_cost_to_units(
        written.select(
            "statement_no",
            "transaction_no",
            "file_no",
            word[0].alias("account"),
            F.when(has_units, word[1]).try_cast(RAW).alias("cp_quantity"),
            F.when(has_units, word[2]).alias("cp_commodity"),
            F.when(has_cost, word[n - 2]).try_cast(RAW).alias("tc_quantity"),
            F.when(has_cost, word[n - 1]).alias("tc_commodity"),
        )
    )


def _verifications(placed: DataFrame) -> DataFrame:
    kind = F.col("kind")
    action = (
        F.when(kind == "open", ACTION_OPEN)
        .when(kind == "balance", ACTION_BALANCE)
        .otherwise(ACTION_CLOSE)
    )
    return placed.filter(kind.isin("open", "close", "balance")).select(
        *_PLACE,
        _date().alias("date"),
        action.alias("action"),
        _field(VERIFICATION, 2).alias("account"),
        _field(VERIFICATION, 3).try_cast(RAW).alias("quantity"),
        _field(VERIFICATION, 4).alias("commodity"),
    )


def _informationals(placed: DataFrame) -> DataFrame:
    kind = F.col("kind")
    action = (
        F.when(kind == "event", ACTION_EVENT)
        .when(kind == "option", ACTION_OPTION)
        .otherwise(ACTION_CUSTOM)
    )
    is_custom = kind == "custom"
    return placed.filter(kind.isin("event", "option", "custom")).select(
        *_PLACE,
        F.when(kind != "option", _date()).alias("date"),
        action.alias("action"),
        F.when(~is_custom, _field(TWO_QUOTED, 1)).alias("attribute"),
        F.when(is_custom, F.regexp_extract("line", CUSTOM, 2))
        .otherwise(_field(TWO_QUOTED, 2))
        .alias("value"),
    )


def _rejects(placed: DataFrame) -> DataFrame:
    kind = F.col("kind")
    reason = F.when(kind == "reject", "not a complete statement").when(
        (kind == "posting") & ~F.coalesce(F.col("opener") == "*", F.lit(False)),
        "posting without a transaction",
    )
    return placed.filter(kind.isin("reject", "posting")).select(*_PLACE, "line", reason.alias("reason")).filter(
        F.col("reason").isNotNull()
    )


def transactions_without_postings(book: Book) -> DataFrame:
    """Headers no posting follows. They stay in the book; this reports them."""
    # Distinct first: the right side of an anti join cannot be split when it is skewed.
    used = book.postings.select(F.col("transaction_no").alias("statement_no")).distinct()
    return book.transactions.join(used, "statement_no", "left_anti")
