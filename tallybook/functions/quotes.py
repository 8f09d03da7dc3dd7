"""Quoted text that runs over the ends of lines, found without reading a file in one piece.

After any line a book is in one of two states: inside a quoted text or not. A line maps the state
before it to the state after it; a chunk's map is that of its lines in turn, and the chunks of a
file take their true start from the maps before them. Three kinds of line suffice: those that
leave the state alone, those that fix it, and those that flip it. So the state is the value that
the last fixing line left, flipped as often as flipping lines came since, which is a running sum.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tallybook.functions.text import HEADER_OPENS, TEXT_AGAIN, TEXT_ENDS, TEXT_OPENS, TEXT_SECOND


def inside_before(lines: DataFrame, file: str, opens: Column, stays: Column) -> DataFrame:
    """Add ``inside``: is a quoted text open before the line.

    ``opens`` and ``stays`` are a line's map: is one open behind it, if none was before, and if one was.
    Every line is looked at; ``file``, ``chunk`` and ``pos`` place it.
    """
    keys, of = [file, "chunk"], W.partitionBy(file, "chunk").orderBy("pos")
    fixes = F.when(opens == stays, opens.cast("int"))
    mapped = lines.withColumns({"_fixes": fixes, "_flip": (opens & ~stays).cast("int")})
    counted = mapped.withColumn("_flips", F.sum("_flip").over(of)).withColumn("_value", (F.col("_fixes") + F.col("_flips")) % 2)
    known = counted.withColumn("_known", F.last("_value", ignorenulls=True).over(of.rowsBetween(W.unboundedPreceding, -1)))
    maps = known.groupBy(*keys).agg(F.max_by(F.coalesce("_value", "_known"), "pos").alias("_leaves"), F.sum("_flip").alias("_turns"))
    before = (F.coalesce("_known", "_start") + F.col("_flips") - F.col("_flip")) % 2 == 1
    return known.join(_true_starts(maps, file), keys).select(*lines.columns, before.alias("inside"))


def _true_starts(maps: DataFrame, file: str, *keep: Column) -> DataFrame:
    """``_start``, the state before each chunk, from the maps of the chunks before it: ``_leaves``, the
    state a chunk ends in whatever came before (null if that depends), and ``_turns``, how often it flips."""
    earlier = W.partitionBy(file).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)
    turned = maps.withColumn("_turned", F.coalesce(F.sum("_turns").over(earlier), F.lit(0)))
    left = F.last((F.col("_leaves") + F.col("_turned")) % 2, ignorenulls=True).over(earlier)
    start = (F.coalesce(left, F.lit(0)) + F.col("_turned")) % 2
    return turned.select(file, "chunk", start.alias("_start"), *keep)


def _ending() -> Column:
    """What a line with a quote makes of a text that is open before it: ``end`` of the statement, its
    ``second`` text, a second text that stays open (``again``), or ``no`` end that any statement allows."""
    line = F.col("line")
    return (
        F.when(line.rlike(TEXT_ENDS), "end")
        .when(line.rlike(TEXT_SECOND), "second")
        .when(line.rlike(TEXT_AGAIN), "again")
        .otherwise("no")
    )


#: Places between two lines: an event before a line, the line, events after it.
BEFORE, LINE, AFTER, AGAIN = range(4)


def quote_flags() -> dict[str, Column]:
    """What ``text_events`` has to know of a ``line``: could a text that goes on open in it, is it a transaction header,
    and its ``_ending``. All null for lines without a quote."""
    line = F.col("line")
    dated = ~line.rlike(r"^\d") | F.substring("line", 1, 10).try_cast("date").isNotNull()
    flags = {"_opens": line.rlike(TEXT_OPENS) & dated, "_header": line.rlike(HEADER_OPENS), "_ending": _ending()}
    return {name: F.when(line.contains('"'), flag) for name, flag in flags.items()}


def text_events(lines: DataFrame, file: str, stage: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Where quoted texts that run over line ends begin and end, as rows between the lines.

    Takes lines, or the ``quote_flags`` of lines, placed by ``file``, ``chunk`` and ``pos``; only lines with a quote are looked at, and of
    these only places and flags move. An event has ``file``, ``chunk``, ``pos`` (four times a line's, plus one of
    the sides above), ``text`` (true from here on, false from here on) and:

    * ``starts``, before the first line of such a statement;
    * ``opener``, after its last: what postings below it belong to, ``*`` if it is a transaction.

    A text that no line ends as a statement allows is none: the line that opens it stands alone,
    and those below are read as usual. Chunk ends change nothing. ``stage``, if given, writes the places and flags
    of these lines and reads them back.
    """
    keys = [file, "chunk"]
    of = W.partitionBy(*keys).orderBy("pos")
    opens = F.col("_opens")
    from_inside = F.when(F.col("_ending") == "again", True).when(F.col("_ending") == "no", opens).otherwise(False)
    flagged = lines if "_ending" in lines.columns else lines.withColumns(quote_flags())
    quoted = (
        flagged.filter(F.col("_ending").isNotNull())
        .select(*keys, "pos", "_opens", "_header", "_ending")
        .withColumn("_fixes", F.when(opens == from_inside, opens.cast("int")))
        .withColumn("_flip", (opens & F.col("_fixes").isNull()).cast("int"))
    )
    if stage:
        quoted = stage(quoted, "quotes")
    here = F.struct("chunk", "pos", "_ending")
    counted = quoted.select("*", F.sum("_flip").over(of).alias("_flips"), F.lead(here).over(of).alias("_next"))
    # A fixing line's value is kept as it would stand at the chunk's first line.
    value = (F.col("_fixes") + F.col("_flips")) % 2
    known = counted.withColumn("_value", value).withColumn(
        "_known", F.last("_value", ignorenulls=True).over(of.rowsBetween(W.unboundedPreceding, -1))
    )
    maps = known.groupBy(*keys).agg(
        F.max_by(F.coalesce("_value", "_known"), "pos").alias("_leaves"),
        F.sum("_flip").alias("_turns"),
        F.min_by(here, "pos").alias("_first"),
    )
    starts = _true_starts(maps, file, F.lead("_first").over(W.partitionBy(file).orderBy("chunk")).alias("_after"))
    before = (F.coalesce("_known", "_start") + F.col("_flips") - F.col("_flip")) % 2 == 1
    placed = known.join(starts, keys).withColumns({"_next": F.coalesce("_next", "_after"), "_inside": before & (F.col("_ending") != "no")})
    goes_on = F.when(F.col("_inside"), F.col("_ending") == "again").otherwise(opens) & (F.col("_next._ending") != "no")
    side = F.when(F.col("_inside"), AGAIN).otherwise(BEFORE)
    opener = F.when(F.col("_header") & ~F.col("_inside") & (F.col("_next._ending") == "end"), "*").otherwise("text")
    begin = F.struct("chunk", (F.col("pos") * 4 + side).alias("pos"), F.lit(True).alias("text"), F.when(~F.col("_inside"), F.lit(1)).alias("starts"), F.lit(None).cast("string").alias("opener"))
    end = F.struct("_next.chunk", (F.col("_next.pos") * 4 + AFTER).alias("pos"), F.lit(False).alias("text"), F.lit(None).cast("int").alias("starts"), opener.alias("opener"))
    return placed.filter(goes_on).select(file, F.explode(F.array(begin, end)).alias("at")).select(file, "at.*")


def whole_texts(lines: DataFrame, start: str, number: str, *keep: str) -> DataFrame:
    """One row for each ``start`` with the lines of its statement joined by ``\\n``, and the number of
    the last of them. A statement is one value of the result."""
    parts = F.array_sort(F.collect_list(F.struct(number, "line")))
    joined = F.array_join(F.transform(parts, lambda part: part["line"]), "\n")
    return lines.groupBy(start, *keep).agg(joined.alias("line"), F.max(number).alias(number), F.first(start).alias("first")).drop(start)
