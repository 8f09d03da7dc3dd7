"""Line order across file splits.

A scan yields rows as ``(file, chunk, pos)``: ``chunk`` is the split's offset in
its file and ``pos`` grows within the split, so the three together are the
document order although no task sees a whole file. The functions here answer
"what stood last before this line" and "which number has this line" with one
window per chunk (bounded by the split size) plus windows per file over a summary
with a single row per chunk. A file of any size is therefore spread over as many
tasks as it has splits, and any number of small files over all tasks.

``file`` is a number. A row's own number is made of it and of the row's place in the
file, so it does not depend on how the file was split.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Room for the lines of one file in a number; 2**27 files fit beside it.
LINES_PER_FILE = 1 << 36
#: Files whose sums are added up in one window of a running total.
_FILES_PER_RANGE = 1 << 12
#: Bits of a carried number that tell which of its few values a mark has.
_CODE_BITS = 6


def _before(file: str) -> W:
    return W.partitionBy(file).orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)


def carry_forward(
    rows: DataFrame,
    marks: Mapping[str, Column],
    file: str = "file",
    counts: Column | None = None,
    stage: Callable[[DataFrame, str], DataFrame] | None = None,
    among: Mapping[str, Sequence[object]] | None = None,
    keep: Column | None = None,
) -> DataFrame:
    """Number the rows (only those that ``counts``, if given; others have the number before), and add the latest non-null value of each mark at or before the row.

    ``number`` increases in document order over all files; ``number`` modulo
    ``LINES_PER_FILE`` is the row's place in its file, from one. A mark ``m`` adds the
    columns ``m`` and ``m_no``, the number of the row it comes from.

    The rows are needed twice, for the summary of the chunks and for the result. ``stage`` writes a table and
    reads it back; with it they are derived, dealt and sorted once, and the size of the summary is known to the join.

    ``among`` lists the values of marks that take few (63 at most); such a mark is carried as one number, which costs
    much less than a place and a value. A value that is not listed stops the job. ``keep`` tells which rows the result
    has; others have only to hand on their marks. In it, ``_value_m`` is the value that mark ``m`` has within the chunk, null
    where only earlier chunks can tell.
    """
    among = among or {}
    in_chunk = W.partitionBy(file, "chunk").orderBy("pos")
    so_far = in_chunk.rowsBetween(W.unboundedPreceding, 0)
    place = F.row_number().over(in_chunk) if counts is None else F.sum(counts.cast("int")).over(so_far)
    # Marks are made where they are carried, so that rows are dealt without them.
    placed = rows.withColumn("_place", place.cast("long"))
    within = placed.select(
        *rows.columns,
        "_place",
        F.lead(F.lit(True)).over(in_chunk).isNull().alias("_ends"),
        *[
            F.last(_noted(mark, among.get(name)), ignorenulls=True).over(so_far).alias(f"_within_{name}")
            for name, mark in marks.items()
        ],
    )
    # Read once here: what is staged has plain columns.
    noted = [
        read(f"_within_{name}", among.get(name)).alias(f"{what}_{name}")
        for name in marks
        for what, read in (("_no", _place_of), ("_value", _value_of))
    ]
    within = within.select(*rows.columns, "_place", "_ends", *noted)
    if keep is not None:
        within = within.withColumn("_keep", F.coalesce(keep, F.lit(False))).filter("_keep or _ends")
    if stage:
        within = stage(within, "rows")
    # A chunk's last row has what the chunk hands on.
    summary = within.filter("_ends").select(
        file, "chunk", F.col("_place").alias("_size"), *[c for name in marks for c in (f"_no_{name}", f"_value_{name}")]
    )
    earlier = _before(file)
    start = F.col(file) * F.lit(LINES_PER_FILE)
    numbered = summary.select(
        "*", (start + F.coalesce(F.sum("_size").over(earlier), F.lit(0))).alias("_shift")
    )
    carried = numbered.select(
        file,
        "chunk",
        "_shift",
        *[
            F.last(
                F.when(
                    F.col(f"_no_{name}").isNotNull(),
                    F.struct((F.col(f"_no_{name}") + F.col("_shift")).alias("no"), F.col(f"_value_{name}").alias("value")),
                ),
                ignorenulls=True,
            )
            .over(earlier)
            .alias(f"_before_{name}")
            for name in marks
        ],
    )
    if stage:
        carried = stage(carried, "chunks")
    found = []
    for name in marks:
        found += [
            F.coalesce(f"_value_{name}", f"_before_{name}.value").alias(name),
            F.coalesce(F.col(f"_no_{name}") + F.col("_shift"), F.col(f"_before_{name}.no")).alias(f"{name}_no"),
        ]
    if keep is not None:
        within = within.filter("_keep")
    return within.join(carried, [file, "chunk"]).select(
        *rows.columns, (F.col("_place") + F.col("_shift")).alias("number"), *found
    )


def _noted(mark: Column, values: Sequence[object] | None) -> Column:
    """What is carried of a mark: its place and value, or one number made of the place and the value's place in ``values``."""
    if values is None:
        return F.when(mark.isNotNull(), F.struct(F.col("_place").alias("no"), mark.alias("value")))
    return F.shiftleft("_place", _CODE_BITS) + F.array_position(_listed(values), mark)


def _listed(values: Sequence[object]) -> Column:
    return F.array(*[F.lit(value) for value in values])


def _place_of(carried: str, values: Sequence[object] | None) -> Column:
    return F.col(f"{carried}.no") if values is None else F.shiftright(carried, _CODE_BITS)


def _value_of(carried: str, values: Sequence[object] | None) -> Column:
    if values is None:
        return F.col(f"{carried}.value")
    # Spark takes an element of a list without nulls for never null, even if the place is.
    value = F.element_at(_listed(values), F.col(carried).bitwiseAND((1 << _CODE_BITS) - 1).cast("int"))
    return F.when(F.col(carried).isNotNull(), value)


def numbered(rows: DataFrame, file: str = "file") -> DataFrame:
    """Add ``number`` as ``carry_forward`` gives it."""
    return carry_forward(rows, {}, file)


def total_before(rows: DataFrame, weight: Column, file: str = "file") -> DataFrame:
    """Add ``total_before``: the sum of ``weight`` over all rows before this one.

    Sums run within a chunk, over the chunks of a range of files, and over the ranges; ranges
    have fixed boundaries, so the last window has a row for every 4096 files.
    """
    keys = [file, "chunk"]
    weighed = rows.withColumn("_weight", weight.cast("long"))
    zero = F.lit(0)
    earlier = W.partitionBy(*keys).orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    within = weighed.withColumn("_in_chunk", F.coalesce(F.sum("_weight").over(earlier), zero))
    ranged = F.floor(F.col(file) / _FILES_PER_RANGE).cast("long").alias("_range")
    chunks = weighed.groupBy(*keys).agg(F.sum("_weight").alias("_size")).select("*", ranged)
    in_range = W.partitionBy("_range").orderBy(*keys).rowsBetween(W.unboundedPreceding, -1)
    chunks = chunks.withColumn("_in_range", F.coalesce(F.sum("_size").over(in_range), zero))
    over_all = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    ranges = chunks.groupBy("_range").agg(F.sum("_size").alias("_total"))
    ranges = ranges.select("_range", F.coalesce(F.sum("_total").over(over_all), zero).alias("_before"))
    bases = chunks.join(ranges, "_range").select(*keys, (F.col("_in_range") + F.col("_before")).alias("_base"))
    return within.join(bases, keys).select(
        *rows.columns, (F.col("_base") + F.col("_in_chunk")).alias("total_before")
    )


#: Span of key values one task ranks.
_KEYS_PER_CHUNK = 1 << 20


def ordinal(rows: DataFrame, key: str, into: str) -> DataFrame:
    """Add ``into``: the number of rows with a smaller ``key``, a unique number of a row in a file."""
    placed = rows.withColumns(
        {
            "_file": F.floor(F.col(key) / F.lit(LINES_PER_FILE)).cast("long"),
            "chunk": F.floor(F.col(key) / F.lit(_KEYS_PER_CHUNK)).cast("long"),
            "pos": F.col(key),
        }
    )
    ranked = total_before(placed, F.lit(1), file="_file")
    return ranked.withColumnRenamed("total_before", into).drop("_file", "chunk", "pos")
