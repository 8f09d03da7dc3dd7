"""Bank and credit-card statement files (QFX) as a stream of tags.

The files are read with ``<`` as the record separator, so a record is one tag and
the text after it. That makes a file splittable wherever Spark splits it, whether
the statement stands on one line or on thousands.
"""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.text import decode_windows_1252
from tallybook.sources.files import charsets, with_file_numbers


def read_tags(
    spark: SparkSession, paths: str | Sequence[str], encoding: str | None = None
) -> DataFrame:
    """``path, file, chunk, pos, token``; ``file`` numbers the paths; a token is ``TAG>text`` or ``/TAG>text``.

    A byte order mark tells a file's charset: UTF-8 or UTF-16 of either order. Other files are Windows-1252 with
    ``encoding`` "1252", and else UTF-8. Files of one charset are one scan, which splits them at ``<`` as that
    charset writes it. What stands before the first tag is a token without ``>``, which no tag matches.
    """
    files = spark.read.text(paths).inputFiles()
    marked = charsets(spark, files)
    parts = []
    for charset, of_charset in (marked or {None: []}).items():
        scanned = spark.read.option("lineSep", "<").option("encoding", charset or "UTF-8")
        scanned = scanned.text(paths if len(marked) < 2 else [unquote(file) for file in of_charset])
        value = F.col("value")
        if charset is None and encoding == "1252":
            token = decode_windows_1252(value)
        else:
            token = F.decode(value.cast("binary"), charset) if charset in ("UTF-16LE", "UTF-16BE") else value
        parts.append(
            scanned.select(
                F.input_file_name().alias("path"),
                F.col("_metadata.file_block_start").alias("chunk"),
                F.monotonically_increasing_id().alias("pos"),
                token.alias("token"),
            )
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return with_file_numbers(rows, sorted(files))
