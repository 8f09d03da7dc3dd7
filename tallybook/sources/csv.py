"""Brokerage CSV exports as text columns with their place in the file.

Columns are found by header name. Every column stays text here: an export's cells
are decoded by the importer, which can then say why a row was refused.
"""

from __future__ import annotations

import csv
from collections.abc import Mapping, Sequence
from typing import Any
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.order import LINES_PER_FILE, carry_forward
from tallybook.functions.quotes import inside_before, whole_texts
from tallybook.sources.files import first_lines, sized, with_file_numbers, with_places

Headers = dict[tuple[str, ...], list[str]]

# Header names of each export, and the column names used here.
US_COLUMNS = {
    "Account #": "account_no",
    "Account Nickname/Title": "title",
    "Date": "date_text",
    "Trade Date": "trade_date",
    "Security ID": "security_id",
    "CUSIP": "cusip",
    "Description": "description",
    "Net Amount": "net_amount",
    "Net Amount in Local Currency": "local_amount",
    "Settlement Date": "settlement_date",
    "Quantity": "quantity",
    "Price (Native)": "price",
    "Principal": "principal",
    "Principal in Local Currency": "local_principal",
    "Commission/Fees": "commission",
    "Account Type": "account_type",
    "Balance Type": "balance_type",
    "Details": "details",
    "Payee": "payee",
    "Paid for (Name)": "paid_for",
    "Request Reason": "request_reason",
}
ACTIVITY_COLUMNS = {
    "Processed": "processed",
    "Settled": "settled",
    "Tran Types": "tran_types",
    "Description": "description",
    "Price": "price",
    "Quantity": "quantity",
    "Amount": "amount",
}
CLOSED_COLUMNS = {
    "Trade Date": "trade_date",
    "Process Date": "process_date",
    "Settle Date": "settle_date",
    "Tran": "tran",
    "Description": "description",
    "Symbol": "symbol",
    "Quantity": "quantity",
    "Cost": "cost",
    "Price": "price",
    "Proc Date Value": "proc_date_value",
    "Amount": "amount",
}
HOLDINGS_COLUMNS = {
    "Client Name": "client_name",
    "Client Id": "client_id",
    "Account Nickname": "nickname",
    "Account Number": "account_number",
    "Asset Category": "asset_category",
    "Industry": "industry",
    "Symbol": "symbol",
    "Holding": "holding",
    "Quantity": "quantity",
    "Price": "price",
    "Fund": "fund",
    "Average Cost": "average_cost",
    "Book Value": "book_value",
    "Market Value": "market_value",
    "Accrued Interest": "accrued_interest",
    "G/L": "gain_loss",
    "G/L (%)": "gain_loss_percent",
    "Percentage of Assets": "percent_of_assets",
}


def _headers(spark: SparkSession, files: Sequence[str]) -> Headers:
    """The files of each header."""
    found: Headers = {}
    for path, line in sorted(first_lines(spark, files)):
        text = line.rstrip(b"\r").decode("utf-8-sig", "replace")
        found.setdefault(tuple(next(csv.reader([text]), [])), []).append(path)
    return found


_PARSER = {"escape": '"', "columnNameOfCorruptRecord": "_malformed"}


def _schema(header: Sequence[str]) -> T.StructType:
    return T.StructType([T.StructField(name, T.StringType()) for name in [*header, "_malformed"]])


def _ddl(header: Sequence[str]) -> str:
    return ", ".join(f"`{field.name.replace('`', '``')}` string" for field in _schema(header))


def _lines(spark: SparkSession, paths: str | Sequence[str], columns: Mapping[str, str], headers: Headers) -> DataFrame:
    """One row for each line, numbered where it is read."""
    files = sorted(file for of_header in headers.values() for file in of_header)
    parts = []
    for header, of_header in headers.items():
        scanned = (
            spark.read.options(header=True, **_PARSER)
            .schema(_schema(header))
            # Field counts are checked only on rows that are parsed in full.
            .option("columnPruning", False)
            .csv(paths if len(headers) == 1 else [unquote(path) for path in of_header])
        )
        placed = scanned.select(
            F.input_file_name().alias("path"),
            F.col("_metadata.file_block_start").alias("chunk"),
            F.monotonically_increasing_id().alias("pos"),
            *[F.coalesce(F.col(f"`{name}`"), F.lit("")).alias(ours) for name, ours in columns.items()],
            F.col("_malformed").isNotNull().alias("malformed"),
        )
        parts.append(with_places(placed, files, "row_no", scanned))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


# A quote opens a cell at its start only; inside, two stand for one.
_CELL = r'(?:[^",][^,]*+|"(?:[^"]|"")*+"(?!")[^,]*+|)'
_OPENS = rf'^(?:{_CELL},)*+"(?:[^"]|"")*+$'
_STAYS = rf'^(?:[^"]|"")*+(?:$|"(?!")[^,]*+(?:,{_CELL})*,"(?:[^"]|"")*+$)'


def _records(spark: SparkSession, paths: str | Sequence[str], columns: Mapping[str, str], headers: Headers) -> DataFrame:
    """One row for each record; a quoted cell may hold line ends.

    Lines are read from splits of any size. Whether a line begins inside a cell follows from the
    maps of the lines before it, chunk by chunk (see ``functions.quotes``); only the lines of
    records that have several are gathered.
    """
    scanned = spark.read.option("lineSep", "\n").text(paths)
    lines = scanned.select(
        F.input_file_name().alias("path"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"),
        F.regexp_replace("value", "\r$", "").alias("line"),
    )
    files = sorted(file for of_header in headers.values() for file in of_header)
    line, quoted = F.col("line"), F.col("line").contains('"')
    opens, stays = quoted & line.rlike(_OPENS), ~quoted | line.rlike(_STAYS)
    marked = inside_before(with_file_numbers(lines, files).withColumns({"_opens": opens}), "file", F.col("_opens"), stays)
    begins = F.when(~F.col("inside"), F.struct("chunk", "pos"))
    placed = carry_forward(marked, {"begin": begins})
    several = F.col("inside") | F.col("_opens")
    gathered = whole_texts(
        placed.filter(several).select("path", "file", "begin", "begin_no", F.col("number").alias("last"), "line"), "begin_no", "last", "path", "file", "begin"
    )
    # A record's place is that of its first line; its number follows the header's.
    single = placed.filter(~several).select("path", "file", "chunk", "pos", (F.col("number") - 1).alias("row_no"), "line")
    joined = gathered.select("path", "file", "begin.*", (F.col("first") - 1).alias("row_no"), "line")
    records = single.unionByName(joined).filter((F.col("row_no") % LINES_PER_FILE > 0) & (F.btrim("line", F.lit(" \t")) != ""))
    kinds = {file: kind for kind, of_header in enumerate(headers.values()) for file in of_header}
    if len(headers) > 1:
        table = spark.createDataFrame(list(kinds.items()), "path string, _kind long")
        records = records.join(sized(table, len(kinds), max(map(len, kinds))), "path")
    else:
        records = records.withColumn("_kind", F.lit(0).cast("long"))
    cells = None
    for kind, header in enumerate(headers):
        parsed = F.from_csv("line", _ddl(header), _PARSER)
        own = F.struct(
            *[F.coalesce(parsed[name], F.lit("")).alias(ours) for name, ours in columns.items()],
            parsed["_malformed"].isNotNull().alias("malformed"),
        )
        cells = own if cells is None else F.when(F.col("_kind") == kind, own).otherwise(cells)
    return records.select("path", "file", "chunk", "pos", "row_no", cells.alias("_cells")).select(
        "path", "chunk", "pos", "_cells.*", "file", "row_no"
    )


def read_export(
    spark: SparkSession,
    paths: str | Sequence[str],
    columns: Mapping[str, str],
    multiline: bool = False,
    folder: str | None = None,
) -> DataFrame:
    """Rows of CSV files; columns are found by the header of each file.

    Adds ``path``, ``file`` (its number), ``chunk`` and ``pos`` (document order), ``row_no``
    (see ``functions.order``: from the file and the row's place in it, however the file was split)
    and ``malformed`` (wrong number of fields). Rows are numbered where they are read. ``multiline`` lets
    a quoted cell hold line breaks, in files split as any others; lines then move once, to be read in
    order, and a record has the number of its first line. ``folder``, a new shared one, keeps the numbered
    rows, so that several tables cost one scan.
    """
    headers = _headers(spark, spark.read.text(paths).inputFiles())
    if not headers:
        raise ValueError("the export has no header")
    for header, of_header in headers.items():
        absent = [name for name in columns if name not in header]
        if absent:
            raise ValueError(f"{of_header[0]} has no column {', '.join(absent)}")
    rows = _records(spark, paths, columns, headers) if multiline else _lines(spark, paths, columns, headers)
    if folder is not None:
        rows.write.mode("errorifexists").parquet(folder)
        rows = spark.read.parquet(folder)
    return rows


def read_us(spark: SparkSession, paths: str | Sequence[str], **options: Any) -> DataFrame:
    return read_export(spark, paths, US_COLUMNS, **options)


def read_activities(spark: SparkSession, paths: str | Sequence[str], **options: Any) -> DataFrame:
    return read_export(spark, paths, ACTIVITY_COLUMNS, **options)


def read_closed(spark: SparkSession, paths: str | Sequence[str], **options: Any) -> DataFrame:
    return read_export(spark, paths, CLOSED_COLUMNS, **options)


def read_holdings(spark: SparkSession, paths: str | Sequence[str], **options: Any) -> DataFrame:
    return read_export(spark, paths, HOLDINGS_COLUMNS, **options)
