"""Accounting data derived from a star schema (orders, lineitem, supplier, …).

These give the operators real volume to work on: every order is a transaction or a
statement row, every line item a posting. The remainders below only vary the cases
(missing amounts, unreadable cells, unknown codes); no row is left out.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.model import ACTION_BALANCE, ACTION_CLOSE, ACTION_OPEN, RAW
from tallybook.operators.rules import ACTIVITY_CODES, CLOSED_CODES, US_PREFIXES
from tallybook.sources.lookups import last_entry_wins

#: Statement numbers one order takes: its header, up to seven items, other lines.
SLOTS = 16
#: Rows of a table that one task derives postings from.
_ROWS_PER_TASK = 500_000
#: Suppliers whose places take 32 MB at most, which are broadcast.
_FEW_SUPPLIERS = 500_000


@dataclass(frozen=True)
class Star:
    spark: SparkSession
    folder: str
    rows_per_task: int | None = _ROWS_PER_TASK

    def __getattr__(self, table: str) -> DataFrame:
        if table.startswith("_"):
            raise AttributeError(table)
        rows = self.spark.read.parquet(f"{self.folder}/{table}.parquet")
        return self._spread(rows) if table in ("lineitem", "orders") else rows

    def _spread(self, rows: DataFrame) -> DataFrame:
        """A table whose files have fewer splits than there are cores is dealt to all of them:
        what is derived from a row costs much more than moving its few columns. So is one whose splits
        hold very many rows, as a task's memory follows its rows, unless ``rows_per_task`` is None. The files
        tell how many there are."""
        parts = self.spark.sparkContext.defaultParallelism
        if self.rows_per_task is not None:
            parts = max(parts, -(-rows.count() // self.rows_per_task))
        return rows.repartition(parts) if rows.rdd.getNumPartitions() < parts else rows

    def rows(self, table: str) -> int:
        """How many rows a table has, as its files tell."""
        return self.spark.read.parquet(f"{self.folder}/{table}.parquet").count()


def _text(*parts: Column | str) -> Column:
    return F.concat(*[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts])


def _every(key: str, n: int, at: int = 0) -> Column:
    return F.col(key) % n == at


def _no_file() -> Column:
    return F.lit(0).cast("long").alias("file_no")


# --- book tables ----------------------------------------------------------------


def transactions(star: Star) -> DataFrame:
    return star.orders.select(
        F.col("o_orderkey").alias("statement_no"),
        _no_file(),
        F.col("o_orderdate").cast("date").alias("date"),
        _text("Order ", F.col("o_orderkey"), " ", F.col("o_orderpriority")).alias("narration"),
        F.when(F.col("o_orderstatus") != "P", _text("#", F.col("o_orderstatus"))).alias("tags"),
    )


def _dashed(name: str) -> Column:
    return F.translate(name, " _", "--")


def _item_postings(star: Star) -> DataFrame:
    places = (
        star.supplier.join(star.nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(star.region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("s_suppkey", _text("Assets:", _dashed("r_name"), ":", _dashed("n_name"), ":S").alias("place"))
    )
    # Items are not shuffled for a list that fits beside each task.
    if star.rows("supplier") <= _FEW_SUPPLIERS:
        places = F.broadcast(places)
    no_cost = _every("l_orderkey", 5) & (F.col("l_linenumber") == 3)
    cost = F.col("l_extendedprice").cast("decimal(12,2)")
    odd_cent = _every("l_orderkey", 19) & (F.col("l_linenumber") == 1)
    in_euro = _every("l_orderkey", 11) & _every("l_linenumber", 2)
    return star.lineitem.join(places, F.col("l_suppkey") == F.col("s_suppkey")).select(
        (F.col("l_orderkey") * SLOTS + F.col("l_linenumber")).alias("statement_no"),
        F.col("l_orderkey").alias("transaction_no"),
        _no_file(),
        _text(F.col("place"), F.col("l_suppkey")).alias("account"),
        F.col("l_quantity").cast("decimal(12,2)").cast(RAW).alias("cp_quantity"),
        _text("P", F.col("l_partkey") % 20).alias("cp_commodity"),
        # Widened last: sums of short decimals are sums of longs.
        F.when(~no_cost, F.when(odd_cent, cost + F.expr("0.005BD")).otherwise(cost).cast(RAW)).alias("tc_quantity"),
        F.when(~no_cost, F.when(in_euro, "EUR").otherwise("USD")).alias("tc_commodity"),
    )


def _blank_postings(star: Star) -> DataFrame:
    payable = F.when(_every("o_orderkey", 13), "Liabilities:Payable").otherwise(
        _text("Liabilities:Payable:", F.substring("o_orderpriority", 1, 1))
    )
    first = F.when(
        ~_every("o_orderkey", 7), F.struct(F.lit(8).alias("slot"), payable.alias("account"))
    )
    second = F.when(
        _every("o_orderkey", 17),
        F.struct(F.lit(9).alias("slot"), F.lit("Equity:Rounding").alias("account")),
    )
    return star.orders.select(
        "o_orderkey", F.explode(F.array_compact(F.array(first, second))).alias("leg")
    ).select(
        (F.col("o_orderkey") * SLOTS + F.col("leg.slot")).alias("statement_no"),
        F.col("o_orderkey").alias("transaction_no"),
        _no_file(),
        "leg.account",
        F.lit(None).cast(RAW).alias("cp_quantity"),
        F.lit(None).cast("string").alias("cp_commodity"),
        F.lit(None).cast(RAW).alias("tc_quantity"),
        F.lit(None).cast("string").alias("tc_commodity"),
    )


def postings(star: Star) -> DataFrame:
    return _item_postings(star).unionByName(_blank_postings(star))


def other_transactions(star: Star) -> DataFrame:
    """A second book: some transactions a day later."""
    return transactions(star).withColumn(
        "date", F.when(_every("statement_no", 97), F.date_add("date", 1)).otherwise(F.col("date"))
    )


def other_postings(star: Star) -> DataFrame:
    """A second book: some costs one higher."""
    dearer = _every("transaction_no", 50) & _every("statement_no", 2, 1)
    return postings(star).withColumn(
        "tc_quantity",
        F.when(dearer, F.col("tc_quantity") + 1).otherwise(F.col("tc_quantity")).cast(RAW),
    )


def verifications(star: Star) -> DataFrame:
    key = F.col("o_orderkey")
    is_balance = _every("o_orderkey", 3, 1)
    price = F.col("o_totalprice").cast("decimal(12,2)").cast(RAW)
    odd_cent = _every("o_orderkey", 19)
    return star.orders.select(
        key.alias("statement_no"),
        _no_file(),
        F.col("o_orderdate").cast("date").alias("date"),
        F.when(is_balance, ACTION_BALANCE)
        .when(_every("o_orderkey", 3), ACTION_OPEN)
        .otherwise(ACTION_CLOSE)
        .alias("action"),
        _text("Assets:Customers:C", F.col("o_custkey")).alias("account"),
        F.when(is_balance, F.when(odd_cent, price + F.expr("0.005BD")).otherwise(price))
        .cast(RAW)
        .alias("quantity"),
        F.when(is_balance & ~_every("o_orderkey", 41), "USD").alias("commodity"),
    )


# --- statement exports ----------------------------------------------------------


def _pick(values: list[str], key: str) -> Column:
    options = F.array(*[F.lit(value) for value in values])
    return F.element_at(options, (F.col(key) % len(values) + 1).cast("int"))


def _money_text() -> Column:
    """An order's price as statements write money: plain, with $, or with thousands commas."""
    price = F.col("o_totalprice").cast("decimal(18,2)")
    sign = F.when(_every("o_orderkey", 2, 1), "-").otherwise("")
    grouped = _text(
        F.floor(price / 1000).cast("long"),
        ",",
        F.lpad((price % 1000).cast("decimal(18,2)").cast("string"), 6, "0"),
    )
    return (
        F.when(_every("o_orderkey", 29), "n/a")
        .when(_every("o_orderkey", 3), _text(sign, "$", price))
        .when(_every("o_orderkey", 3, 1), _text(sign, "$", grouped))
        .otherwise(_text(sign, price, "55"))
    )


def _units_text() -> Column:
    key = F.col("o_orderkey")
    return (
        F.when(_every("o_orderkey", 37), "N/A")
        .when(_every("o_orderkey", 4), _text("1,", F.lpad((key % 500).cast("string"), 3, "0"), ".5"))
        .otherwise(
            _text(key % 500, ".", F.lpad((F.col("o_custkey") % 10000).cast("string"), 4, "0"))
        )
    )


def _day(pattern: str) -> Column:
    return F.date_format("o_orderdate", pattern)


def us_rows(star: Star) -> DataFrame:
    descriptions = [rule.key for rule in US_PREFIXES] + ["WIRE SENT", "BUYBACK"]
    return star.orders.select(
        F.col("o_orderkey").alias("row_no"),
        F.when(_every("o_orderkey", 5), "")
        .otherwise(_text("P", F.col("o_custkey") % 20))
        .alias("security_id"),
        _text(_pick(descriptions, "o_orderkey"), F.col("o_custkey")).alias("description"),
        _money_text().alias("net_amount"),
        F.when(_every("o_orderkey", 31), "13-45-2020").otherwise(_day("M-d-yyyy")).alias("settlement_date"),
        _units_text().alias("quantity"),
        F.when(_every("o_orderkey", 2), "").otherwise(_text("ref ", F.col("o_custkey"))).alias("details"),
    )


def activity_rows(star: Star) -> DataFrame:
    codes = [rule.key for rule in ACTIVITY_CODES] + ["UNKNOWN TYPE", "buy"]
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return star.orders.select(
        key.alias("row_no"),
        _pick(codes, "o_orderkey").alias("tran_types"),
        _text("Part ", customer % 25).alias("description"),
        F.when(_every("o_orderkey", 47), "?")
        .otherwise(_text(customer % 300, ".", F.lpad((key % 10000).cast("string"), 4, "0")))
        .alias("price"),
        F.when(_every("o_orderkey", 6), "0")
        .otherwise(_text(key % 70 - 35, ".", F.lpad((customer % 1000).cast("string"), 3, "0")))
        .alias("quantity"),
        F.when(_every("o_orderkey", 8), "0.00").otherwise(_money_text()).alias("amount"),
        F.when(_every("o_orderkey", 43), "soon").otherwise(_day("yyyy-MM-dd")).alias("settled"),
    )


def symbols(star: Star) -> DataFrame:
    """Part names to symbols; a name stands many times and the last one counts."""
    return last_entry_wins(
        star.part.select(
            _text("Part ", F.col("p_partkey") % 20).alias("key"),
            _text("SYM", F.col("p_partkey")).alias("value"),
            "p_partkey",
        ),
        F.col("p_partkey"),
    )


def closed_rows(star: Star) -> DataFrame:
    codes = [rule.key for rule in CLOSED_CODES] + ["ZZZ"]
    key, customer = F.col("o_orderkey"), F.col("o_custkey")
    return star.orders.select(
        key.alias("row_no"),
        _pick(codes, "o_orderkey").alias("tran"),
        _text("Holding ", customer, " ").alias("description"),
        F.when(_every("o_orderkey", 7), "")
        .when(_every("o_orderkey", 23), "  ")
        .otherwise(_text(" P", customer % 20))
        .alias("symbol"),
        _text(key % 70 - 35, ".", F.lpad((customer % 10000).cast("string"), 4, "0")).alias("quantity"),
        F.when(_every("o_orderkey", 11), "0").otherwise(_text("-", customer % 300, ".125")).alias("cost"),
        F.when(_every("o_orderkey", 47), "").otherwise("1.00").alias("price"),
        F.when(_every("o_orderkey", 4), "0.00").otherwise(_money_text()).alias("amount"),
        F.when(_every("o_orderkey", 43), "2024-02-30").otherwise(_day("yyyy-M-d")).alias("settle_date"),
    )


#: Who stands behind a client name, for the holdings rows below.
OWNERS = {"BUILDING": "Ann", "MACHINERY": "Bob", "HOUSEHOLD": "Joint"}


def holdings_rows(star: Star) -> DataFrame:
    return star.customer.select(
        F.col("c_custkey").alias("row_no"),
        F.col("c_mktsegment").alias("client_name"),
        _text("A", F.col("c_nationkey")).alias("account_number"),
        _text("P", F.col("c_custkey") % 20).alias("symbol"),
        F.when(_every("c_custkey", 4), "CASH").otherwise("Fund units").alias("holding"),
        _text("$", F.col("c_acctbal").cast("decimal(18,2)")).alias("quantity"),
        F.when(_every("c_custkey", 8), "").otherwise("CAD").alias("fund"),
        F.when(_every("c_custkey", 53), "").otherwise("1,000.00").alias("book_value"),
    )


# --- bank statements ------------------------------------------------------------

#: Orders one chunk of tags spans.
_ORDERS_PER_CHUNK = 1 << 16
_CHUNKS_PER_STATEMENT = 1 << 32


def statement_tags(star: Star) -> DataFrame:
    """One statement per customer, one transaction per order, as a tag stream."""
    customer, key = F.col("c_custkey"), F.col("o_orderkey")
    is_card = F.col("c_custkey") % 3 == 0
    opening = F.when(
        is_card,
        _text("<OFX><CCSTMTTRNRS><CCSTMTRS>", F.when(_every("c_custkey", 39), "").otherwise("<curdef>USD"), "<CCACCTFROM><ACCTID>", customer, "</CCACCTFROM><BANKTRANLIST>"),
    ).otherwise(
        _text(
            F.when(_every("c_custkey", 47), "<OFX></STMTTRNRS>").otherwise(
                _text("<OFX><STMTTRNRS><TRNUID>1<STMTRS><CURDEF>CAD\n<BANKACCTFROM><BANKID>9<ACCTID> ", customer)
            ),
            "\r\n</BANKACCTFROM><BANKTRANLIST>",
        )
    )
    balance = _text(
        "</BANKTRANLIST><LEDGERBAL><BALAMT>",
        F.col("c_acctbal").cast("decimal(18,2)"),
        "<DTASOF>20240131120000</LEDGERBAL><AVAILBAL><BALAMT>1.00<DTASOF>20240101</AVAILBAL>",
    )
    move = F.concat(
        _text(
            "<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>",
            F.when(_every("o_orderkey", 59), "2024XX01").otherwise(_day("yyyyMMdd")),
            "120000<TRNAMT>-",
            F.when(_every("o_orderkey", 61), "12.x").otherwise(
                F.col("o_totalprice").cast("decimal(18,2)").cast("string")
            ),
            "<FITID>",
            key,
        ),
        F.when(~_every("o_orderkey", 4), _text("<NAME>Tom &amp;amp; Co ", key)).otherwise(""),
        F.when(~_every("o_orderkey", 6), _text("<MEMO> for &lt;", F.col("o_orderpriority"), "&gt; \r\n")).otherwise(""),
        F.when(
            _every("o_orderkey", 10),
            "<PAYEE><NAME>elsewhere</PAYEE><BANKACCTTO><ACCTID>999</BANKACCTTO>",
        ).otherwise(""),
        F.lit("</STMTTRN>\n"),
    )
    customers, orders = star.customer, star.orders

    def placed(rows: DataFrame, owner: str, chunk: Column, pos: Column, text: Column) -> DataFrame:
        return rows.select(
            F.floor(F.col(owner) / 512).cast("long").alias("file"),
            (F.col(owner) * _CHUNKS_PER_STATEMENT + chunk).alias("chunk"),
            pos.cast("long").alias("pos"),
            text.alias("text"),
        )

    fragments = (
        placed(customers, "c_custkey", F.lit(0), F.lit(0), opening)
        .unionByName(
            placed(
                orders,
                "o_custkey",
                1 + F.floor(key / _ORDERS_PER_CHUNK).cast("long"),
                key,
                move,
            )
        )
        .unionByName(placed(customers, "c_custkey", F.lit(_CHUNKS_PER_STATEMENT // 2), F.lit(0), balance))
    )
    return fragments.select(
        "file", "chunk", "pos", F.posexplode(F.split("text", "<")).alias("sub", "token")
    ).select("file", "chunk", (F.col("pos") * 64 + F.col("sub")).alias("pos"), "token")


def account_names(star: Star) -> DataFrame:
    return star.supplier.select(
        F.col("s_suppkey").cast("string").alias("key"),
        _text("Assets:Bank:B", F.col("s_suppkey")).alias("value"),
    )


# --- book text ------------------------------------------------------------------


#: Document positions one chunk of book lines spans.
_POSITIONS_PER_CHUNK = 1 << 15


def book_lines(star: Star) -> DataFrame:
    """Both tables above written out, with other statements and faults between them. Some texts
    go on over a line end, some never end.

    ``pos`` leaves room for a comment after each line; a chunk cuts through
    transactions, as file splits do.
    """
    key = F.col("statement_no")
    day = F.date_format("date", "yyyy-MM-dd")

    def amount(sep: str, quantity: str, commodity: str) -> Column:
        return F.coalesce(
            _text(sep, F.col(quantity), " ", F.col(commodity)),
            F.lit(""),
        )

    legs = postings(star).select(
        F.col("transaction_no").alias("book_key"),
        (key * 2).alias("pos"),
        F.concat(
            F.lit("  "),
            "account",
            amount(" ", "cp_quantity", "cp_commodity"),
            amount(" @@ ", "tc_quantity", "tc_commodity"),
        ).alias("line"),
    )

    def line(slot: int, text: Column, when: Column, after: int = 0) -> Column:
        return F.when(
            when,
            F.struct(((key * SLOTS + slot) * 2 + after).alias("pos"), text.alias("line")),
        )

    always, broken = F.lit(True), _every("statement_no", 43)
    account = _text("Assets:Customers:C", key)
    tail = _text('"', F.coalesce(_text(" ", F.col("tags")), F.lit("")))
    others = (
        transactions(star)
        .select(
            key.alias("book_key"),
            F.explode(
                F.array_compact(
                    F.array(
                        line(0, _text(day, ' * "', F.when(broken, "Order").otherwise(_text(F.col("narration"), tail))), always),
                        line(0, _text(F.substring("narration", 7, 1000), tail), broken, after=1),
                        line(5, F.lit("; cut"), _every("statement_no", 53), after=1),
                        line(10, _text(day, " open ", account, " ; new"), _every("statement_no", 3)),
                        line(11, _text(day, " balance ", account, " -", key, ".125 USD"), _every("statement_no", 3, 1)),
                        line(12, _text(day, ' event "place" "', F.when(_every("statement_no", 44), "").otherwise(_text(key, '"'))), _every("statement_no", 4)),
                        line(12, _text(key, '"'), _every("statement_no", 44), after=1),
                        line(12, F.when(_every("statement_no", 28, 1), 'option "ti').otherwise(_text('option "title" "', key, '" ; name')), _every("statement_no", 4, 1)),
                        line(12, _text('tle" "', key, '" ; it is "so'), _every("statement_no", 28, 1), after=1),
                        line(12, _text(day, ' custom "budget" ', key), _every("statement_no", 4, 2)),
                        line(13, _text(day, " open ", account, " USD"), _every("statement_no", 23)),
                        line(13, _text("   stray ", key), _every("statement_no", 29)),
                        line(13, _text("Notes on ", key), _every("statement_no", 31)),
                        line(14, _text('include "part-', key, F.when(_every("statement_no", 74), "").otherwise('.book"')), _every("statement_no", 37)),
                        line(14, F.lit('.book"'), _every("statement_no", 74), after=1),
                        line(13, F.lit("  "), _every("statement_no", 41), after=1),
                        line(15, _text(day, " close ", account), _every("statement_no", 3, 2)),
                        line(15, _text(day, ' * "never ends ', key), _every("statement_no", 61), after=1),
                    )
                )
            ).alias("at"),
        )
        .select("book_key", "at.pos", "at.line")
    )
    return legs.unionByName(others).select(
        F.floor(F.col("book_key") / 4096).cast("long").alias("file_no"),
        F.floor(F.col("pos") / _POSITIONS_PER_CHUNK).cast("long").alias("chunk"),
        "pos",
        "line",
    )
