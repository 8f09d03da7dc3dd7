"""Bank and credit-card statement tags to transactions, postings and balances.

A statement is an aggregate with a currency, an account and transactions. Which
statement, and which part of it, a tag stands in is carried forward over the tag
stream; each transaction is then assembled from its own tags. Tag names are
case-insensitive and aggregates need no end tag.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.dates import compact
from tallybook.functions.money import PLAIN_NUMBER
from tallybook.functions.order import carry_forward, ordinal
from tallybook.functions.text import expand_entities, strip
from tallybook.model import ACTION_BALANCE, RAW, Book
from tallybook.operators.lookups import name_accounts
from tallybook.sinks.tables import staging

# Tags of the statement format.
_STATEMENTS = ("STMTTRNRS", "CCSTMTTRNRS")
_ACCOUNTS = ("BANKACCTFROM", "CCACCTFROM")
_BODY = "OFX"
_PARTS = (*_STATEMENTS, *_ACCOUNTS, "STMTRS", "CCSTMTRS", "BANKTRANLIST", "LEDGERBAL", "AVAILBAL")
_IN_TRANSACTION = ("PAYEE", "BANKACCTTO", "CCACCTTO", "CURRENCY", "ORIGCURRENCY")
_LEAVES = ("CURDEF", "ACCTID", "DTPOSTED", "TRNAMT", "NAME", "MEMO", "BALAMT", "DTASOF")


def _amount(text: Column) -> Column:
    return F.when(text.rlike(PLAIN_NUMBER), text.try_cast(RAW))


def _place_tags(tags: DataFrame, stage: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Leaf tags with their statement, part and (in a transaction) transaction number."""
    before = F.substring_index("token", ">", 1)
    parsed = (
        tags.filter(F.col("token").contains(">"))
        .select(
            "file",
            "chunk",
            "pos",
            F.upper(F.btrim(before, F.lit("/ \t\r\n"))).alias("tag"),
            F.col("token").startswith("/").alias("closes"),
            F.substr("token", F.length(before) + 2).alias("text"),
        )
        # Other tags neither open a part nor hold a value that is used.
        .filter(F.col("tag").isin(*_PARTS, *_IN_TRANSACTION, "STMTTRN", _BODY, *_LEAVES))
    )
    tag, opens = F.col("tag"), ~F.col("closes")
    part = (
        F.when(opens & tag.isin(*_PARTS, *_IN_TRANSACTION, "STMTTRN"), tag)
        .when(~opens & tag.isin(*_IN_TRANSACTION), "STMTTRN")
        .when(~opens & tag.isin(*_PARTS, "STMTTRN"), "")
    )
    placed = carry_forward(
        parsed,
        {
            "body": F.when(opens & (tag == _BODY), tag),
            "statement": F.when(tag.isin(*_STATEMENTS), F.when(opens, tag).otherwise("")),
            "transaction": F.when(opens & (tag == "STMTTRN"), tag),
            "part": part,
        },
        stage=stage,
        among={"body": (_BODY,), "statement": (*_STATEMENTS, ""), "transaction": ("STMTTRN",), "part": (*_PARTS, *_IN_TRANSACTION, "STMTTRN", "")},
        keep=opens & tag.isin(*_LEAVES),
    )
    leaf = F.when(opens & tag.isin(*_LEAVES), expand_entities(strip(F.col("text"))))
    # What stands before the body of its file is not part of the statement.
    inside = F.when(F.col("statement") != "", F.col("statement_no")).alias("statement_no")
    return placed.filter(F.col("body").isNotNull()).select(
        "tag", leaf.alias("value"), inside, "transaction_no", "part", "part_no"
    ).filter(F.col("value").isNotNull())


def _entries(leaves: DataFrame) -> DataFrame:
    """One row per statement, transaction and balance, with its values in ``leaf``.

    All three come from one aggregate with the same columns, told apart afterwards by
    an aggregated value, so that plans which use several of them share its shuffle.
    """
    part, tag = F.col("part"), F.col("tag")
    names_statement = ((tag == "ACCTID") & part.isin(*_ACCOUNTS)) | (tag == "CURDEF")
    kind = (
        F.when(part == "STMTTRN", "move")
        .when(part == "LEDGERBAL", "balance")
        .when(names_statement, "statement")
    )
    number = (
        F.when(kind == "move", F.col("transaction_no"))
        .when(kind == "balance", F.col("part_no"))
        .otherwise(F.col("statement_no"))
    )
    values = [F.max(F.when(tag == name, F.col("value"))).alias(name.lower()) for name in _LEAVES]
    return (
        leaves.withColumns({"kind": kind, "number": number})
        .filter(F.col("kind").isNotNull() & F.col("number").isNotNull())
        .groupBy("number")
        .agg(
            F.max("kind").alias("kind"),
            F.max("statement_no").alias("statement_no"),
            F.struct(*values).alias("leaf"),
        )
    )


def scan_qfx(tags: DataFrame, accounts: DataFrame, consecutive: bool = False, folder: str | None = None) -> Book:
    """Transactions, one posting each, and balance assertions, from statement tags.

    ``accounts`` names account ids; an id without a name is used as it is. Nothing before a
    file's ``<OFX>`` counts. A transaction or balance whose date or amount cannot be read is a reject, and so is one that
    stands outside a statement or in one without an account or a currency.
    Statement numbers grow in document order. With ``consecutive`` they count the
    transactions from one and then the balances, which costs two rankings.

    Every table needs all entries. With ``folder``, a shared folder, the placed tags and the entries are written
    there once; without it, each use of them scans the tags again.
    """
    stage = staging(tags.sparkSession, folder) if folder is not None else None
    entries = _entries(_place_tags(tags, stage))
    if stage:
        entries = stage(entries, "entries")
    statements = entries.filter(F.col("kind") == "statement").select(
        "statement_no", "leaf.acctid", "leaf.curdef"
    )
    moves = entries.filter(F.col("kind") == "move").select("number", "statement_no", "leaf.*")
    held = entries.filter(F.col("kind") == "balance").select("number", "statement_no", "leaf.*")
    statements = statements.select(
        "statement_no", F.col("acctid").alias("account"), F.col("curdef").alias("commodity")
    )

    moves = name_accounts(
        moves.join(statements, "statement_no", "left").select(
            "number",
            "statement_no",
            "account",
            "commodity",
            compact(F.col("dtposted")).alias("date"),
            _amount(F.col("trnamt")).alias("quantity"),
            narration(F.col("name"), F.col("memo")).alias("narration"),
        ),
        accounts,
    )
    held = name_accounts(
        held.join(statements, "statement_no", "left").select(
            "number",
            "statement_no",
            "account",
            "commodity",
            compact(F.col("dtasof")).alias("date"),
            _amount(F.col("balamt")).alias("quantity"),
        ),
        accounts,
    )
    reason = (
        F.when(F.col("statement_no").isNull(), "outside a statement")
        .when(F.col("account").isNull(), "no account")
        .when(F.col("commodity").isNull(), "no currency")
        .when(F.col("date").isNull(), "date cannot be read")
        .when(F.col("quantity").isNull(), "amount cannot be read")
    )
    judged = ("number", "statement_no", "account", "commodity", "date", "quantity")
    rejects = (
        moves.select(*judged)
        .unionByName(held.select(*judged))
        .filter(reason.isNotNull())
        .select(F.col("number").alias("statement_no"), "account", reason.alias("reason"))
    )
    moves, held = moves.filter(reason.isNull()), held.filter(reason.isNull())
    if consecutive:
        moves, held = _count_up(moves, held)

    file_no = F.lit(0).cast("long").alias("file_no")
    transactions = moves.select(
        F.col("number").alias("statement_no"),
        file_no,
        "date",
        "narration",
        F.lit(None).cast("string").alias("tags"),
    )
    postings = moves.select(
        F.col("number").alias("statement_no"),
        F.col("number").alias("transaction_no"),
        file_no,
        "account",
        F.col("quantity").alias("cp_quantity"),
        F.col("commodity").alias("cp_commodity"),
        F.col("quantity").alias("tc_quantity"),
        F.col("commodity").alias("tc_commodity"),
    )
    verifications = held.select(
        F.col("number").alias("statement_no"),
        file_no,
        "date",
        F.lit(ACTION_BALANCE).alias("action"),
        "account",
        "quantity",
        "commodity",
    )
    return Book(transactions, postings, verifications, rejects=rejects)


def _count_up(moves: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbers 1, 2, … over the transactions, then on over the balances."""
    n_moves = moves.agg(F.count(F.lit(1))).scalar()
    moves = ordinal(moves, "number", "_before").withColumn("number", F.col("_before") + 1)
    held = ordinal(held, "number", "_before").withColumn(
        "number", n_moves + F.col("_before") + 1
    )
    return moves.drop("_before"), held.drop("_before")


def narration(name: Column, memo: Column) -> Column:
    """``name / memo``, whichever is there, or ``PROBLEM``."""
    return (
        F.when(name.isNotNull() & memo.isNotNull(), F.concat(name, F.lit(" / "), memo))
        .when(name.isNotNull(), name)
        .when(memo.isNotNull(), memo)
        .otherwise("PROBLEM")
    )
