"""Completion, imbalances and balances on small books."""

from decimal import Decimal

from pyspark.sql import functions as F

from tallybook.model import POSTINGS, TRANSACTIONS, VERIFICATIONS
from tallybook.operators.accounts import account_hierarchy
from tallybook.operators.balances import (
    account_totals,
    account_totals_from_raw,
    balances,
    balances_from_raw,
)
from tallybook.operators.complete import (
    complete_transactions,
    find_imbalances,
    imbalances,
    normalise_verifications,
)
from tallybook.operators.reconcile import reconcile
from tallybook.sources.rows import table


def postings(spark, *legs):
    """Legs as (transaction, account, units, commodity, cost, commodity)."""
    rows = []
    for at, (txn, account, *amounts) in enumerate(legs):
        cp, cpc, tc, tcc = (*amounts, None, None, None, None)[:4]
        rows.append(
            (
                at,
                txn,
                0,
                account,
                None if cp is None else Decimal(cp),
                cpc,
                None if tc is None else Decimal(tc),
                tcc,
            )
        )
    return table(spark, rows, POSTINGS)


FINALS = (
    "transaction_no",
    "account",
    "cp_quantity_final",
    "cp_commodity_final",
    "tc_quantity_final",
    "tc_commodity_final",
)


def test_blank_leg_takes_what_is_owed(spark, bag):
    book = postings(
        spark, (1, "Expenses:Food", "12.50", "USD", "12.50", "USD"), (1, "Assets:Bank")
    )
    assert bag(complete_transactions(book), *FINALS) == [
        (1, "Assets:Bank", "-12.5", "USD", "-12.5", "USD"),
        (1, "Expenses:Food", "12.5", "USD", "12.5", "USD"),
    ]
    assert find_imbalances(complete_transactions(book)).isEmpty()
    assert imbalances(book).isEmpty()


def test_first_commodity_by_name_fills_and_others_stay_off(spark, bag):
    book = postings(
        spark,
        (1, "A", "1", "X", "10", "USD"),
        (1, "B", "1", "Y", "7", "EUR"),
        (1, "C"),
    )
    assert bag(complete_transactions(book).filter("account = 'C'"), *FINALS) == [
        (1, "C", "-7", "EUR", "-7", "EUR")
    ]
    assert bag(imbalances(book)) == [(1, "USD", "10")]


def test_a_commodity_that_balances_does_not_fill(spark, bag):
    book = postings(
        spark,
        (1, "A", "1", "X", "5", "EUR"),
        (1, "B", "1", "X", "-5", "EUR"),
        (1, "C", "1", "X", "3", "USD"),
        (1, "D"),
    )
    assert bag(complete_transactions(book).filter("account = 'D'"), *FINALS) == [
        (1, "D", "-3", "USD", "-3", "USD")
    ]


def test_two_blank_legs_each_take_the_whole_amount(spark, bag):
    book = postings(spark, (1, "A", "5", "USD", "5", "USD"), (1, "B"), (1, "C"))
    assert bag(imbalances(book)) == [(1, "USD", "-5")]
    assert bag(find_imbalances(complete_transactions(book))) == [(1, "USD", "-5")]


def test_filling_is_per_column(spark, bag):
    book = postings(
        spark, (1, "A", "5", "USD", "5", "USD"), (1, "B", "-2", "SHARE"), (1, "C", None, None, None, "CAD")
    )
    got = bag(complete_transactions(book).filter("account <> 'A'"), *FINALS)
    assert got == [
        (1, "B", "-2", "SHARE", "-5", "USD"),
        (1, "C", "-5", "USD", "-5", "CAD"),
    ]


def test_no_cost_anywhere_is_an_error_without_commodity(spark, bag):
    book = postings(spark, (1, "A", "5", "USD"), (1, "B"))
    assert bag(complete_transactions(book), *FINALS) == [
        (1, "A", "5", "USD", None, None),
        (1, "B", None, None, None, None),
    ]
    assert bag(imbalances(book)) == [(1, None, None)]


def test_rounding_alone_can_unbalance(spark, bag):
    book = postings(
        spark,
        (1, "A", "1", "X", "0.005", "USD"),
        (1, "B", "1", "X", "0.005", "USD"),
        (1, "C", "1", "X", "-0.010", "USD"),
    )
    assert bag(imbalances(book)) == [(1, "USD", "0.01")]
    assert bag(find_imbalances(complete_transactions(book))) == [(1, "USD", "0.01")]


def test_cost_without_commodity(spark, bag):
    book = postings(
        spark, (1, "A", "1", "X", "4", None), (1, "B", "1", "X", "6", "USD"), (2, "C", "1", "X", "4", None)
    )
    assert bag(imbalances(book)) == bag(find_imbalances(complete_transactions(book)))
    assert bag(imbalances(book)) == [(1, "USD", "10"), (2, None, "4")]


def hot_book(spark, n=3000):
    """One transaction holds a third of all postings, and most of its legs are blank."""
    hot = spark.range(n).select(
        F.col("id").alias("statement_no"),
        F.lit(7).cast("long").alias("transaction_no"),
        F.lit(0).cast("long").alias("file_no"),
        F.concat(F.lit("Assets:H"), (F.col("id") % 5).cast("string")).alias("account"),
        F.when(F.col("id") < 3, F.col("id") + 1).cast("decimal(38,10)").alias("cp_quantity"),
        F.when(F.col("id") < 3, "USD").alias("cp_commodity"),
        F.when(F.col("id") < 3, F.col("id") + 1).cast("decimal(38,10)").alias("tc_quantity"),
        F.when(F.col("id") < 3, "USD").alias("tc_commodity"),
    )
    rest = spark.range(n, 3 * n).select(
        F.col("id").alias("statement_no"),
        F.floor(F.col("id") / 3).alias("transaction_no"),
        F.lit(0).cast("long").alias("file_no"),
        F.concat(F.lit("Income:R"), (F.col("id") % 3).cast("string")).alias("account"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 11).cast("decimal(38,10)").alias("cp_quantity"),
        F.when(F.col("id") % 3 > 0, "EUR").alias("cp_commodity"),
        F.when(F.col("id") % 3 > 1, F.col("id") % 11).cast("decimal(38,10)").alias("tc_quantity"),
        F.when(F.col("id") % 3 > 1, "EUR").alias("tc_commodity"),
    )
    return hot.unionByName(rest)


def test_sharing_out_a_large_transaction_changes_nothing(spark, bag):
    book = hot_book(spark)
    whole = complete_transactions(book, rows_per_task=10**9)
    shared = complete_transactions(book, rows_per_task=100)
    assert whole.count() == book.count()
    assert whole.exceptAll(shared).isEmpty() and shared.exceptAll(whole).isEmpty()


def test_large_transaction_goes_to_many_tasks(spark):
    book = hot_book(spark)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        tasks = (
            complete_transactions(book, rows_per_task=100)
            .filter("transaction_no = 7 and statement_no >= 3")
            .groupBy(F.spark_partition_id().alias("task"))
            .count()
        )
        counts = [row["count"] for row in tasks.collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert sum(counts) == 2997 and max(counts) < 1500


def test_summing_before_joining_changes_nothing(spark, bag):
    book = hot_book(spark)
    completed = complete_transactions(book)
    assert bag(imbalances(book)) == bag(find_imbalances(completed))
    for by in ("cp", "tc"):
        assert bag(account_totals_from_raw(book, by)) == bag(account_totals(completed, by))
        assert bag(balances_from_raw(book, by)) == bag(balances(completed, by))


def test_complete_postings_are_not_shuffled(spark, tmp_path):
    path = str(tmp_path / "postings")
    hot_book(spark, 100).write.parquet(path)
    plan = complete_transactions(spark.read.parquet(path))._jdf.queryExecution().executedPlan()
    text = plan.toString()
    first_branch = text[text.index("Union") : text.index("FileScan")]
    assert "Exchange" not in first_branch and "Join" not in first_branch


def test_hierarchy_is_ordered_by_segment(spark):
    book = postings(spark, (1, "Assets:A:C"), (1, "Assets:A-B"), (1, "Assets:A:C:D"))
    got = [row["account"] for row in account_hierarchy(book).collect()]
    assert got == ["Assets", "Assets:A", "Assets:A:C", "Assets:A:C:D", "Assets:A-B"]


def test_balances_come_from_text_prefixes(spark, bag):
    book = postings(
        spark,
        (1, "Assets:S6", "1", "USD", "1", "USD"),
        (1, "Assets:S66", "10", "USD", "10", "USD"),
        (1, "Assets:S6:X", "100", "USD", "100", "USD"),
        (1, "Equity:E", "-111", "USD", "-111", "USD"),
    )
    # A parent gets nothing from below; S66 inherits from S6, whose name it begins with.
    assert bag(balances(complete_transactions(book), "tc")) == [
        ("Assets:S6", "USD", "1"),
        ("Assets:S66", "USD", "11"),
        ("Assets:S6:X", "USD", "101"),
        ("Equity:E", "USD", "-111"),
    ]


def test_reconcile_is_one_way_and_ignores_copies(spark, bag):
    from datetime import date

    dates = table(spark, [(1, 0, date(2024, 1, 5), "n", None)], TRANSACTIONS)
    a = complete_transactions(
        postings(
            spark,
            (1, "A", "1", "USD", "1", "USD"),
            (1, "A", "1", "USD", "1", "USD"),
            (1, "B", "-2", "USD", "-2", "USD"),
            (2, "N", "3", "USD"),
        )
    )
    b = complete_transactions(
        postings(spark, (1, "A", "1", "USD", "1", "USD"), (1, "X", "-1", "USD", "-1", "USD"))
    )
    got = bag(reconcile(a, dates, b, dates), "account")
    # N has no date and no cost, and a null never matches, not even itself.
    assert got == [("B",), ("N",)]
    assert bag(reconcile(a, dates, a, dates), "account") == [("N",)]


def test_dating_a_large_transaction_is_split(spark, tmp_path):
    from datetime import date

    path = str(tmp_path / "p")
    book = hot_book(spark, 60000).withColumn("narration", F.sha2(F.col("statement_no").cast("string"), 512))
    completed = book.selectExpr(
        "transaction_no", "concat(account, narration) account",
        "cp_quantity cp_quantity_final", "cp_commodity cp_commodity_final",
        "tc_quantity tc_quantity_final", "tc_commodity tc_commodity_final",
    )
    completed.write.parquet(path)
    completed = spark.read.parquet(path)
    dates = table(spark, [(7, 0, date(2024, 1, 5), "n", None)], TRANSACTIONS)
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "500000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "200000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "12",
    }
    before = {name: spark.conf.get(name, None) for name in settings}
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        missing = reconcile(completed, dates, completed.limit(0), dates)
        assert len(missing.collect()) == 180000
        plan = missing._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    assert "skew=true" in plan


def test_verifications_keep_two_decimals(spark, bag):
    from datetime import date

    rows = [(1, 0, date(2024, 1, 1), 1, "Assets:A", Decimal("-1.005"), "USD")]
    got = bag(normalise_verifications(table(spark, rows, VERIFICATIONS)))
    assert got == [(date(2024, 1, 1), 1, "Assets:A", "-1.01", "USD")]
