import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("tallybook-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def bag(df, *columns):
    """Rows as a sorted list of tuples, decimals as plain text."""
    from decimal import Decimal

    def plain(value):
        if isinstance(value, Decimal):
            return format(value.normalize(), "f") if value else "0"
        return value

    rows = (df.select(*columns) if columns else df).collect()
    return sorted((tuple(plain(v) for v in row) for row in rows), key=repr)


@pytest.fixture(name="bag", scope="session")
def bag_fixture():
    return bag
