"""Money text and decimal arithmetic as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.model import FINAL, RAW

# Plain decimal notation only: a cast alone would also take "1e3", and round what has more decimals
# than the raw type. Zeros behind its ten decimals say nothing.
PLAIN_NUMBER = r"^[+-]?(?:\d+(?:\.\d{0,10}0*)?|\.\d{1,10}0*)$"


def parse_money(text: Column) -> Column:
    """Decimal value of money text; ``$`` and ``,`` are ignored, null if it is not a number of
    at most ten decimals, which the importers reject."""
    bare = F.translate(text, "$,", "")
    return F.when(bare.rlike(PLAIN_NUMBER), bare.try_cast(RAW))


def rescale(amount: Column, digits: int = 3) -> Column:
    """Round half away from zero, keeping the raw type."""
    return F.round(amount, digits).cast(RAW)


def reverse_sign(amount: Column) -> Column:
    return -amount


def force_positive(amount: Column) -> Column:
    return F.abs(amount)


def force_negative(amount: Column) -> Column:
    return -F.abs(amount)


def price_times_quantity(price: Column, quantity: Column, digits: int = 3) -> Column:
    """Product of two raw decimals, rounded once, half away from zero; null from 18 whole digits on.

    No decimal type holds the product of two raw ones, which has twenty decimals. With both cut
    at the point, three of the four products have ten decimals at most. The fourth, of the parts below
    one, may lose what lies behind ten decimals, as that is too little to reach the next place to round.
    """
    one = F.lit(1).cast("decimal(1,0)")
    split = []
    for amount in (F.abs(price), F.abs(quantity)):
        whole = F.floor(amount).cast("decimal(38,0)")
        n_digits = F.when(whole == 0, 0).otherwise(F.length(whole.cast("string")))
        split.append((whole.try_cast("decimal(18,0)"), (amount % one).cast("decimal(10,10)"), n_digits))
    (whole_a, part_a, n_a), (whole_b, part_b, n_b) = split
    below = F.floor(part_a * part_b * F.lit(10**10).cast("decimal(11,0)")).cast("decimal(10,0)")
    products = [
        (whole_a * whole_b).try_cast("decimal(28,10)"),
        (whole_a * part_b).try_cast("decimal(28,10)"),
        (whole_b * part_a).try_cast("decimal(28,10)"),
        (below * F.lit("0.0000000001").cast("decimal(10,10)")).try_cast("decimal(28,10)"),
    ]
    rounded = F.round(sum(products[1:], products[0]), digits).try_cast(RAW)
    product = F.when(n_a + n_b <= 18, rounded)
    return F.when((price < 0) != (quantity < 0), -product).otherwise(product)


def to_final(amount: Column) -> Column:
    """Cast to the two-decimal type of completed tables."""
    return amount.cast(FINAL)


def format_amount(amount: Column) -> Column:
    """Two-decimal text of an amount."""
    return amount.cast(FINAL).cast("string")
