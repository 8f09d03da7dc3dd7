"""Account names an importer posts to, as patterns over owner and account number."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Account name patterns.
PATTERNS = {
    "Cash": "Assets:Investments:{owner}:{number}:Cash",
    "Securities": "Assets:Investments:{owner}:{number}:Securities",
    "TODO": "Assets:Investments:{owner}:TODO",
    "CapitalGains": "Income:Investments:{owner}:Taxable:CapitalGains",
    "Distribution": "Income:Investments:{owner}:Taxable:Distribution",
    "Dividend": "Income:Investments:{owner}:Taxable:Dividend",
    "LongTermCapitalGains": "Income:Investments:{owner}:Taxable:LongTermCapitalGains",
    "ShortTermCapitalGains": "Income:Investments:{owner}:Taxable:ShortTermCapitalGains",
    "GainLoss": "Income:Investments:{owner}:Taxable:GainLoss",
    "Interest": "Income:Investments:{owner}:Taxable:Interest",
    "Fees": "Expenses:Investments:{owner}:Fees",
    "ForeignTax": "Expenses:Investments:{owner}:ForeignTax",
}


def as_column(value: Column | str) -> Column:
    return value if isinstance(value, Column) else F.lit(value)


def account_name(kind: str, owner: Column | str, number: Column | str = "") -> Column:
    """The account of one kind, for literal or per-row owner and account number."""
    template = PATTERNS[kind].replace("{owner}", "%1$s").replace("{number}", "%2$s")
    return F.format_string(template, as_column(owner), as_column(number))


def _by_kind(kind: Column, texts: dict[str, str]) -> Column:
    pairs = [F.lit(part) for entry in texts.items() for part in entry]
    return F.try_element_at(F.create_map(*pairs), kind)


def account_by_kind(kind: Column, owner: Column | str, number: Column | str = "") -> Column:
    """The account for a per-row kind; null when the kind is unknown."""
    before, between, after = {}, {}, {}
    for name, pattern in PATTERNS.items():
        before[name], rest = pattern.split("{owner}")
        between[name], *tail = rest.split("{number}")
        if tail:
            after[name] = tail[0]
    numbered = F.concat(as_column(number), _by_kind(kind, after))
    return F.concat(
        _by_kind(kind, before),
        as_column(owner),
        _by_kind(kind, between),
        F.coalesce(numbered, F.lit("")),
    )
