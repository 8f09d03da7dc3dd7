"""How statement rows are classified: which template they expand by, and against which account.

A template is one of ``buy``, ``sell``, ``cash``, ``transfer``, ``reinvest``,
``dividend`` or ``none``. The tables are small and fixed, so they become literal
expressions and no row is ever joined to them.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F


class Rule(NamedTuple):
    key: str
    template: str
    counter: str | None = None
    currency: str | None = None
    display: str | None = None


# Description prefixes of US brokerage exports, first match wins.
# Runs of spaces inside a prefix are part of it.
US_PREFIXES = (
    Rule("ADVISORY FEES", "cash", "Fees"),
    Rule("ASSET BASED FEE", "cash", "Fees"),
    Rule("MAINTENANCE FEE", "cash", "Fees"),
    Rule("BUY ", "buy"),
    Rule("CASH DIVIDEND RECEIVED", "cash", "Dividend"),
    Rule("CASH IN LIEU OF FRACTIONALSHARE RECEIVED", "cash", "Dividend"),
    Rule("FOREIGN SECURITY DIVIDEND RECEIVED", "cash", "Dividend"),
    Rule("FOREIGN TAX WITHHELD AT   THE SOURCE", "cash", "ForeignTax"),
    Rule("LONG TERM CAPITAL GAIN    DISTRIBUTION", "cash", "LongTermCapitalGains"),
    Rule("REINVEST CASH INCOME", "buy"),
    Rule("ROLLOVER CONTRIBUTION", "cash", "TODO"),
    Rule("SELL ", "sell", "GainLoss"),
    Rule("SHORT TERM CAPITAL GAIN   DISTRIBUTION", "cash", "ShortTermCapitalGains"),
    Rule("STOCK SPIN-OFF RECEIVED", "buy"),
    Rule("STOCK SPLIT RECEIVED", "buy"),
    Rule("YOUR ASSET TRANSFERRED", "transfer", "TODO"),
)

# Transaction codes of Canadian activity exports, with the name shown
# in the narration (two of the names are spelt as the exports' readers expect them).
ACTIVITY_CODES = (
    Rule("BUY", "buy", display="Buy"),
    Rule("CASH RECEIPT", "cash", "TODO", display="CashReceipt"),
    Rule("CDN CASH DIVIDEND", "cash", "Dividend", display="CanadianCashDividend"),
    Rule("DISTRIBUTION", "cash", "Distribution", display="Distribution"),
    Rule("EXPIRING RIGHTS/WARRANTS", "sell", "GainLoss", display="ExpiringRightsAndWarrants"),
    Rule("FOREIGN DIVIDEND", "cash", "Dividend", display="ForeignDivident"),
    Rule("FOREIGN NON RESIDENT TAX", "cash", "ForeignTax", display="ForeignNonResidentTax"),
    Rule("FOREIGN TRANSFER", "cash", "TODO", display="ForeignTransfer"),
    Rule("GOODS & SERVICES TAX", "cash", "Fees", display="GoodsAndServicesTax"),
    Rule("INTERNAL TRANSFER", "transfer", "TODO", display="InternalTransfer"),
    Rule("MANDATORY EXCHANGE", "sell", "GainLoss", display="MandatoryExchange"),
    Rule("MF NOTIONAL DISTRIBUTION", "sell", "GainLoss", display="MFNotionalDistribution"),
    Rule("MF RETURN OF CAPITAL", "none", display="MFReturnOfCapital"),
    Rule("MONTHLY INTEREST", "cash", "Interest", display="MonthlyInterest"),
    Rule("MUTUAL FUND DIVIDEND", "cash", "Dividend", display="MutualFundDivident"),
    Rule("OTHER MANAGED ACCT FEES", "cash", "Fees", display="OtherManagedAcctFees"),
    Rule("OTHER MGD ACCT FEE RGSRTD", "cash", "Fees", display="OtherManagedAcctFeeRegistered"),
    Rule("PARTNERS FEE NON REG'D", "cash", "Fees", display="PartnersFeeNonRegistered"),
    Rule("QUEBEC SALES TAX", "cash", "Fees", display="QuebecSalesTax"),
    Rule("REINVESTED DIVIDEND", "reinvest", "Dividend", display="ReinvestmentDividend"),
    Rule("RRSP CONTRIBUTION", "cash", "TODO", display="RRSPContribution"),
    Rule("SEC TFR COSTS", "cash", "Fees", display="SecTfrCosts"),
    Rule("SELL", "sell", "GainLoss", display="Sell"),
    Rule("SPIN OFF (FOREIGN)", "buy", display="SpinOffForeign"),
    Rule("SPIN OFF (US)", "buy", display="SpinOffUS"),
    Rule("STOCK SPLIT", "buy", display="StockSplit"),
    Rule("US CASH DIVIDEND", "cash", "Dividend", currency="USD", display="USCashDividend"),
    Rule("US SOURCE LONG TERM GAINS", "cash", "CapitalGains", display="USSourceLongTermGains"),
    Rule("VIRIDIAN FEES NON REGISTD", "cash", "Fees", display="ViridanFeesNonRegistered"),
)

# Transaction codes of closed-account exports.
CLOSED_CODES = (
    Rule("ATI", "transfer", "TODO"),
    Rule("BUY", "buy"),
    Rule("CN", "cash", "TODO"),
    Rule("CR", "cash", "TODO"),
    Rule("DVR", "dividend", "Dividend"),
    Rule("DVU", "dividend", "Dividend", currency="USD"),
    Rule("EFT", "cash", "TODO"),
    Rule("GST", "cash", "Fees"),
    Rule("QST", "cash", "Fees"),
    Rule("SEL", "sell", "GainLoss"),
    Rule("TFE", "cash", "Fees"),
    Rule("TSF", "transfer", "TODO"),
    Rule("VFN", "cash", "Fees"),
    Rule("VFR", "cash", "Fees"),
)

# What stands for a security that has no symbol.
MISSING_ACTIVITY_SYMBOL = "UNKNOENSEC"
MISSING_SYMBOL = "UNKNOWNSEC"


def rule_by_prefix(text: Column, rules: Sequence[Rule] = US_PREFIXES) -> Column:
    """Index of the first rule whose key the text starts with; null if none."""
    return F.coalesce(*[F.when(text.startswith(rule.key), at) for at, rule in enumerate(rules)])


def rule_by_code(code: Column, rules: Sequence[Rule]) -> Column:
    """Index of the code's rule; null for an unknown code."""
    pairs: list[Column] = []
    for at, rule in enumerate(rules):
        pairs += [F.lit(rule.key), F.lit(at)]
    return F.try_element_at(F.create_map(*pairs), code)


def of_rule(index: Column, rules: Sequence[Rule], field: str) -> Column:
    """A field of the rule at ``index``."""
    values = [F.lit(getattr(rule, field)).cast("string") for rule in rules]
    return F.get(F.array(*values), index)
