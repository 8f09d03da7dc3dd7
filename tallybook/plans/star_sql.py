"""The registered queries as plain SQL, formulated independently of the operators.

Completion is written with windows and CASE, balances with a direct prefix
comparison, importers as one SELECT per leg.
"""

from __future__ import annotations

# --- book tables ----------------------------------------------------------------

_TXN = """txn AS (
  SELECT o_orderkey AS statement_no, CAST(0 AS BIGINT) AS file_no,
         CAST(o_orderdate AS DATE) AS date,
         'Order ' || o_orderkey || ' ' || o_orderpriority AS narration,
         CASE WHEN o_orderstatus <> 'P' THEN '#' || o_orderstatus END AS tags
  FROM orders)"""

_POST = """post AS (
  SELECT l_orderkey * 16 + l_linenumber AS statement_no, l_orderkey AS transaction_no,
         CAST(0 AS BIGINT) AS file_no,
         'Assets:' || replace(replace(r_name, ' ', '-'), '_', '-') || ':'
           || replace(replace(n_name, ' ', '-'), '_', '-') || ':S' || l_suppkey AS account,
         CAST(CAST(l_quantity AS DECIMAL(38,2)) AS DECIMAL(38,10)) AS cp_quantity,
         'P' || (l_partkey % 20) AS cp_commodity,
         CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 3 THEN NULL
              ELSE CAST(CAST(l_extendedprice AS DECIMAL(38,2)) AS DECIMAL(38,10))
                   + CASE WHEN l_orderkey % 19 = 0 AND l_linenumber = 1
                          THEN CAST(0.005 AS DECIMAL(38,10)) ELSE CAST(0 AS DECIMAL(38,10)) END
         END AS tc_quantity,
         CASE WHEN l_orderkey % 5 = 0 AND l_linenumber = 3 THEN NULL
              WHEN l_orderkey % 11 = 0 AND l_linenumber % 2 = 0 THEN 'EUR' ELSE 'USD'
         END AS tc_commodity
  FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey
  UNION ALL
  SELECT o_orderkey * 16 + 8, o_orderkey, 0,
         CASE WHEN o_orderkey % 13 = 0 THEN 'Liabilities:Payable'
              ELSE 'Liabilities:Payable:' || substr(o_orderpriority, 1, 1) END,
         NULL, NULL, NULL, NULL
  FROM orders WHERE o_orderkey % 7 <> 0
  UNION ALL
  SELECT o_orderkey * 16 + 9, o_orderkey, 0, 'Equity:Rounding', NULL, NULL, NULL, NULL
  FROM orders WHERE o_orderkey % 17 = 0)"""


def _fill(raw: str = "post", suffix: str = "") -> str:
    """CTEs ``off`` (first commodity that is off) and ``done`` (completed postings)."""
    return f"""off{suffix} AS (
  SELECT transaction_no, tc_commodity, totals FROM (
    SELECT *, row_number() OVER (PARTITION BY transaction_no ORDER BY tc_commodity) AS num
    FROM (SELECT transaction_no, tc_commodity, sum(-tc_quantity) AS totals
          FROM {raw} WHERE tc_commodity IS NOT NULL
          GROUP BY transaction_no, tc_commodity) t
    WHERE totals <> 0) r
  WHERE num = 1),
done{suffix} AS (
  SELECT p.statement_no, p.transaction_no, p.file_no, p.account,
         coalesce(p.cp_commodity, o.tc_commodity) AS cp_commodity_final,
         CAST(coalesce(p.cp_quantity, o.totals) AS DECIMAL(38,2)) AS cp_quantity_final,
         coalesce(p.tc_commodity, o.tc_commodity) AS tc_commodity_final,
         CAST(coalesce(p.tc_quantity, o.totals) AS DECIMAL(38,2)) AS tc_quantity_final
  FROM {raw} p LEFT JOIN off{suffix} o ON p.transaction_no = o.transaction_no)"""


_DONE = f"WITH {_POST}, {_fill()}"

_IMBALANCES = f"""{_DONE}
SELECT transaction_no, tc_commodity_final, CAST(totals AS DECIMAL(38,2)) AS totals FROM (
  SELECT transaction_no, tc_commodity_final, sum(tc_quantity_final) AS totals
  FROM done GROUP BY transaction_no, tc_commodity_final) t
WHERE totals <> 0 OR tc_commodity_final IS NULL"""

_ANCESTORS = """names AS (SELECT DISTINCT account FROM post),
tree AS (
  SELECT DISTINCT array_to_string(list_slice(string_split(account, ':'), 1, n), ':') AS account
  FROM (SELECT account, unnest(range(1, len(string_split(account, ':')) + 1)) AS n FROM names) x)"""


def _totals(by: str) -> str:
    return f"""{_DONE}
SELECT account, {by}_commodity_final, sum({by}_quantity_final) AS total
FROM done GROUP BY account, {by}_commodity_final"""


def _balances(by: str) -> str:
    return f"""{_DONE}, {_ANCESTORS},
tot AS (SELECT account AS posted, {by}_commodity_final, sum({by}_quantity_final) AS total
        FROM done WHERE {by}_commodity_final IS NOT NULL GROUP BY 1, 2)
SELECT account, {by}_commodity_final, sum(total) AS total
FROM tree JOIN tot ON starts_with(tree.account, tot.posted)
GROUP BY account, {by}_commodity_final"""


_VERIF = """verif AS (
  SELECT o_orderkey AS statement_no, CAST(0 AS BIGINT) AS file_no,
         CAST(o_orderdate AS DATE) AS date,
         CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS action,
         'Assets:Customers:C' || o_custkey AS account,
         CASE WHEN o_orderkey % 3 = 1 THEN
           CAST(CAST(o_totalprice AS DECIMAL(38,2)) AS DECIMAL(38,10))
           + CASE WHEN o_orderkey % 19 = 0 THEN CAST(0.005 AS DECIMAL(38,10))
                  ELSE CAST(0 AS DECIMAL(38,10)) END END AS quantity,
         CASE WHEN o_orderkey % 3 = 1 AND o_orderkey % 41 <> 0 THEN 'USD' END AS commodity
  FROM orders),
norm AS (SELECT date, action, account, CAST(quantity AS DECIMAL(38,2)) AS quantity, commodity
         FROM verif)"""

# --- statement exports ----------------------------------------------------------

_MONEY = """CASE WHEN o_orderkey % 29 = 0 THEN 'n/a'
  WHEN o_orderkey % 3 = 0 THEN sign || '$' || price
  WHEN o_orderkey % 3 = 1 THEN sign || '$' || thousands || ',' || lpad(CAST(rest AS VARCHAR), 6, '0')
  ELSE sign || price || '55' END"""

_SRC = """src AS (
  SELECT *, CAST(o_totalprice AS DECIMAL(18,2)) AS price,
         CASE WHEN o_orderkey % 2 = 1 THEN '-' ELSE '' END AS sign,
         CAST(floor(CAST(o_totalprice AS DECIMAL(18,2)) / 1000) AS BIGINT) AS thousands,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) % 1000 AS DECIMAL(18,2)) AS rest
  FROM orders)"""


def _number(text: str) -> str:
    return f"TRY_CAST(replace(replace({text}, '$', ''), ',', '') AS DECIMAL(38,10))"


_US = f"""{_SRC},
us_text AS (
  SELECT o_orderkey AS row_no,
         CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'P' || (o_custkey % 20) END AS sec,
         (['ADVISORY FEES', 'ASSET BASED FEE', 'MAINTENANCE FEE', 'BUY ', 'CASH DIVIDEND RECEIVED',
           'CASH IN LIEU OF FRACTIONALSHARE RECEIVED', 'FOREIGN SECURITY DIVIDEND RECEIVED',
           'FOREIGN TAX WITHHELD AT   THE SOURCE', 'LONG TERM CAPITAL GAIN    DISTRIBUTION',
           'REINVEST CASH INCOME', 'ROLLOVER CONTRIBUTION', 'SELL ',
           'SHORT TERM CAPITAL GAIN   DISTRIBUTION', 'STOCK SPIN-OFF RECEIVED',
           'STOCK SPLIT RECEIVED', 'YOUR ASSET TRANSFERRED', 'WIRE SENT', 'BUYBACK']
         )[CAST(o_orderkey % 18 + 1 AS INTEGER)] || o_custkey AS description,
         {_MONEY} AS net_amount,
         CASE WHEN o_orderkey % 31 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date,
         CASE WHEN o_orderkey % 37 = 0 THEN 'N/A'
              WHEN o_orderkey % 4 = 0 THEN '1,' || lpad(CAST(o_orderkey % 500 AS VARCHAR), 3, '0') || '.5'
              ELSE (o_orderkey % 500) || '.' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0')
         END AS quantity,
         CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'ref ' || o_custkey END AS details
  FROM src),
us AS (
  SELECT *, round({_number("net_amount")}, 3) AS amount,
         coalesce(round({_number("quantity")}, 3), 0) AS units,
         CASE WHEN {_number("quantity")} IS NULL
              THEN 'Error' || quantity || ' ' || CASE WHEN sec = '' THEN 'UNKNOWNSEC' ELSE sec END
              WHEN sec = '' THEN 'UNKNOWNSEC' ELSE sec END AS commodity,
         CASE WHEN date IS NULL THEN 'skip'
              WHEN description LIKE 'ADVISORY FEES%' OR description LIKE 'ASSET BASED FEE%'
                OR description LIKE 'MAINTENANCE FEE%' THEN 'cash'
              WHEN description LIKE 'BUY %' OR description LIKE 'REINVEST CASH INCOME%'
                OR description LIKE 'STOCK SPIN-OFF RECEIVED%' OR description LIKE 'STOCK SPLIT RECEIVED%'
                THEN CASE WHEN sec = '' THEN 'skip' ELSE 'buy' END
              WHEN description LIKE 'SELL %' THEN CASE WHEN sec = '' THEN 'skip' ELSE 'sell' END
              WHEN description LIKE 'YOUR ASSET TRANSFERRED%'
                THEN CASE WHEN sec = '' THEN 'cash' ELSE 'move' END
              WHEN description LIKE 'WIRE%' OR description LIKE 'BUYBACK%' THEN 'skip'
              ELSE 'cash' END AS shape,
         CASE WHEN description LIKE '% FEE%' THEN 'Expenses:Investments:Owner:Fees'
              WHEN description LIKE 'FOREIGN TAX%' THEN 'Expenses:Investments:Owner:ForeignTax'
              WHEN description LIKE 'LONG%' THEN 'Income:Investments:Owner:Taxable:LongTermCapitalGains'
              WHEN description LIKE 'SHORT%' THEN 'Income:Investments:Owner:Taxable:ShortTermCapitalGains'
              WHEN description LIKE 'SELL%' THEN 'Income:Investments:Owner:Taxable:GainLoss'
              WHEN description LIKE 'ROLLOVER%' OR description LIKE 'YOUR%'
                THEN 'Assets:Investments:Owner:TODO'
              ELSE 'Income:Investments:Owner:Taxable:Dividend' END AS counter
  FROM us_text)"""

_CASH = "'Assets:Investments:Owner:U100:Cash'"
_SEC = "'Assets:Investments:Owner:U100:Securities'"


def _leg(source: str, no: int | str, account: str, cp: str, cpc: str, tc: str, tcc: str, when: str) -> str:
    return f"""SELECT row_no * 4 + 1 + {no} AS statement_no, row_no * 4 AS transaction_no,
  CAST(0 AS BIGINT) AS file_no, {account} AS account,
  CAST({cp} AS DECIMAL(38,10)) AS cp_quantity, CAST({cpc} AS VARCHAR) AS cp_commodity,
  CAST({tc} AS DECIMAL(38,10)) AS tc_quantity, CAST({tcc} AS VARCHAR) AS tc_commodity
FROM {source} WHERE {when}"""


def _blank(source: str, no: int | str, account: str, when: str) -> str:
    return _leg(source, no, account, "NULL", "NULL", "NULL", "NULL", when)


_US_OK = "amount IS NOT NULL"
_US_LEGS = " UNION ALL ".join(
    [
        _leg("us", 0, _SEC, "units", "commodity", "abs(amount)", "'USD'", f"{_US_OK} AND shape IN ('buy', 'move')"),
        _leg("us", 0, _SEC, "-abs(units)", "commodity", "NULL", "NULL", f"{_US_OK} AND shape = 'sell'"),
        _leg("us", 0, _CASH, "amount", "'USD'", "NULL", "NULL", f"{_US_OK} AND shape = 'cash'"),
        _leg("us", 1, _CASH, "amount", "'USD'", "NULL", "NULL", f"{_US_OK} AND shape IN ('buy', 'sell')"),
        _blank("us", 1, "counter", f"{_US_OK} AND shape IN ('cash', 'move')"),
        _blank("us", 2, "counter", f"{_US_OK} AND shape = 'sell'"),
    ]
)

_HEAD = """row_no * 4 AS statement_no, CAST(0 AS BIGINT) AS file_no, date"""

_ACT = f"""{_SRC},
sym AS (SELECT 'Part ' || (p_partkey % 20) AS description, 'SYM' || max(p_partkey) AS symbol
        FROM part GROUP BY p_partkey % 20),
act_text AS (
  SELECT o_orderkey AS row_no,
         (['BUY', 'CASH RECEIPT', 'CDN CASH DIVIDEND', 'DISTRIBUTION', 'EXPIRING RIGHTS/WARRANTS',
           'FOREIGN DIVIDEND', 'FOREIGN NON RESIDENT TAX', 'FOREIGN TRANSFER', 'GOODS & SERVICES TAX',
           'INTERNAL TRANSFER', 'MANDATORY EXCHANGE', 'MF NOTIONAL DISTRIBUTION',
           'MF RETURN OF CAPITAL', 'MONTHLY INTEREST', 'MUTUAL FUND DIVIDEND',
           'OTHER MANAGED ACCT FEES', 'OTHER MGD ACCT FEE RGSRTD', 'PARTNERS FEE NON REG''D',
           'QUEBEC SALES TAX', 'REINVESTED DIVIDEND', 'RRSP CONTRIBUTION', 'SEC TFR COSTS', 'SELL',
           'SPIN OFF (FOREIGN)', 'SPIN OFF (US)', 'STOCK SPLIT', 'US CASH DIVIDEND',
           'US SOURCE LONG TERM GAINS', 'VIRIDIAN FEES NON REGISTD', 'UNKNOWN TYPE', 'buy']
         )[CAST(o_orderkey % 31 + 1 AS INTEGER)] AS tran,
         'Part ' || (o_custkey % 25) AS description,
         CASE WHEN o_orderkey % 47 = 0 THEN '?'
              ELSE (o_custkey % 300) || '.' || lpad(CAST(o_orderkey % 10000 AS VARCHAR), 4, '0') END AS price_text,
         CASE WHEN o_orderkey % 6 = 0 THEN '0'
              ELSE (o_orderkey % 70 - 35) || '.' || lpad(CAST(o_custkey % 1000 AS VARCHAR), 3, '0') END AS quantity_text,
         CASE WHEN o_orderkey % 8 = 0 THEN '0.00' ELSE {_MONEY} END AS amount_text,
         CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date
  FROM src),
act_all AS (
  SELECT t.*, coalesce(symbol, 'UNKNOENSEC') AS symbol,
         {_number("price_text")} AS price, {_number("quantity_text")} AS quantity,
         {_number("amount_text")} AS raw_amount
  FROM act_text t LEFT JOIN sym ON t.description = sym.description),
act AS (
  SELECT *, round(raw_amount, 3) AS amount, round(quantity, 3) AS units,
         abs(round(CAST(price AS DECIMAL(18,6)) * CAST(quantity AS DECIMAL(18,6)), 3)) AS cost,
         CASE WHEN tran = 'US CASH DIVIDEND' THEN 'USD' ELSE 'CAD' END AS cur,
         CASE WHEN tran IN ('BUY', 'SPIN OFF (FOREIGN)', 'SPIN OFF (US)', 'STOCK SPLIT') THEN 'buy'
              WHEN tran IN ('SELL', 'EXPIRING RIGHTS/WARRANTS', 'MF NOTIONAL DISTRIBUTION', 'MANDATORY EXCHANGE') THEN 'sell'
              WHEN tran = 'INTERNAL TRANSFER' THEN 'move'
              WHEN tran = 'REINVESTED DIVIDEND' THEN 'reinvest'
              WHEN tran = 'MF RETURN OF CAPITAL' THEN 'none'
              ELSE 'cash' END AS shape,
         CASE WHEN tran IN ('CASH RECEIPT', 'FOREIGN TRANSFER', 'RRSP CONTRIBUTION', 'INTERNAL TRANSFER')
                THEN 'Assets:Investments:Owner:TODO'
              WHEN tran = 'DISTRIBUTION' THEN 'Income:Investments:Owner:Taxable:Distribution'
              WHEN tran = 'FOREIGN NON RESIDENT TAX' THEN 'Expenses:Investments:Owner:ForeignTax'
              WHEN tran = 'US SOURCE LONG TERM GAINS' THEN 'Income:Investments:Owner:Taxable:CapitalGains'
              WHEN tran = 'MONTHLY INTEREST' THEN 'Income:Investments:Owner:Taxable:Interest'
              WHEN tran LIKE '%DIVIDEND' THEN 'Income:Investments:Owner:Taxable:Dividend'
              WHEN tran LIKE '%TAX' OR tran LIKE '%FEE%' OR tran LIKE '%COSTS' THEN 'Expenses:Investments:Owner:Fees'
              ELSE 'Income:Investments:Owner:Taxable:GainLoss' END AS counter
  FROM act_all
  WHERE tran NOT IN ('UNKNOWN TYPE', 'buy') AND price IS NOT NULL AND quantity IS NOT NULL
    AND raw_amount IS NOT NULL AND date IS NOT NULL),
act_moves AS (SELECT *, CAST(raw_amount <> 0 AS INTEGER) AS has_cash,
                     CAST(quantity <> 0 AS INTEGER) AS has_units FROM act WHERE shape = 'move')"""

_ACT_LEGS = " UNION ALL ".join(
    [
        _leg("act", 0, _SEC, "units", "symbol", "abs(amount)", "cur", "shape = 'buy'"),
        _leg("act", 1, _CASH, "amount", "cur", "NULL", "NULL", "shape IN ('buy', 'sell')"),
        _leg("act", 0, _SEC, "units", "symbol", "NULL", "NULL", "shape = 'sell'"),
        _blank("act", 2, "counter", "shape = 'sell'"),
        _leg("act", 0, _CASH, "amount", "cur", "NULL", "NULL", "shape = 'cash'"),
        _blank("act", 1, "counter", "shape = 'cash'"),
        _leg("act_moves", 0, _CASH, "amount", "cur", "NULL", "NULL", "has_cash = 1"),
        _leg("act_moves", "has_cash", _SEC, "units", "symbol", "cost", "cur", "has_units = 1"),
        _blank("act_moves", "has_cash + has_units", "counter", "TRUE"),
        _leg("act", 0, _SEC, "units", "symbol", "cost", "cur", "shape = 'reinvest'"),
        _leg("act", 1, "counter", "-cost", "cur", "NULL", "NULL", "shape = 'reinvest'"),
    ]
)

_ACT_NAMES = """CASE tran WHEN 'BUY' THEN 'Buy' WHEN 'CASH RECEIPT' THEN 'CashReceipt'
  WHEN 'CDN CASH DIVIDEND' THEN 'CanadianCashDividend' WHEN 'DISTRIBUTION' THEN 'Distribution'
  WHEN 'EXPIRING RIGHTS/WARRANTS' THEN 'ExpiringRightsAndWarrants'
  WHEN 'FOREIGN DIVIDEND' THEN 'ForeignDivident' WHEN 'FOREIGN NON RESIDENT TAX' THEN 'ForeignNonResidentTax'
  WHEN 'FOREIGN TRANSFER' THEN 'ForeignTransfer' WHEN 'GOODS & SERVICES TAX' THEN 'GoodsAndServicesTax'
  WHEN 'INTERNAL TRANSFER' THEN 'InternalTransfer' WHEN 'MANDATORY EXCHANGE' THEN 'MandatoryExchange'
  WHEN 'MF NOTIONAL DISTRIBUTION' THEN 'MFNotionalDistribution' WHEN 'MONTHLY INTEREST' THEN 'MonthlyInterest'
  WHEN 'MUTUAL FUND DIVIDEND' THEN 'MutualFundDivident' WHEN 'OTHER MANAGED ACCT FEES' THEN 'OtherManagedAcctFees'
  WHEN 'OTHER MGD ACCT FEE RGSRTD' THEN 'OtherManagedAcctFeeRegistered'
  WHEN 'PARTNERS FEE NON REG''D' THEN 'PartnersFeeNonRegistered' WHEN 'QUEBEC SALES TAX' THEN 'QuebecSalesTax'
  WHEN 'REINVESTED DIVIDEND' THEN 'ReinvestmentDividend' WHEN 'RRSP CONTRIBUTION' THEN 'RRSPContribution'
  WHEN 'SEC TFR COSTS' THEN 'SecTfrCosts' WHEN 'SELL' THEN 'Sell' WHEN 'SPIN OFF (FOREIGN)' THEN 'SpinOffForeign'
  WHEN 'SPIN OFF (US)' THEN 'SpinOffUS' WHEN 'STOCK SPLIT' THEN 'StockSplit'
  WHEN 'US CASH DIVIDEND' THEN 'USCashDividend' WHEN 'US SOURCE LONG TERM GAINS' THEN 'USSourceLongTermGains'
  WHEN 'VIRIDIAN FEES NON REGISTD' THEN 'ViridanFeesNonRegistered' END"""

_CLOSED = f"""{_SRC},
closed_text AS (
  SELECT o_orderkey AS row_no,
         (['ATI', 'BUY', 'CN', 'CR', 'DVR', 'DVU', 'EFT', 'GST', 'QST', 'SEL', 'TFE', 'TSF', 'VFN',
           'VFR', 'ZZZ'])[CAST(o_orderkey % 15 + 1 AS INTEGER)] AS tran,
         'Holding ' || o_custkey || ' ' AS description,
         CASE WHEN o_orderkey % 7 = 0 THEN '' WHEN o_orderkey % 23 = 0 THEN '  '
              ELSE ' P' || (o_custkey % 20) END AS symbol,
         (o_orderkey % 70 - 35) || '.' || lpad(CAST(o_custkey % 10000 AS VARCHAR), 4, '0') AS quantity_text,
         CASE WHEN o_orderkey % 11 = 0 THEN '0' ELSE '-' || (o_custkey % 300) || '.125' END AS cost_text,
         CASE WHEN o_orderkey % 47 = 0 THEN '' ELSE '1.00' END AS price_text,
         CASE WHEN o_orderkey % 4 = 0 THEN '0.00' ELSE {_MONEY} END AS amount_text,
         CASE WHEN o_orderkey % 43 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS date
  FROM src),
closed AS (
  SELECT *, -round({_number("amount_text")}, 3) AS amount,
         round({_number("quantity_text")}, 3) AS units,
         abs(round({_number("cost_text")}, 3)) AS cost,
         CASE WHEN symbol = '' THEN 'UNKNOWNSEC' ELSE symbol END AS sec,
         CASE WHEN tran = 'DVU' THEN 'USD' ELSE 'CAD' END AS cur,
         CASE WHEN tran IN ('ATI', 'TSF') THEN CASE WHEN symbol = '' THEN 'cash' ELSE 'move' END
              WHEN tran = 'BUY' THEN CASE WHEN symbol = '' THEN 'none' ELSE 'buy' END
              WHEN tran = 'SEL' THEN CASE WHEN symbol = '' THEN 'none' ELSE 'sell' END
              WHEN tran IN ('DVR', 'DVU') THEN
                CASE WHEN {_number("amount_text")} <> 0 THEN 'cash'
                     WHEN {_number("cost_text")} <> 0 THEN 'move' ELSE 'none' END
              ELSE 'cash' END AS shape,
         CASE WHEN tran IN ('ATI', 'TSF', 'CN', 'CR', 'EFT') THEN 'Assets:Investments:Owner:TODO'
              WHEN tran IN ('DVR', 'DVU') THEN 'Income:Investments:Owner:Taxable:Dividend'
              WHEN tran = 'SEL' THEN 'Income:Investments:Owner:Taxable:GainLoss'
              ELSE 'Expenses:Investments:Owner:Fees' END AS counter
  FROM closed_text
  WHERE tran <> 'ZZZ' AND price_text <> '' AND date IS NOT NULL
    AND {_number("amount_text")} IS NOT NULL)"""

_CLOSED_LEGS = " UNION ALL ".join(
    [
        _leg("closed", 0, _SEC, "units", "sec", "cost", "cur", "shape IN ('buy', 'move')"),
        _leg("closed", 0, _SEC, "units", "sec", "NULL", "NULL", "shape = 'sell'"),
        _leg("closed", 0, _CASH, "amount", "cur", "NULL", "NULL", "shape = 'cash'"),
        _leg("closed", 1, _CASH, "amount", "cur", "NULL", "NULL", "shape IN ('buy', 'sell')"),
        _blank("closed", 1, "counter", "shape IN ('cash', 'move')"),
        _blank("closed", 2, "counter", "shape = 'sell'"),
    ]
)

_OWNER = """CASE c_mktsegment WHEN 'BUILDING' THEN 'Ann' WHEN 'MACHINERY' THEN 'Bob'
  WHEN 'HOUSEHOLD' THEN 'Joint' ELSE 'UNKNOWN' END"""

_HOLDINGS = f"""hold AS (
  SELECT c_custkey AS statement_no, CAST(0 AS BIGINT) AS file_no, DATE '2024-01-31' AS date,
         1 AS action,
         'Assets:Investments:' || {_OWNER} || ':A' || c_nationkey
           || CASE WHEN c_custkey % 4 = 0 THEN ':Cash' ELSE ':Securities' END AS account,
         CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,10)) AS quantity,
         CASE WHEN c_custkey % 8 = 0 THEN 'USD' WHEN c_custkey % 4 = 0 THEN 'CAD'
              ELSE 'P' || (c_custkey % 20) END AS commodity
  FROM customer WHERE c_custkey % 53 <> 0)"""

_REJECTS = f"""WITH {_ACT}
SELECT 'us' AS export, o_orderkey AS row_no, 'net_amount is not a number' AS reason
FROM orders WHERE o_orderkey % 29 = 0
UNION ALL
SELECT 'activities', row_no,
  CASE WHEN tran IN ('UNKNOWN TYPE', 'buy') THEN 'unknown transaction type'
       WHEN price IS NULL THEN 'price is not a number'
       WHEN raw_amount IS NULL THEN 'amount is not a number'
       ELSE 'settled is not a date' END
FROM act_all
WHERE tran IN ('UNKNOWN TYPE', 'buy') OR price IS NULL OR raw_amount IS NULL OR date IS NULL
UNION ALL
SELECT 'closed', o_orderkey,
  CASE WHEN o_orderkey % 15 = 14 THEN 'unknown transaction type'
       WHEN o_orderkey % 47 = 0 THEN 'price is not a number'
       WHEN o_orderkey % 29 = 0 AND o_orderkey % 4 <> 0 THEN 'amount is not a number'
       ELSE 'settle_date is not a date' END
FROM orders
WHERE o_orderkey % 15 = 14 OR o_orderkey % 47 = 0 OR (o_orderkey % 29 = 0 AND o_orderkey % 4 <> 0)
   OR o_orderkey % 43 = 0
UNION ALL
SELECT 'holdings', c_custkey, 'book_value is not a number' FROM customer WHERE c_custkey % 53 = 0"""

# --- text out -------------------------------------------------------------------

_COMPLETE = """account IS NOT NULL AND cp_commodity_final IS NOT NULL AND cp_quantity_final IS NOT NULL
  AND tc_commodity_final IS NOT NULL AND tc_quantity_final IS NOT NULL"""

_RENDER = f"""WITH {_TXN}, {_POST}, {_fill()},
ext AS (SELECT transaction_no, min(statement_no) FILTER ({_COMPLETE}) AS first_no
        FROM done GROUP BY transaction_no)
SELECT date, first_no AS statement_no, transaction_no, 0 AS part, '' AS line
FROM txn JOIN ext ON txn.statement_no = transaction_no WHERE first_no IS NOT NULL
UNION ALL
SELECT date, first_no, transaction_no, 1,
       transaction_no || ': ' || strftime(date, '%Y-%m-%d') || ' * "' || narration || '" ' || coalesce(tags, '')
FROM txn JOIN ext ON txn.statement_no = transaction_no WHERE first_no IS NOT NULL
UNION ALL
SELECT date, done.statement_no, transaction_no, 2,
       CASE WHEN NOT ({_COMPLETE}) THEN 'Nothing'
            WHEN cp_commodity_final = tc_commodity_final
              THEN '  ' || account || ' ' || cp_quantity_final || ' ' || cp_commodity_final
            ELSE '  ' || account || ' ' || cp_quantity_final || ' ' || cp_commodity_final
                 || ' @@ ' || tc_quantity_final || ' ' || tc_commodity_final END
FROM done JOIN txn ON transaction_no = txn.statement_no
UNION ALL
SELECT date, NULL, statement_no, 2, 'Nothing'
FROM txn WHERE NOT EXISTS (SELECT 1 FROM post WHERE post.transaction_no = txn.statement_no)"""

# --- text in --------------------------------------------------------------------

# Orders whose line run is cut by a comment after item 5 lose what comes later in it.
_KEPT = "(transaction_no % 53 <> 0 OR statement_no % 16 <= 5)"

_RAW_LINE = """'  ' || account
  || coalesce(' ' || cp_quantity || ' ' || cp_commodity, '')
  || coalesce(' @@ ' || tc_quantity || ' ' || tc_commodity, '')"""

# Where every line of the book stands, and its number: 2**36 times the file's plus its place in it.
_LINES = "lines AS (SELECT transaction_no // 4096 AS file_no, statement_no * 2 AS pos FROM post" + "".join(
    f" UNION ALL SELECT o_orderkey // 4096, (o_orderkey * 16 + {slot}) * 2 + {after} FROM orders WHERE {when}"
    for slot, after, when in [
        (0, 0, "true"),
        (0, 1, "o_orderkey % 43 = 0"),
        (5, 1, "o_orderkey % 53 = 0"),
        (10, 0, "o_orderkey % 3 = 0"),
        (11, 0, "o_orderkey % 3 = 1"),
        (12, 0, "o_orderkey % 4 < 3"),
        (12, 1, "o_orderkey % 44 = 0 OR o_orderkey % 28 = 1"),
        (13, 0, "o_orderkey % 23 = 0"),
        (13, 0, "o_orderkey % 29 = 0"),
        (13, 0, "o_orderkey % 31 = 0"),
        (14, 0, "o_orderkey % 37 = 0"),
        (14, 1, "o_orderkey % 74 = 0"),
        (13, 1, "o_orderkey % 41 = 0"),
        (15, 0, "o_orderkey % 3 = 2"),
        (15, 1, "o_orderkey % 61 = 0"),
    ]
) + """),
numbered AS (SELECT pos, file_no * 68719476736 + row_number() OVER (PARTITION BY file_no ORDER BY pos) AS number
             FROM lines)"""

#: Some narrations go on over a line end.
_TOLD = """CASE WHEN txn.statement_no % 43 = 0 THEN 'Order' || chr(10) || substr(narration, 7)
     ELSE narration END AS narration"""
_DAY = "strftime(CAST(o_orderdate AS DATE), '%Y-%m-%d')"

# --- bank statements ------------------------------------------------------------

# Faulty statements: no currency, no account, outside a statement.
_STATED = """CASE WHEN c_custkey % 39 = 0 THEN 'no currency'
              WHEN c_custkey % 47 = 0 AND c_custkey % 3 <> 0 THEN 'outside a statement' END AS fault,"""
_BANK = f"""bank AS (
  SELECT o_custkey, o_orderkey,
         coalesce('Assets:Bank:B' || s_suppkey, CAST(c_custkey AS VARCHAR)) AS account,
         {_STATED}
         CASE WHEN c_custkey % 3 = 0 THEN 'USD' ELSE 'CAD' END AS commodity,
         CASE WHEN o_orderkey % 59 <> 0 THEN CAST(o_orderdate AS DATE) END AS date,
         CASE WHEN o_orderkey % 61 <> 0
              THEN CAST(-CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,10)) END AS quantity,
         CASE WHEN o_orderkey % 12 = 0 THEN 'PROBLEM'
              WHEN o_orderkey % 4 = 0 THEN 'for <' || o_orderpriority || '>'
              WHEN o_orderkey % 6 = 0 THEN 'Tom &amp; Co ' || o_orderkey
              ELSE 'Tom &amp; Co ' || o_orderkey || ' / for <' || o_orderpriority || '>' END AS narration
  FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN supplier ON s_suppkey = c_custkey),
moves AS (
  SELECT *, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS number
  FROM bank WHERE date IS NOT NULL AND quantity IS NOT NULL AND fault IS NULL)"""


def oracle_sql() -> dict[str, str]:
    return {
        "fx_transactions": f"WITH {_TXN} SELECT * FROM txn",
        "fx_postings": f"WITH {_POST} SELECT * FROM post",
        "complete_transactions": f"{_DONE} SELECT * FROM done",
        "balancing_rows": f"{_DONE} SELECT * FROM off",
        "imbalances": _IMBALANCES,
        "imbalances_of_completed": _IMBALANCES,
        "normalise_verifications": f"WITH {_VERIF} SELECT * FROM norm",
        "default_cost_to_units": f"""WITH {_POST}
SELECT statement_no, transaction_no, file_no, account, cp_quantity, cp_commodity,
       coalesce(tc_quantity, cp_quantity) AS tc_quantity,
       coalesce(tc_commodity, cp_commodity) AS tc_commodity FROM post""",
        "account_hierarchy": f"WITH {_POST}, {_ANCESTORS} SELECT account FROM tree",
        "commodities_cp": f"{_DONE} SELECT DISTINCT cp_commodity_final FROM done",
        "commodities_tc": f"{_DONE} SELECT DISTINCT tc_commodity_final FROM done",
        "account_totals_tc": _totals("tc"),
        "account_totals_cp": _totals("cp"),
        "balances_tc": _balances("tc"),
        "balances_cp": _balances("cp"),
        "dated_postings": f"""WITH {_TXN}, {_POST}, {_fill()}
SELECT transaction_no, date, account, cp_commodity_final, cp_quantity_final,
       tc_commodity_final, tc_quantity_final
FROM done LEFT JOIN txn ON transaction_no = txn.statement_no""",
        "reconcile_books": f"""WITH {_TXN}, {_POST}, {_fill()},
post_b AS (SELECT * REPLACE (CASE WHEN transaction_no % 50 = 0 AND statement_no % 2 = 1
                                  THEN tc_quantity + 1 ELSE tc_quantity END AS tc_quantity) FROM post),
{_fill("post_b", "_b")},
a AS (SELECT transaction_no, date, account, cp_commodity_final, cp_quantity_final,
             tc_commodity_final, tc_quantity_final
      FROM done LEFT JOIN txn ON transaction_no = txn.statement_no),
b AS (SELECT CASE WHEN txn.statement_no % 97 = 0 THEN CAST(date + INTERVAL 1 DAY AS DATE) ELSE date END AS date,
             account, cp_commodity_final, cp_quantity_final, tc_commodity_final, tc_quantity_final
      FROM done_b LEFT JOIN txn ON transaction_no = txn.statement_no)
SELECT * FROM a WHERE NOT EXISTS (
  SELECT 1 FROM b WHERE a.date = b.date AND a.account = b.account
    AND a.cp_commodity_final = b.cp_commodity_final AND a.cp_quantity_final = b.cp_quantity_final
    AND a.tc_commodity_final = b.tc_commodity_final AND a.tc_quantity_final = b.tc_quantity_final)""",
        "us_transactions": f"""WITH {_US}
SELECT {_HEAD}, trim(description || '-' || details) AS narration, CAST(NULL AS VARCHAR) AS tags
FROM us WHERE {_US_OK} AND shape <> 'skip'""",
        "us_postings": f"WITH {_US} {_US_LEGS}",
        "us_skipped": f"WITH {_US} SELECT row_no, description FROM us WHERE {_US_OK} AND shape = 'skip'",
        "activities_transactions": f"""WITH {_ACT}
SELECT {_HEAD}, {_ACT_NAMES} || ':' || description AS narration, CAST(NULL AS VARCHAR) AS tags
FROM act WHERE shape <> 'none'""",
        "activities_postings": f"WITH {_ACT} {_ACT_LEGS}",
        "closed_transactions": f"""WITH {_CLOSED}
SELECT {_HEAD}, trim(tran || ' - ' || description) AS narration, CAST(NULL AS VARCHAR) AS tags
FROM closed WHERE shape <> 'none'""",
        "closed_postings": f"WITH {_CLOSED} {_CLOSED_LEGS}",
        "holdings_balances": f"WITH {_HOLDINGS} SELECT * FROM hold",
        "import_rejects": _REJECTS,
        "import_summary": f"""WITH {_ACT}, {_HOLDINGS}
SELECT (SELECT count(*) FROM act WHERE shape <> 'none') AS transactions,
       (SELECT count(*) FROM ({_ACT_LEGS}) l) AS postings,
       (SELECT count(*) FROM hold) AS balances""",
        "commodity_side_output": f"""WITH {_CLOSED}
SELECT trim(symbol) AS symbol, description FROM closed WHERE trim(symbol) <> ''""",
        "symbol_lookup": f"WITH {_ACT} SELECT row_no, description, symbol FROM act_all",
        "account_lookup": """SELECT c_custkey,
  coalesce('Assets:Bank:B' || s_suppkey, CAST(c_custkey AS VARCHAR)) AS account
FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""",
        "owner_lookup": f"""SELECT c_custkey AS row_no, c_mktsegment AS client_name, {_OWNER} AS owner
FROM customer""",
        "money_parse": f"""WITH {_US}
SELECT row_no, net_amount, {_number("net_amount")} AS amount FROM us_text""",
        "account_names": """SELECT c_custkey, kind,
  CASE kind WHEN 'Cash' THEN 'Assets:Investments:' || c_mktsegment || ':A' || c_custkey || ':Cash'
            WHEN 'Securities' THEN 'Assets:Investments:' || c_mktsegment || ':A' || c_custkey || ':Securities'
            WHEN 'TODO' THEN 'Assets:Investments:' || c_mktsegment || ':TODO'
            WHEN 'Fees' THEN 'Expenses:Investments:' || c_mktsegment || ':Fees'
            WHEN 'ForeignTax' THEN 'Expenses:Investments:' || c_mktsegment || ':ForeignTax'
            ELSE 'Income:Investments:' || c_mktsegment || ':Taxable:' || kind END AS account
FROM customer, (SELECT unnest(['Cash', 'Securities', 'TODO', 'CapitalGains', 'Distribution', 'Dividend',
  'LongTermCapitalGains', 'ShortTermCapitalGains', 'GainLoss', 'Interest', 'Fees', 'ForeignTax']) AS kind) k""",
        "render_transactions": _RENDER,
        "render_verifications": f"""WITH {_VERIF}
SELECT *, strftime(date, '%Y-%m-%d') || CASE action WHEN 0 THEN ' open ' || account
    WHEN 2 THEN ' close ' || account
    ELSE ' balance ' || account || ' ' || quantity || ' ' || commodity END AS line
FROM norm WHERE action <> 1 OR commodity IS NOT NULL""",
        "render_verification_rejects": f"""WITH {_VERIF}
SELECT * FROM norm WHERE action = 1 AND commodity IS NULL""",
        "scan_text_transactions": f"""WITH {_TXN}, {_POST}, {_LINES}
SELECT number AS statement_no, date, {_TOLD}, tags
FROM txn JOIN numbered ON pos = txn.statement_no * 32 + CASE WHEN txn.statement_no % 43 = 0 THEN 1 ELSE 0 END""",
        "scan_text_postings": f"""WITH {_TXN}, {_POST}
SELECT {_TOLD}, account, cp_quantity, cp_commodity,
       coalesce(tc_quantity, cp_quantity) AS tc_quantity, coalesce(tc_commodity, cp_commodity) AS tc_commodity
FROM post JOIN txn ON transaction_no = txn.statement_no
WHERE transaction_no % 53 <> 0 OR post.statement_no % 16 <= 5""",
        "scan_text_verifications": f"""WITH {_POST}, {_LINES}
SELECT number AS statement_no, o_orderkey // 4096 AS file_no, CAST(o_orderdate AS DATE) AS date,
       CASE o_orderkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS action,
       'Assets:Customers:C' || o_orderkey AS account,
       CASE WHEN o_orderkey % 3 = 1 THEN CAST('-' || o_orderkey || '.125' AS DECIMAL(38,10)) END AS quantity,
       CASE WHEN o_orderkey % 3 = 1 THEN 'USD' END AS commodity
FROM orders JOIN numbered
  ON pos = (o_orderkey * 16 + CASE o_orderkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 11 ELSE 15 END) * 2""",
        "scan_text_info": """
SELECT o_orderkey // 4096 AS file_no,
       CASE WHEN o_orderkey % 4 <> 1 THEN CAST(o_orderdate AS DATE) END AS date,
       CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 4 ELSE 5 END AS action,
       CASE WHEN o_orderkey % 28 = 1 THEN 'ti' || chr(10) || 'tle'
            WHEN o_orderkey % 4 = 0 THEN 'place' WHEN o_orderkey % 4 = 1 THEN 'title' END AS attribute,
       CASE WHEN o_orderkey % 4 = 2 THEN ' "budget" ' || o_orderkey
            WHEN o_orderkey % 44 = 0 THEN chr(10) || o_orderkey
            ELSE CAST(o_orderkey AS VARCHAR) END AS value
FROM orders WHERE o_orderkey % 4 <> 3""",
        "scan_text_includes": """
SELECT 'part-' || o_orderkey || CASE WHEN o_orderkey % 74 = 0 THEN chr(10) ELSE '' END || '.book' AS path
FROM orders WHERE o_orderkey % 37 = 0""",
        "scan_text_rejects": f"""WITH {_POST}
SELECT {_RAW_LINE} AS line, 'posting without a transaction' AS reason FROM post WHERE NOT {_KEPT}
UNION ALL
SELECT {_DAY} || ' open Assets:Customers:C' || o_orderkey || ' USD', 'not a complete statement'
FROM orders WHERE o_orderkey % 23 = 0
UNION ALL
SELECT '   stray ' || o_orderkey, 'not a complete statement' FROM orders WHERE o_orderkey % 29 = 0
UNION ALL
SELECT {_DAY} || ' * "never ends ' || o_orderkey, 'not a complete statement' FROM orders WHERE o_orderkey % 61 = 0""",
        "scan_text_empty_headers": f"""WITH {_TXN}, {_POST}
SELECT date, {_TOLD}, tags FROM txn WHERE NOT EXISTS (
  SELECT 1 FROM post WHERE post.transaction_no = txn.statement_no AND {_KEPT.replace("statement_no", "post.statement_no")})""",
        "qfx_transactions": f"""WITH {_BANK}
SELECT number AS statement_no, CAST(0 AS BIGINT) AS file_no, date, narration,
       CAST(NULL AS VARCHAR) AS tags FROM moves""",
        "qfx_postings": f"""WITH {_BANK}
SELECT number AS statement_no, number AS transaction_no, CAST(0 AS BIGINT) AS file_no, account,
       quantity AS cp_quantity, commodity AS cp_commodity,
       quantity AS tc_quantity, commodity AS tc_commodity FROM moves""",
        "qfx_balances": f"""WITH {_BANK}
SELECT (SELECT count(*) FROM moves) + row_number() OVER (ORDER BY c_custkey) AS statement_no,
       CAST(0 AS BIGINT) AS file_no, DATE '2024-01-31' AS date, 1 AS action,
       coalesce('Assets:Bank:B' || s_suppkey, CAST(c_custkey AS VARCHAR)) AS account,
       CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(38,10)) AS quantity,
       CASE WHEN c_custkey % 3 = 0 THEN 'USD' ELSE 'CAD' END AS commodity
FROM (SELECT {_STATED} * FROM customer) LEFT JOIN supplier ON s_suppkey = c_custkey WHERE fault IS NULL""",
        "qfx_rejects": f"""WITH {_BANK},
held AS (SELECT coalesce('Assets:Bank:B' || s_suppkey, CAST(c_custkey AS VARCHAR)) AS account, {_STATED}
                DATE '2024-01-31' AS date, 1 AS quantity
         FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey),
entries AS (SELECT account, fault, date, quantity FROM bank UNION ALL SELECT account, fault, date, quantity FROM held)
SELECT CASE WHEN fault IS DISTINCT FROM 'outside a statement' THEN account END AS account,
       coalesce(fault, CASE WHEN date IS NULL THEN 'date cannot be read' ELSE 'amount cannot be read' END) AS reason
FROM entries WHERE fault IS NOT NULL OR date IS NULL OR quantity IS NULL""",
    }
