"""SQL text helpers for the DuckDB oracle (independent re-statement of each
operator in ANSI-ish SQL over the driver's tables)."""

from __future__ import annotations


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def cents(x: str) -> str:
    return f"CAST(format('{{:.2f}}', CAST({x} AS DOUBLE)) AS DOUBLE)"


def cur(x: str) -> str:
    return (f"(CASE WHEN {x} < 0 THEN '-$' ELSE '$' END || "
            f"format('{{:,.2f}}', abs(CAST({x} AS DOUBLE))))")


def money2(x: str) -> str:
    return f"format('{{:,.2f}}', CAST({x} AS DOUBLE))"


def parent(d: str) -> str:
    return (f"(CASE WHEN {d} IS NULL THEN NULL WHEN strpos({d}, '_') > 0 "
            f"THEN string_split({d}, '_')[-1] ELSE 'OTHER' END)")


def sub(d: str) -> str:
    return (f"(CASE WHEN strpos({d}, '_') > 0 THEN "
            f"left({d}, length({d}) - length(string_split({d}, '_')[-1]) - 1) ELSE {d} END)")


def ymd(d: str) -> str:
    return f"strftime({d}, '%Y-%m-%d')"


def fill(template: str, **exprs: str) -> str:
    parts = []
    rest = template
    while "{" in rest:
        pre, _, tail = rest.partition("{")
        key, _, rest = tail.partition("}")
        if pre:
            parts.append(q(pre))
        parts.append(f"({exprs[key]})")
    if rest:
        parts.append(q(rest))
    return "(" + " || ".join(parts) + ")"


LEDGER = """
txn AS (
  SELECT 'usr_' || CAST(o_custkey AS VARCHAR) AS user_id,
         c_name AS user_name,
         CAST(o_orderdate AS DATE) AS transaction_date,
         CAST(CASE WHEN l_returnflag = 'R' THEN -l_extendedprice ELSE l_extendedprice END
              AS DECIMAL(18,2)) AS transaction_amount,
         p_type || '_' || upper(p_brand) AS transaction_category_detail,
         s_name AS merchant_name
  FROM lineitem
  JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON c_custkey = o_custkey
  JOIN part ON p_partkey = l_partkey
  JOIN supplier ON s_suppkey = l_suppkey
)"""

OWNER_TOTALS = """
ot AS (
  SELECT user_id, min(user_name) AS user_name, count(*) AS n_rows,
         count(*) FILTER (WHERE transaction_amount > 0) AS n_expense,
         count(*) FILTER (WHERE transaction_amount < 0) AS n_income,
         coalesce(sum(transaction_amount) FILTER (WHERE transaction_amount > 0), 0) AS total_expense,
         coalesce(sum(transaction_amount) FILTER (WHERE transaction_amount < 0), 0) AS total_income_signed,
         min(transaction_date) AS first_date, max(transaction_date) AS last_date,
         min(transaction_date) FILTER (WHERE transaction_amount > 0) AS first_expense_date,
         max(transaction_date) FILTER (WHERE transaction_amount > 0) AS last_expense_date
  FROM txn GROUP BY user_id
)"""

AVG_EXPENSE = ("CASE WHEN n_expense > 0 THEN " + cents("CAST(total_expense AS DOUBLE) / n_expense")
               + " ELSE 0.0 END")
AVG_MONTHLY = ("CASE WHEN n_expense > 0 THEN " + cents(
    "CAST(total_expense AS DOUBLE) / (datediff('month', first_expense_date, last_expense_date) + 1)")
    + " ELSE 0.0 END")

CAT_TOTALS = f"""
ct AS (
  SELECT user_id, {parent('transaction_category_detail')} AS parent_category,
         sum(transaction_amount) AS total_expense, count(*) AS n_transactions
  FROM txn WHERE transaction_amount > 0 AND transaction_category_detail IS NOT NULL
  GROUP BY ALL
)"""

TOP_CATS = """
tc AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id
                                 ORDER BY total_expense DESC, parent_category ASC) AS rank
    FROM ct) WHERE rank <= 5
)"""

MER_TOTALS = """
mt AS (
  SELECT user_id, merchant_name, sum(transaction_amount) AS total_expense,
         count(*) AS n_transactions
  FROM txn WHERE transaction_amount > 0 AND merchant_name IS NOT NULL GROUP BY ALL
)"""

TOP_MERS = """
tm AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id
                                 ORDER BY total_expense DESC, merchant_name ASC) AS rank
    FROM mt) WHERE rank <= 10
)"""

REF = """
rf AS (SELECT *, max(transaction_date) OVER (PARTITION BY user_id) AS ref_date FROM txn)"""

MONTHLY_EXPENSE = """
me AS (
  SELECT user_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
         sum(transaction_amount) AS expense
  FROM txn WHERE transaction_amount > 0 GROUP BY ALL
),
meb AS (SELECT user_id, min(month) AS lo, max(month) AS hi FROM me GROUP BY ALL),
mes AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month
        FROM meb),
mef AS (SELECT mes.user_id, mes.month, coalesce(me.expense, 0) AS expense
        FROM mes LEFT JOIN me USING (user_id, month))"""


def with_(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"
