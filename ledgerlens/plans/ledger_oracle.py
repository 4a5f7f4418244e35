"""Oracle SQL (DuckDB) for the ledger queries in ``ledger_queries``."""

from __future__ import annotations

from ..operators.profile import FALLBACK_TEMPLATE, NO_DATA_TEMPLATE, NO_PROFILE_TEXT, NO_ROWS_TEXT
from ..sources.derived import OWNER_CONVERSATIONS
from .ledger_queries import TREND_CATEGORY
from .sql import (AVG_EXPENSE, AVG_MONTHLY, CAT_TOTALS, LEDGER, MER_TOTALS, MONTHLY_EXPENSE,
                  OWNER_TOTALS, REF, TOP_CATS, TOP_MERS, cents, cur, fill, money2, parent, q,
                  sub, with_, ymd)

W = with_

ORACLE: dict[str, str] = {}

ORACLE["roster"] = W(LEDGER) + """
SELECT DISTINCT user_id, user_name, user_name || ' (' || user_id || ')' AS label FROM txn"""

ORACLE["available_users"] = W(LEDGER) + """
SELECT user_id, count(*) AS n_transactions FROM txn GROUP BY user_id"""

ORACLE["category_parse"] = W(LEDGER) + f"""
SELECT transaction_category_detail, count(*) AS n_rows,
       {parent('transaction_category_detail')} AS parent_category,
       {sub('transaction_category_detail')} AS subcategory
FROM txn GROUP BY transaction_category_detail"""

ORACLE["lookback_rows"] = W(LEDGER, REF) + """
SELECT user_id, user_name, transaction_date, CAST(transaction_amount AS DOUBLE) AS transaction_amount,
       transaction_category_detail, merchant_name, ref_date,
       CAST(ref_date - INTERVAL 3 MONTH AS DATE) AS cutoff_date
FROM rf WHERE transaction_date >= ref_date - INTERVAL 3 MONTH"""

ORACLE["expense_rows"] = W(LEDGER) + """
SELECT user_id, transaction_date, CAST(transaction_amount AS DOUBLE) AS transaction_amount,
       transaction_category_detail, merchant_name FROM txn WHERE transaction_amount > 0"""

ORACLE["income_rows"] = W(LEDGER) + """
SELECT user_id, transaction_date, CAST(transaction_amount AS DOUBLE) AS transaction_amount,
       transaction_category_detail, merchant_name FROM txn WHERE transaction_amount < 0"""

ORACLE["sign_split"] = W(LEDGER) + """
SELECT user_id, transaction_amount > 0 AS is_expense,
       CAST(sum(transaction_amount) AS DOUBLE) AS total, count(*) AS n
FROM txn GROUP BY ALL"""

ORACLE["totals"] = W(LEDGER, OWNER_TOTALS) + f"""
SELECT user_id, user_name, n_rows, n_expense, n_income,
       CAST(total_expense AS DOUBLE) AS total_expense,
       CAST(abs(total_income_signed) AS DOUBLE) AS total_income,
       CAST(total_income_signed AS DOUBLE) AS total_income_signed,
       CAST(abs(total_income_signed) - total_expense AS DOUBLE) AS net,
       {AVG_EXPENSE} AS avg_expense, first_date, last_date
FROM ot"""

_QUARTILES = ", ".join(
    f"CAST(xs[CAST(floor((n - 1) * {f}) AS BIGINT) + 1] + (xs[CAST(ceil((n - 1) * {f}) AS BIGINT) + 1]"
    f" - xs[CAST(floor((n - 1) * {f}) AS BIGINT) + 1]) * CAST((n - 1) * {f} - floor((n - 1) * {f}) AS DECIMAL(9,6))"
    f" AS DOUBLE) AS {k}" for k, f in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
ORACLE["amount_describe"] = W(LEDGER) + f"""
, g AS (SELECT user_id, count(transaction_amount) AS n, sum(transaction_amount) AS total,
          sum(transaction_amount * transaction_amount) AS squares, min(transaction_amount) AS lo,
          max(transaction_amount) AS hi, list_sort(list(transaction_amount)) AS xs
        FROM txn GROUP BY user_id)
SELECT user_id, n, CAST(total AS DOUBLE) AS total, CAST(lo AS DOUBLE) AS min_amount, CAST(hi AS DOUBLE) AS max_amount,
       {_QUARTILES}, {cents('CAST(total AS DOUBLE) / n')} AS mean_amount,
       CASE WHEN n > 1 THEN {cents('sqrt(greatest((CAST(squares AS DOUBLE) - CAST(total AS DOUBLE) * CAST(total AS DOUBLE) / n) / (n - 1), 0))')} END AS std_amount
FROM g"""

ORACLE["owner_rows"] = W(LEDGER) + """
SELECT user_id, user_name, transaction_date, CAST(transaction_amount AS DOUBLE) AS transaction_amount,
       transaction_category_detail, merchant_name FROM txn WHERE user_id = 'usr_1'"""

ORACLE["category_totals"] = W(LEDGER, CAT_TOTALS) + """
SELECT user_id, parent_category, CAST(total_expense AS DOUBLE) AS total_expense, n_transactions
FROM ct WHERE parent_category IS NOT NULL"""

ORACLE["top_categories"] = W(LEDGER, CAT_TOTALS, TOP_CATS) + """
SELECT user_id, parent_category, CAST(total_expense AS DOUBLE) AS total_expense, rank FROM tc"""

ORACLE["merchant_totals"] = W(LEDGER, MER_TOTALS) + """
SELECT user_id, merchant_name, CAST(total_expense AS DOUBLE) AS total_expense, n_transactions FROM mt"""

ORACLE["top_merchants"] = W(LEDGER, MER_TOTALS, TOP_MERS) + """
SELECT user_id, merchant_name, CAST(total_expense AS DOUBLE) AS total_expense, rank FROM tm"""


def _breakdown(months: int, top_n: int) -> str:
    return W(LEDGER, REF) + f"""
, w AS (SELECT user_id, {parent('transaction_category_detail')} AS parent_category, transaction_amount
        FROM rf WHERE transaction_date >= ref_date - INTERVAL {months} MONTH
          AND transaction_amount > 0),
ct AS (SELECT user_id, parent_category, sum(transaction_amount) AS amount
       FROM w WHERE parent_category IS NOT NULL GROUP BY ALL),
rk AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY amount DESC, parent_category) AS rank,
              count(*) OVER (PARTITION BY user_id) AS n_categories FROM ct),
b AS (SELECT user_id, (n_categories > {top_n} AND rank > {top_n}) AS is_other,
             CASE WHEN n_categories > {top_n} AND rank > {top_n} THEN 'Other'
                  ELSE parent_category END AS category,
             sum(amount) AS amount, min(rank) AS slice_order
      FROM rk GROUP BY ALL),
t AS (SELECT *, sum(amount) OVER (PARTITION BY user_id) AS total FROM b),
p AS (SELECT *, CAST(amount AS DOUBLE) / CAST(total AS DOUBLE) * 100 AS pct FROM t)
SELECT user_id, category, is_other, CAST(amount AS DOUBLE) AS amount, CAST(total AS DOUBLE) AS total,
       slice_order, pct, pct >= 5 AS show_label,
       category || '  (' || format('{{:.1f}}', pct) || '%, ' || {cur('amount')} || ')' AS legend
FROM p"""


ORACLE["category_breakdown"] = _breakdown(3, 7)
ORACLE["category_breakdown_all"] = _breakdown(999, 2)

ORACLE["monthly_spend"] = W(LEDGER, MONTHLY_EXPENSE) + """
SELECT user_id, month, strftime(month, '%Y_%m') AS month_key, CAST(expense AS DOUBLE) AS expense
FROM mef"""


def _trend(months: int, category: str | None) -> str:
    cat = (f" AND {parent('transaction_category_detail')} = {q(category.upper())}"
           if category else "")
    title = "Monthly Spending Trend" + (f" — {category.title()}" if category else "")
    return W(LEDGER, REF) + f"""
, w AS (SELECT * FROM rf WHERE transaction_date >= ref_date - INTERVAL {months} MONTH
          AND transaction_amount > 0{cat}),
m AS (SELECT user_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
             sum(transaction_amount) AS total FROM w GROUP BY ALL),
mb AS (SELECT user_id, min(month) AS lo, max(month) AS hi FROM m GROUP BY ALL),
ms AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM mb),
f AS (SELECT ms.user_id, ms.month, coalesce(m.total, 0) AS total FROM ms LEFT JOIN m USING (user_id, month))
SELECT user_id, month, strftime(month, '%b %Y') AS label, CAST(total AS DOUBLE) AS total,
       CASE WHEN count(*) OVER (PARTITION BY user_id) >= 3
            THEN CAST(sum(total) OVER w3 AS DOUBLE) / count(*) OVER w3 END AS avg3,
       {q(title)} AS title
FROM f
WINDOW w3 AS (PARTITION BY user_id ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""


ORACLE["monthly_trend"] = _trend(6, None)
ORACLE["monthly_trend_category"] = _trend(6, TREND_CATEGORY)

ORACLE["income_vs_expense"] = W(LEDGER, REF) + """
, w AS (SELECT * FROM rf WHERE transaction_date >= ref_date - INTERVAL 6 MONTH),
m AS (SELECT user_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
             coalesce(-sum(transaction_amount) FILTER (WHERE transaction_amount < 0), 0) AS income,
             coalesce(sum(transaction_amount) FILTER (WHERE transaction_amount > 0), 0) AS expense
      FROM w GROUP BY ALL),
mb AS (SELECT user_id, min(month) AS lo, max(month) AS hi FROM m GROUP BY ALL),
ms AS (SELECT user_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS DATE) AS month FROM mb),
f AS (SELECT ms.user_id, ms.month, coalesce(m.income, 0) AS income, coalesce(m.expense, 0) AS expense
      FROM ms LEFT JOIN m USING (user_id, month))
SELECT user_id, month, strftime(month, '%b %Y') AS label, CAST(income AS DOUBLE) AS income,
       CAST(expense AS DOUBLE) AS expense, CAST(income - expense AS DOUBLE) AS net
FROM f"""

ORACLE["avg_monthly_spend"] = W(LEDGER, OWNER_TOTALS) + f"""
SELECT user_id, {AVG_MONTHLY} AS avg_monthly_spend FROM ot"""

ORACLE["users_without_data"] = W(LEDGER, OWNER_TOTALS, REF) + f"""
, nd AS (SELECT user_id FROM rf WHERE transaction_date >= ref_date - INTERVAL 1 MONTH
         GROUP BY user_id HAVING count(*) FILTER (WHERE transaction_amount > 0) = 0)
SELECT user_id,
       {fill(NO_DATA_TEMPLATE, name='user_name', start=ymd('first_date'), end=ymd('last_date'))}
         AS response,
       'NO_DATA_FOR_QUERY' AS flag
FROM ot WHERE user_id IN (SELECT user_id FROM nd)"""

_CAT_TEXT = f"string_agg(parent_category || ' (' || {cur('total_expense')} || ')', ', ' ORDER BY rank)"
_PROFILE = (OWNER_TOTALS + "," + CAT_TOTALS + "," + TOP_CATS + f"""
, tct AS (SELECT user_id, {_CAT_TEXT} AS cat_text,
                 string_agg(CASE WHEN rank <= 3 THEN parent_category || ' (' || {cur('total_expense')}
                            || ')' END, ', ' ORDER BY rank) AS cat3_text
          FROM tc GROUP BY user_id),
pr AS (SELECT ot.*, {AVG_MONTHLY} AS avg_monthly_spend, tct.cat_text, tct.cat3_text
       FROM ot LEFT JOIN tct USING (user_id))""")

ORACLE["user_profile"] = W(LEDGER, _PROFILE) + f"""
SELECT user_id, user_name, {ymd('first_date')} AS date_range_start, {ymd('last_date')} AS date_range_end,
       n_rows AS total_transactions, coalesce(cat_text, '') AS top_categories, avg_monthly_spend,
       {cents('total_income_signed')} AS total_income, {cents('total_expense')} AS total_expense
FROM pr"""

ORACLE["profile_text"] = W(LEDGER, _PROFILE) + f"""
SELECT user_id, concat_ws(chr(10),
  'User: ' || user_name,
  'Data range: ' || {ymd('first_date')} || ' to ' || {ymd('last_date')},
  'Total transactions: ' || CAST(n_rows AS VARCHAR),
  'Average monthly spending: ' || {cur('avg_monthly_spend')},
  'Total income: ' || {cur(f"abs({cents('total_income_signed')})")},
  'Total expenses: ' || {cur(cents('total_expense'))},
  CASE WHEN cat_text IS NOT NULL THEN 'Top spending categories: ' || cat_text END) AS profile_text
FROM pr"""

ORACLE["fallback_answer"] = W(LEDGER, _PROFILE) + f"""
SELECT user_id, {fill(FALLBACK_TEMPLATE,
                      name="coalesce(user_name, 'you')",
                      start=ymd('first_date'), end=ymd('last_date'),
                      income=cur('abs(total_income_signed)'),
                      expense=cur('total_expense'),
                      net=cur('abs(total_income_signed) - total_expense'),
                      top="coalesce(cat3_text, '')",
                      avg=cur('avg_monthly_spend'))} AS fallback_answer
FROM pr"""

ORACLE["profile_card"] = W(LEDGER, _PROFILE) + f"""
, card_top AS (SELECT user_id, string_agg('- ' || parent_category || ': $' || {money2('total_expense')},
                                          chr(10) ORDER BY rank) AS top_text FROM tc GROUP BY user_id)
SELECT user_id, n_rows AS total_transactions,
       '$' || {money2(f"abs({cents('total_income_signed')})")} AS income,
       '$' || {money2(f"abs({cents('total_expense')})")} AS expenses,
       '$' || {money2('abs(avg_monthly_spend)')} AS avg_monthly_spend,
       'Data: ' || {ymd('first_date')} || ' to ' || {ymd('last_date')} AS caption,
       coalesce(card_top.top_text, '') AS top_categories
FROM pr LEFT JOIN card_top USING (user_id)"""

ORACLE["text_summary"] = W(LEDGER, OWNER_TOTALS, CAT_TOTALS, TOP_CATS, MER_TOTALS, TOP_MERS) + f"""
, c AS (SELECT user_id, string_agg(parent_category || ' ($' || {money2('total_expense')} || ')', ', '
                                   ORDER BY rank) AS cats FROM tc GROUP BY user_id),
mm AS (SELECT user_id, string_agg(merchant_name || ' ($' || {money2('total_expense')} || ')', ', '
                                  ORDER BY rank) AS mers FROM tm GROUP BY user_id)
SELECT user_id, concat_ws(chr(10),
  'Total rows: ' || CAST(n_rows AS VARCHAR),
  'Date range: ' || {ymd('first_date')} || ' to ' || {ymd('last_date')},
  'Total expenses: $' || {money2('total_expense')} || ' (' || CAST(n_expense AS VARCHAR) || ' transactions)',
  'Total income: $' || {money2('abs(total_income_signed)')} || ' (' || CAST(n_income AS VARCHAR) || ' transactions)',
  CASE WHEN n_expense > 0 THEN 'Top expense categories: ' || coalesce(cats, '') END,
  CASE WHEN n_expense > 0 AND mers IS NOT NULL THEN 'Top merchants by spend: ' || mers END,
  'Most recent transaction: ' || {ymd('last_date')}) AS text_summary
FROM ot LEFT JOIN c USING (user_id) LEFT JOIN mm USING (user_id)"""

DATA_SUMMARY_CTE = (OWNER_TOTALS + "," + CAT_TOTALS + "," + MER_TOTALS + "," + TOP_MERS + ","
                    + MONTHLY_EXPENSE + f"""
, ds AS (
  SELECT user_id, 'total_expense' AS key, {cents('total_expense')} AS value FROM ot
  UNION ALL SELECT user_id, 'total_income', {cents('abs(total_income_signed)')} FROM ot
  UNION ALL SELECT user_id, 'transaction_count', CAST(n_rows AS DOUBLE) FROM ot
  UNION ALL SELECT user_id, 'avg_expense', {AVG_EXPENSE} FROM ot
  UNION ALL SELECT user_id, 'category_' || parent_category, {cents('total_expense')} FROM ct
            WHERE parent_category IS NOT NULL
  UNION ALL SELECT user_id, 'month_' || strftime(month, '%Y_%m'), {cents('expense')} FROM mef
  UNION ALL SELECT user_id, 'merchant_' || merchant_name, {cents('total_expense')} FROM tm
)""")

ORACLE["data_summary"] = W(LEDGER, DATA_SUMMARY_CTE) + f"""
SELECT user_id, key, value, CAST(NULL AS VARCHAR) AS text FROM ds
UNION ALL SELECT user_id, 'date_range_start', NULL, {ymd('first_date')} FROM ot
UNION ALL SELECT user_id, 'date_range_end', NULL, {ymd('last_date')} FROM ot"""

ORACLE["hashed_ids"] = W(LEDGER) + """
SELECT DISTINCT user_id, left(sha256(user_id), 12) AS user_id_hash FROM txn"""

ORACLE["request_profiles"] = W(LEDGER, OWNER_TOTALS) + f"""
, r AS (SELECT conv_id * 4294967296 + turn AS request_id,
          CASE WHEN turn % 7 = 5 THEN 'usr_x' || CAST(conv_id AS VARCHAR)
               ELSE 'usr_' || CAST(conv_id // {OWNER_CONVERSATIONS} + 1 AS VARCHAR) END AS user_id
        FROM conversations WHERE role = 'user')
SELECT request_id, user_id, user_name, n_rows AS total_transactions, {ymd('last_date')} AS date_range_end,
       {AVG_MONTHLY} AS avg_monthly_spend, {cents('total_expense')} AS total_expense
FROM r JOIN ot USING (user_id)"""

ORACLE["absent_profiles"] = f"""
WITH prof AS ({ORACLE["user_profile"]}), ptext AS ({ORACLE["profile_text"]}), summ AS ({ORACLE["text_summary"]}),
top AS ({ORACLE["top_categories"]}), cu AS (SELECT 'usr_' || CAST(c_custkey AS VARCHAR) AS user_id FROM customer
       UNION SELECT CASE WHEN turn % 7 = 5 THEN 'usr_x' || CAST(conv_id AS VARCHAR)
                         ELSE 'usr_' || CAST(conv_id // {OWNER_CONVERSATIONS} + 1 AS VARCHAR) END
       FROM conversations WHERE role = 'user')
SELECT user_id, coalesce(user_name, 'Unknown') AS user_name, date_range_start, date_range_end,
       coalesce(total_transactions, 0) AS total_transactions,
       (SELECT count(*) FROM top WHERE top.user_id = cu.user_id) AS n_top_categories,
       coalesce(avg_monthly_spend, 0.0) AS avg_monthly_spend, coalesce(total_income, 0.0) AS total_income,
       coalesce(total_expense, 0.0) AS total_expense, coalesce(profile_text, {q(NO_PROFILE_TEXT)}) AS profile_text,
       coalesce(text_summary, {q(NO_ROWS_TEXT)}) AS text_summary
FROM cu LEFT JOIN prof USING (user_id) LEFT JOIN ptext USING (user_id) LEFT JOIN summ USING (user_id)"""

ORACLE["quarantine"] = """
SELECT event_id, 'usr_' || CAST(user_id AS VARCHAR) AS user_id,
  CASE WHEN event_type <> 'signup' THEN CAST(ts AS DATE) END AS transaction_date,
  CASE WHEN event_type <> 'error' THEN CAST(CAST(value AS DECIMAL(28,8)) AS DOUBLE) END AS transaction_amount,
  CASE event_type WHEN 'signup' THEN 'bad date: signup' WHEN 'error' THEN 'bad amount: ' || props END AS reason
FROM events"""
