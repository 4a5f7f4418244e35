"""Oracle SQL (DuckDB) for the screening queries.

Patterns are the fixed originals with only their shorthand classes spelled out,
so the flat loops that the Spark side runs are checked against the nested ones;
the plain-number rule, which needs look-around, is run in RE2 as a word-by-word
scan (``PLAIN_NUMBER_SCAN``).
"""

from __future__ import annotations

from ..functions import patterns as P
from ..operators.screening import STRIP_PATTERN
from ..sources.derived import ANSWER_TEMPLATES, EPOCH, OWNER_CONVERSATIONS, PROMPT_TEMPLATES
from .ledger_oracle import DATA_SUMMARY_CTE
from .sql import LEDGER, TOP_CATS, cents, cur, q, with_


def _list(vals: list[str]) -> str:
    return "[" + ", ".join(q(v) for v in vals) + "]"


def low_strip(x: str) -> str:
    return f"regexp_replace(lower({x}), {q(STRIP_PATTERN)}, '', 'g')"


def any_sql(x: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({x}, {q(w)})" for w in words) + ")"


INJ = P.any_of(P.INJECTION_PATTERNS, flat=False)
OFF = P.any_of(P.OFF_TOPIC_PATTERNS, flat=False)
XUSER = P.any_of(P.CROSS_USER_PATTERNS, flat=False)

REQUESTS = f"""
req0 AS (
  SELECT conv_id, turn, text,
         CASE WHEN turn % 7 = 5 THEN 'usr_x' || CAST(conv_id AS VARCHAR)
              ELSE 'usr_' || CAST(conv_id // {OWNER_CONVERSATIONS} + 1 AS VARCHAR) END AS user_id,
         {_list(PROMPT_TEMPLATES)}[((conv_id + turn) % {len(PROMPT_TEMPLATES)}) + 1] AS tmpl
  FROM conversations WHERE role = 'user'
),
req AS (
  SELECT conv_id * 4294967296 + turn AS request_id,
         'svc_' || CAST(conv_id % 3 AS VARCHAR) AS instance_id,
         TIMESTAMP '{EPOCH}' + to_seconds(conv_id * 3600 + turn * 60) AS ts,
         user_id,
         replace(replace(tmpl, '{{own}}', user_id), '{{other}}',
           'usr_' || CAST(conv_id // {OWNER_CONVERSATIONS} + 2 AS VARCHAR))
           || ' ' || repeat(text, conv_id % 6 + 1) AS prompt,
         CAST((conv_id * 7919 + turn * 104729) % 9000 AS DOUBLE) AS latency_ms
  FROM req0
)"""

RULES = f"""
rules AS (
  SELECT *,
    regexp_matches({low_strip('prompt')}, {q(INJ)}) AS is_injection,
    (len(list_filter(regexp_extract_all(lower(prompt), {q(P.USER_ID_PATTERN)}),
                     lambda x: x <> lower(user_id))) > 0
     OR regexp_matches(lower(prompt), {q(XUSER)})) AS is_cross_user,
    (regexp_matches({low_strip('prompt')}, {q(OFF)})
     AND NOT {any_sql(low_strip('prompt'), P.FINANCIAL_KEYWORDS)}) AS is_off_topic,
    length(prompt) > {P.MAX_PROMPT_LENGTH} AS is_too_long
  FROM req
),
scr AS (
  SELECT *, NOT (is_injection OR is_cross_user OR is_off_topic) AS input_passed,
    CASE WHEN is_injection THEN 'PROMPT_INJECTION_DETECTED'
         WHEN is_cross_user THEN 'CROSS_USER_LEAKAGE_ATTEMPT'
         WHEN is_off_topic THEN 'OFF_TOPIC'
         WHEN is_too_long THEN 'INPUT_TRUNCATED' END AS input_flag,
    CASE WHEN is_injection THEN {q(P.INJECTION_MESSAGE)}
         WHEN is_cross_user THEN {q(P.CROSS_USER_MESSAGE)}
         WHEN is_off_topic THEN {q(P.OFF_TOPIC_MESSAGE)}
         WHEN is_too_long THEN {q(P.TRUNCATED_MESSAGE)} END AS input_message,
    CASE WHEN NOT (is_injection OR is_cross_user OR is_off_topic) AND is_too_long
         THEN left(prompt, {P.MAX_PROMPT_LENGTH}) ELSE prompt END AS effective_prompt
  FROM rules
)"""


def _fill_answer(tmpl: str, slots: dict[str, str]) -> str:
    e = tmpl
    for k, v in slots.items():
        e = f"replace({e}, {q('{' + k + '}')}, {v})"
    return e


_AVG_MONTHLY = ("CASE WHEN n_expense > 0 THEN " + cents(
    "CAST(total_expense AS DOUBLE) / (datediff('month', first_expense_date, last_expense_date) + 1)")
    + " ELSE 0.0 END")

ANSWERS = (DATA_SUMMARY_CTE + "," + TOP_CATS + f"""
, lm0 AS (SELECT user_id, CAST(date_trunc('month', transaction_date) AS DATE) AS month,
                 sum(transaction_amount) AS month_total
          FROM txn WHERE transaction_amount > 0 GROUP BY ALL),
lm AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY month DESC) AS r
                      FROM lm0) WHERE r = 1),
acts AS (SELECT user_id, list(value) AS actuals FROM ds GROUP BY user_id),
ans0 AS (
  SELECT ot.*, tc.parent_category, tc.total_expense AS top_total, lm.month, lm.month_total,
         {_list(ANSWER_TEMPLATES)}[(CAST(substr(ot.user_id, 5, 20) AS BIGINT) % {len(ANSWER_TEMPLATES)}) + 1]
           AS tmpl
  FROM ot LEFT JOIN (SELECT * FROM tc WHERE rank = 1) tc USING (user_id)
          LEFT JOIN lm USING (user_id)
),
ans AS (
  SELECT user_id AS answer_id, ans0.user_id, false AS skip_grounding, n_rows, first_date, last_date, acts.actuals,
    {_fill_answer('tmpl', {
        'cat': "coalesce(parent_category, 'nothing')",
        'cat_amt': cur('coalesce(top_total, 0)'),
        'wrong_total': cur('total_expense * 3'),
        'n': 'CAST(n_rows AS VARCHAR)',
        'last_month': "coalesce(strftime(month, '%b %Y'), 'no month')",
        'last_month_amt': cur('coalesce(month_total, 0)'),
        'avg': cur(_AVG_MONTHLY),
    })} AS response
  FROM ans0 LEFT JOIN acts USING (user_id)
)""")


def month_case(x: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} = {q(k)} THEN {v}" for k, v in P.MONTH_NUMBERS.items()) + " END"


NUMS = f"""
nums AS (
  SELECT *, list_concat(
    list_filter(list_transform(regexp_extract_all(response, {q(P.DOLLAR_PORTABLE)}),
                               lambda s: TRY_CAST(replace(replace(s, '$', ''), ',', '') AS DOUBLE)),
                lambda n: n IS NOT NULL),
    list_filter(list_transform(list_filter(regexp_extract_all(response, {q(P.PLAIN_NUMBER_SCAN)}, 1),
                                           lambda s: s IS NOT NULL AND s <> ''),
                               lambda s: TRY_CAST(replace(s, ',', '') AS DOUBLE)),
                lambda n: n > 1)) AS numbers
  FROM ans
),
nflags AS (
  SELECT *, list_transform(
      list_filter(numbers, lambda n: len(list_filter(actuals,
          lambda a: abs(n - a) / greatest(abs(a), 1.0) < {P.GROUNDING_TOLERANCE})) = 0),
      lambda n: 'UNGROUNDED_NUMBER:' || CAST(n AS VARCHAR)) AS number_flags
  FROM nums
),
dflags AS (
  SELECT *, list_transform(list_filter(
      list_transform(range(1, len(ms) + 1), lambda i: {{'m': ms[i], 'y': ys[i]}}),
      lambda p: CASE WHEN CAST(p.y AS INTEGER) >= 1 THEN
                  make_date(CAST(p.y AS INTEGER), {month_case('p.m')}, 1) < date_trunc('month', first_date)
                  OR make_date(CAST(p.y AS INTEGER), {month_case('p.m')}, 1) > last_date
                ELSE false END),
      lambda p: 'UNGROUNDED_DATE:' || upper(left(p.m, 1)) || substr(p.m, 2) || ' ' || p.y) AS date_flags
  FROM (SELECT *, regexp_extract_all(lower(response), {q(P.MONTH_YEAR_PORTABLE)}, 1) AS ms,
               regexp_extract_all(lower(response), {q(P.MONTH_YEAR_PORTABLE)}, 2) AS ys
        FROM nflags)
),
sa AS (
  SELECT *,
    {any_sql('lower(response)', P.TOXICITY_KEYWORDS)} AS is_toxic,
    {any_sql('lower(response)', P.HEDGING_PHRASES)} AS is_hedging,
    n_rows < {P.SPARSE_ROWS} AS is_sparse,
    CASE WHEN first_date IS NOT NULL AND last_date IS NOT NULL
         THEN list_concat(number_flags, date_flags) ELSE number_flags END AS details
  FROM dflags
),
sb AS (
  SELECT *,
    CASE WHEN len(details) > 0 AND NOT skip_grounding THEN list_concat(['POTENTIAL_HALLUCINATION'], details[1:3])
         ELSE []::VARCHAR[] END AS hall
  FROM sa
),
sc AS (
  SELECT *,
    CASE WHEN is_hedging OR is_sparse THEN trim(
      (CASE WHEN is_hedging THEN {q(P.HEDGING_NOTE)} ELSE '' END) ||
      (CASE WHEN is_sparse THEN ' Note: This analysis is based on only ' || CAST(n_rows AS VARCHAR)
            || ' transaction(s), which may limit accuracy.' ELSE '' END)) END AS conf_msg,
    list_concat(CASE WHEN is_hedging THEN ['LOW_CONFIDENCE'] ELSE []::VARCHAR[] END,
                CASE WHEN is_sparse THEN ['SPARSE_DATA'] ELSE []::VARCHAR[] END) AS conf_flags
  FROM sb
),
sd AS (
  SELECT *,
    CASE WHEN is_toxic THEN {q(P.TOXIC_MESSAGE)}
         ELSE nullif(concat_ws(' ', CASE WHEN len(hall) > 0 THEN {q(P.HALLUCINATION_MESSAGE)} END,
                               conf_msg), '') END AS output_message,
    CASE WHEN is_toxic THEN ['TOXIC_CONTENT_DETECTED'] ELSE list_concat(hall, conf_flags) END
      AS output_flags
  FROM sc
)"""

ORACLE: dict[str, str] = {}

ORACLE["prompt_injection"] = with_(REQUESTS, RULES) + "SELECT request_id, user_id, is_injection FROM scr"
ORACLE["cross_user"] = with_(REQUESTS, RULES) + "SELECT request_id, user_id, is_cross_user FROM scr"
ORACLE["off_topic"] = with_(REQUESTS, RULES) + "SELECT request_id, user_id, is_off_topic FROM scr"
ORACLE["prompt_length"] = with_(REQUESTS) + f"""
SELECT request_id, CAST(length(prompt) AS BIGINT) AS prompt_length,
       length(prompt) > {P.MAX_PROMPT_LENGTH} AS is_too_long,
       left(prompt, {P.MAX_PROMPT_LENGTH}) AS truncated_prompt FROM req"""
ORACLE["screen_prompts"] = with_(REQUESTS, RULES) + """
SELECT request_id, user_id, input_passed, input_flag, input_message,
       CAST(length(effective_prompt) AS BIGINT) AS effective_length FROM scr"""
ORACLE["prompt_hashes"] = with_(REQUESTS, RULES) + """
SELECT request_id, left(sha256(user_id), 12) AS user_id_hash,
       left(sha256(effective_prompt), 16) AS prompt_hash,
       CAST(greatest(1, floor(length(effective_prompt) / 4)) AS BIGINT) AS prompt_tokens FROM scr"""

ORACLE["screen_documents"] = f"""
WITH d AS (SELECT doc_id, text, {low_strip('text')} AS low FROM documents)
SELECT doc_id,
  regexp_matches(low, {q(INJ)}) AS is_injection,
  regexp_matches(low, {q(OFF)}) AS off_topic_pattern,
  {any_sql('low', P.FINANCIAL_KEYWORDS)} AS has_financial_keyword,
  CAST(len(regexp_extract_all(lower(text), {q(P.USER_ID_PATTERN)})) AS BIGINT) AS n_user_ids,
  CAST(len(list_filter(list_transform(regexp_extract_all(text, {q(P.DOLLAR_PORTABLE)}),
                                      lambda s: TRY_CAST(replace(replace(s, '$', ''), ',', '') AS DOUBLE)),
                       lambda n: n IS NOT NULL))
     + len(list_filter(list_transform(list_filter(regexp_extract_all(text, {q(P.PLAIN_NUMBER_SCAN)}, 1),
                                                  lambda s: s IS NOT NULL AND s <> ''),
                                      lambda s: TRY_CAST(replace(s, ',', '') AS DOUBLE)),
                       lambda n: n > 1)) AS BIGINT) AS n_numbers,
  {any_sql('lower(text)', P.TOXICITY_KEYWORDS)} AS is_toxic,
  {any_sql('lower(text)', P.HEDGING_PHRASES)} AS is_hedging
FROM d"""

_A = with_(LEDGER, ANSWERS, NUMS)
ORACLE["number_grounding"] = _A + "SELECT answer_id, array_to_string(number_flags, '|') AS number_flags FROM sd"
ORACLE["date_grounding"] = _A + "SELECT answer_id, array_to_string(date_flags, '|') AS date_flags FROM sd"
ORACLE["toxicity"] = _A + "SELECT answer_id, is_toxic FROM sd"
ORACLE["confidence"] = _A + "SELECT answer_id, is_hedging, is_sparse FROM sd"
ORACLE["screen_answers"] = _A + """
SELECT answer_id, NOT is_toxic AS output_passed, array_to_string(output_flags, '|') AS output_flags,
       output_message,
       CASE WHEN is_toxic THEN output_message
            WHEN output_message IS NOT NULL THEN response || chr(10) || chr(10) || '⚠️ ' || output_message
            ELSE response END AS final_response
FROM sd"""
