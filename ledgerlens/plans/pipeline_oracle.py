"""Oracle SQL (DuckDB) for answered requests and what is taken from them:
history, few-shot, messages, budget, trimming, results, flags, audit.

The owner's texts and numbers are the ledger oracles as subqueries; the model
text comes from the source turns, not from JSON.
"""

from __future__ import annotations

from ..functions import patterns as P
from ..operators import messages as M
from ..operators.sequences import FEW_SHOT_HEADER
from .ledger_oracle import ORACLE as LEDGER_ORACLE
from .log_oracle import RESP, USERS, operation, severity_case
from .screening_oracle import NUMS, REQUESTS, RULES, low_strip
from .sql import LEDGER, OWNER_TOTALS, cents, q, with_

OWNERS = f"""
own_totals AS ({with_(LEDGER, OWNER_TOTALS)} SELECT * FROM ot),
own_profile AS ({LEDGER_ORACLE['profile_text']}),
own_summary AS ({LEDGER_ORACLE['text_summary']}),
own_fallback AS ({LEDGER_ORACLE['fallback_answer']}),
own_actuals AS (SELECT user_id, list(value) FILTER (WHERE value IS NOT NULL) AS actuals,
                  string_agg(key || '=' || coalesce(text, CASE WHEN key = 'transaction_count'
                    THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE format('{{:.2f}}', value) END), '|'
                    ORDER BY key || '=') AS data_summary
                FROM ({LEDGER_ORACLE['data_summary']}) GROUP BY user_id)"""

#: Trips of the breaker: every THRESHOLD-th failed call since the last good one.
BREAKER = f"""
calls_cum AS (
  SELECT request_id, status, 'svc_' || CAST(conv_id % 3 AS VARCHAR) AS instance_id,
         conv_id * 3600 + turn * 60 AS call_sec,
         sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END) OVER (
           PARTITION BY conv_id % 3 ORDER BY conv_id * 3600 + turn * 60, request_id
           ROWS UNBOUNDED PRECEDING) AS fail_cum
  FROM turns),
calls_pos AS (
  SELECT request_id, status, fail_cum - coalesce(max(CASE WHEN status = 'ok' THEN fail_cum END) OVER (
           PARTITION BY instance_id ORDER BY call_sec, request_id ROWS UNBOUNDED PRECEDING), 0) AS pos
  FROM calls_cum),
breaker AS (SELECT request_id, status = 'failed' AND pos % {P.BREAKER_THRESHOLD} = 0 AS tripped FROM calls_pos)"""

CHARTS = """
charts AS (
  SELECT request_id, string_agg(chart_type, ',' ORDER BY call_pos) AS visualizations, count(*) AS n
  FROM (SELECT request_id, call_pos,
               CASE name WHEN 'plot_monthly_spending_trend' THEN 'monthly_spending_trend'
                         WHEN 'plot_category_breakdown' THEN 'category_breakdown'
                         WHEN 'plot_income_vs_expense' THEN 'income_vs_expense' END AS chart_type
        FROM good WHERE args_ok)
  WHERE chart_type IS NOT NULL GROUP BY request_id)"""

ANS = f"""
ans AS (
  SELECT s.request_id, s.user_id, s.ts, s.latency_ms, s.input_flag, s.effective_prompt, o.user_name,
         o.n_rows, o.first_date, o.last_date, oa.actuals, oa.data_summary, pr.status, pr.malformed_retry,
         coalesce(c.visualizations, '') AS visualizations, CAST(coalesce(c.n, 0) AS BIGINT) AS n_charts,
         pr.status <> 'ok' AS skip_grounding, b.tripped,
         CASE WHEN pr.status <> 'ok' THEN f.fallback_answer
              WHEN {low_strip("coalesce(pr.llm_text, '')")} = '' AND coalesce(c.n, 0) > 0
                THEN 'Here''s your financial analysis, ' || coalesce(o.user_name, '')
                     || '! I''ve generated ' || CAST(c.n AS VARCHAR) || ' chart'
                     || CASE WHEN c.n > 1 THEN 's' ELSE '' END
                     || ' for your analysis. Check the visualizations below for detailed insights.'
              ELSE coalesce(pr.llm_text, '') END AS response
  FROM scr s
  JOIN own_totals o USING (user_id)
  JOIN own_fallback f USING (user_id)
  JOIN own_actuals oa USING (user_id)
  JOIN pr USING (request_id)
  JOIN breaker b USING (request_id)
  LEFT JOIN charts c USING (request_id)
  WHERE s.input_passed
)"""

FINAL = f"""
fin AS (
  SELECT *,
    CASE WHEN is_toxic THEN output_message
         WHEN output_message IS NOT NULL THEN response || chr(10) || chr(10) || '⚠️ ' || output_message
         ELSE response END AS final_response,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) > 1 AS cache_hit
  FROM sd),
inter AS (
  SELECT *, effective_prompt AS prompt, {operation('effective_prompt', 'n_charts')} AS operation,
         left(coalesce(nullif(final_response, ''), 'No response generated'), 200) AS result_summary
  FROM fin)"""

FEW = f"""
prevs AS (
  SELECT *, list({{'prompt': prompt, 'operation': operation, 'result_summary': result_summary}})
           OVER (PARTITION BY user_id ORDER BY ts, request_id
                 ROWS BETWEEN {P.HISTORY_USED} PRECEDING AND 1 PRECEDING) AS prev
  FROM inter),
few AS (
  SELECT *, CASE WHEN coalesce(len(prev), 0) > 0 THEN {q(FEW_SHOT_HEADER)} || array_to_string(
    list_transform(prev, lambda x, i: chr(10) || CAST(i AS VARCHAR) || '. User asked: "' || x.prompt
      || '"' || chr(10) || '   Analysis performed: ' || x.operation
      || chr(10) || '   Key finding: ' || x.result_summary || chr(10)), '') END AS few_shot
  FROM prevs)"""


def _tokens(x: str) -> str:
    return f"CAST(greatest(1, floor(length({x}) / 4)) AS BIGINT)"


def _token_sum(msgs: str) -> str:
    return f"CAST(list_sum(list_transform({msgs}, lambda m: {_tokens('m.content')})) AS BIGINT)"


_CONTENTS = "list_transform(messages, lambda m: m.content)"

MESSAGES = f"""
msgs AS (
  SELECT f.*, list_concat(
    [{{'role': 'system', 'content': {q(M.SYSTEM_PROMPT)}}},
     {{'role': 'system', 'content': 'CURRENT USER CONTEXT:' || chr(10) || p.profile_text || chr(10) || chr(10)
        || 'DATA SUMMARY:' || chr(10) || t.text_summary || chr(10)}}],
    CASE WHEN few_shot IS NOT NULL THEN [{{'role': 'system', 'content': few_shot}}] ELSE [] END,
    [{{'role': 'user', 'content': effective_prompt}}]) AS messages
  FROM few f JOIN own_profile p USING (user_id) JOIN own_summary t USING (user_id))"""

BUDGET = f"""
bud AS (
  SELECT *, {_tokens(f"array_to_string({_CONTENTS}, ' ')")} AS context_tokens,
         {_token_sum('messages')} AS message_tokens FROM msgs),
budget AS (
  SELECT *, CASE WHEN context_tokens > {P.MAX_INPUT_TOKENS}
    THEN 'CONTEXT_TRUNCATED_FROM_' || CAST(context_tokens AS VARCHAR) || '_TOKENS' END AS budget_flag
  FROM bud)"""

_OVER = f"> {P.MAX_INPUT_TOKENS}"
_MARK = q(M.SUMMARY_MARKER)
_CUT = (f"substr(m.content, 1, strpos(m.content, {_MARK}) - 1 + {len(M.SUMMARY_MARKER) + M.SUMMARY_KEEP_CHARS})"
        f" || {q(M.SUMMARY_CUT_NOTE)}")

TRIM = f"""
trim1 AS (
  SELECT request_id, budget_flag, messages,
    CASE WHEN message_tokens {_OVER}
         THEN list_filter(messages, lambda m: NOT contains(m.content, {q(M.HISTORY_MARKER)}))
         ELSE messages END AS m1 FROM budget),
trim2 AS (
  SELECT *, CASE WHEN {_token_sum('m1')} {_OVER} THEN list_transform(m1, lambda m, i:
      CASE WHEN i = list_position(list_transform(m1, lambda y: y.role = 'system'
                                  AND contains(y.content, 'DATA SUMMARY')), true)
                AND strpos(m.content, {_MARK}) > 1
           THEN {{'role': 'system', 'content': {_CUT}}} ELSE m END)
    ELSE m1 END AS m2 FROM trim1),
trim3 AS (
  SELECT *, CASE WHEN {_token_sum('m2')} {_OVER} THEN list_transform(m2, lambda m, i:
      CASE WHEN i = list_position(list_transform(m2, lambda y: y.role = 'system'
                                  AND contains(lower(y.content), {q(M.SYSTEM_MARKER)})), true)
           THEN {{'role': 'system', 'content': left(m.content, {M.SYSTEM_KEEP_CHARS}) || {q(M.SYSTEM_CUT_NOTE)}}}
           ELSE m END)
    ELSE m2 END AS m3 FROM trim2),
trimmed AS (
  SELECT request_id, CASE WHEN budget_flag IS NOT NULL THEN m3 ELSE messages END AS t FROM trim3)"""

RESULTS = f"""
results AS (
  SELECT request_id, user_id, ts, CAST(NULL AS VARCHAR) AS user_name, CAST(NULL AS VARCHAR) AS response,
         CAST(NULL AS VARCHAR) AS data_summary, CAST(NULL AS VARCHAR) AS visualizations, CAST(NULL AS BIGINT) AS n_charts,
         CAST(NULL AS BOOLEAN) AS cache_hit, latency_ms, CAST(NULL AS VARCHAR[]) AS flags,
         'User ''' || user_id || ''' not found.' AS error, prompt AS effective_prompt
  FROM req WHERE user_id NOT IN (SELECT user_id FROM users)
  UNION ALL
  SELECT request_id, s.user_id, s.ts,
         CASE WHEN EXISTS (SELECT 1 FROM scr e WHERE e.user_id = s.user_id AND e.input_passed
                           AND (e.ts < s.ts OR e.ts = s.ts AND e.request_id < s.request_id))
              THEN o.user_name ELSE 'Unknown' END,
         input_message, '', '', 0, false, latency_ms, [input_flag], NULL, effective_prompt
  FROM scr s JOIN own_totals o USING (user_id) WHERE NOT input_passed
  UNION ALL
  SELECT request_id, user_id, ts, user_name, final_response, data_summary, visualizations, n_charts, cache_hit, latency_ms,
    list_concat(
      CASE WHEN input_flag IS NOT NULL THEN [input_flag] ELSE []::VARCHAR[] END,
      CASE WHEN budget_flag IS NOT NULL THEN [budget_flag] ELSE []::VARCHAR[] END,
      CASE WHEN status = 'skipped' THEN ['CIRCUIT_BREAKER_OPEN']
           WHEN status = 'failed' AND tripped THEN ['LLM_UNAVAILABLE', 'CIRCUIT_BREAKER_TRIPPED']
           WHEN status = 'failed' THEN ['LLM_UNAVAILABLE']
           WHEN malformed_retry THEN ['MALFORMED_TOOL_CALL_RETRY'] ELSE []::VARCHAR[] END,
      output_flags), NULL, effective_prompt
  FROM budget)"""

_LOG = with_(REQUESTS, RULES, RESP, USERS, OWNERS, BREAKER, CHARTS, ANS, NUMS, FINAL, FEW)
_MSG = _LOG + "," + MESSAGES + "," + BUDGET
_ALL = _MSG + "," + RESULTS

ORACLE: dict[str, str] = {}

ORACLE["recent_history"] = _LOG + f"""
SELECT user_id, request_id, position, prompt, operation, result_summary FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, request_id DESC) AS position
  FROM inter) WHERE position <= {P.HISTORY_KEPT}"""

ORACLE["few_shot"] = _LOG + """
SELECT request_id, user_id, CAST(coalesce(len(prev), 0) AS BIGINT) AS n_previous, few_shot FROM few"""

ORACLE["build_messages"] = _MSG + f"""
SELECT request_id, user_id, CAST(len(messages) AS BIGINT) AS n_messages,
  array_to_string(list_transform(messages, lambda m: m.role), ',') AS roles,
  sha256(array_to_string({_CONTENTS}, chr(0))) AS content_sha256 FROM budget"""

ORACLE["token_budget"] = _MSG + """
SELECT request_id, context_tokens, message_tokens, budget_flag FROM budget"""

ORACLE["trim_messages"] = _MSG + "," + TRIM + f"""
SELECT request_id, CAST(len(t) AS BIGINT) AS n_messages, {_token_sum('t')} AS message_tokens FROM trimmed"""

ORACLE["answer_requests"] = _ALL + """
SELECT request_id, user_id, user_name, response, data_summary, visualizations, cache_hit, latency_ms,
       array_to_string(flags, '|') AS guardrail_flags, error FROM results"""

ORACLE["audit_records"] = _ALL + f"""
SELECT request_id, ts AS timestamp, left(sha256(user_id), 12) AS user_id_hash,
  left(sha256(effective_prompt), 16) AS prompt_hash,
  CAST(length(effective_prompt) AS BIGINT) AS prompt_length,
  CAST(length(response) AS BIGINT) AS response_length, {cents('latency_ms')} AS latency_ms,
  array_to_string(flags, '|') AS guardrail_flags, cache_hit, n_charts AS num_visualizations,
  CAST(NULL AS VARCHAR) AS error
FROM results WHERE error IS NULL"""

ORACLE["flag_report"] = _ALL + f"""
, e AS (SELECT request_id, unnest(flags) AS flag, unnest(range(len(flags))) AS flag_pos
        FROM results WHERE error IS NULL),
k AS (SELECT *, split_part(flag, ':', 1) AS fk FROM e)
SELECT request_id, CAST(flag_pos AS BIGINT) AS flag_pos, flag,
  {severity_case('fk', 0, "'info'")} AS severity,
  {severity_case('fk', 1, 'flag')} AS label,
  CASE WHEN {severity_case('fk', 0, "'info'")} = 'error' THEN 'BLOCKED: ' || {severity_case('fk', 1, 'flag')}
       ELSE {severity_case('fk', 1, 'flag')} END AS display
FROM k"""

ORACLE["cache_hit_batches"] = _LOG + """
SELECT request_id, user_id, CAST((request_id >> 32) % 4 // 2 AS INTEGER) AS batch, cache_hit FROM fin"""

ORACLE["chat_history"] = _ALL + """
, c AS (SELECT *, max(CASE WHEN role = 'system' OR role = 'user' AND length(text) % 7 = 0 THEN turn END)
          OVER (PARTITION BY conv_id) AS cleared FROM conversations),
v AS (SELECT *, cleared IS NULL OR turn > cleared AS visible FROM c)
SELECT v.conv_id, v.turn + 1 AS position, v.role, v.text AS content, CAST(length(v.text) AS BIGINT) AS n_chars,
       v.turn = max(v.turn) OVER (PARTITION BY v.conv_id) AS is_last, v.visible,
       CASE WHEN v.visible THEN CAST(count(*) FILTER (WHERE v.visible)
         OVER (PARTITION BY v.conv_id ORDER BY v.turn) AS BIGINT) END AS visible_position,
       r.cache_hit, r.latency_ms, array_to_string(r.flags, '|') AS flags
FROM v LEFT JOIN (SELECT * FROM results WHERE error IS NULL) r
  ON v.role = 'assistant' AND r.request_id = v.conv_id * 4294967296 + v.turn - 1"""

#: A third of each text as history, as data summary and as prompt.
_DOCS = f"""
doc0 AS (SELECT doc_id, text, CAST(floor(length(text) / 3) AS BIGINT) AS n
         FROM (SELECT doc_id, repeat(coalesce(text, ''), doc_id % 8 + 1) AS text FROM documents)),
msgs AS (
  SELECT doc_id AS request_id,
    [{{'role': 'system', 'content': {q(M.SYSTEM_PROMPT)}}},
     {{'role': 'system', 'content': 'CURRENT USER CONTEXT:' || chr(10) || 'Document ' || CAST(doc_id AS VARCHAR) || chr(10)
        || chr(10) || 'DATA SUMMARY:' || chr(10) || substr(text, n + 1, n) || chr(10)}},
     {{'role': 'system', 'content': {q(FEW_SHOT_HEADER)} || left(text, n)}},
     {{'role': 'user', 'content': substr(text, 2 * n + 1)}}] AS messages
  FROM doc0)"""
ORACLE["document_contexts"] = with_(_DOCS, BUDGET, TRIM) + f"""
SELECT b.request_id AS doc_id, context_tokens, budget_flag,
  sha256(left(array_to_string({_CONTENTS}, ' '), {P.MAX_INPUT_TOKENS * 4})) AS cut_sha256,
  CAST(len(t) AS BIGINT) AS n_messages, {_token_sum('t')} AS message_tokens,
  sha256(array_to_string(list_transform(t, lambda m: m.content), chr(0))) AS trimmed_sha256
FROM budget b JOIN trimmed USING (request_id)"""
