"""Oracle SQL (DuckDB) for the request-log and model-response queries.

The parse/route oracles do not parse JSON at all: they state the expected
result directly from the source turns and the tool plan, so they check that
building *and* parsing the two response formats loses nothing.
"""

from __future__ import annotations

import json

from ..functions import patterns as P
from ..operators.llm_tables import TOOLS
from ..sources.derived import HEDGING, PROMPT_TEMPLATES, RUDE, TOOL_PLAN, WRONG_ARGUMENTS
from .log_queries import CONVERSATION_TOKENS
from .screening_oracle import REQUESTS, RULES, any_sql
from .sql import q, with_

def _sorted(args: str) -> str:
    """Arguments as JSON with sorted keys, or the text itself where they are none."""
    try:
        return json.dumps(json.loads(args), sort_keys=True, separators=(",", ":"))
    except ValueError:
        return args


_PLAN_ROWS = ", ".join(f"({i}, {pos}, {q(n)}, {q(a)}, {str((i, pos) not in WRONG_ARGUMENTS).lower()}, {q(_sorted(a))})"
                       for i, calls in TOOL_PLAN.items() for pos, (n, a) in enumerate(calls))
_KNOWN = "[" + ", ".join(q(t) for t in TOOLS) + "]"

RESP = f"""
plan AS (SELECT * FROM (VALUES {_PLAN_ROWS}) t(idx, pos, name, args, args_ok, args_sorted)),
turns AS (
  SELECT u.conv_id, u.turn, u.text, coalesce(a.text || CASE WHEN u.conv_id % 9 = 4 THEN {q(HEDGING)} ELSE '' END
           || CASE WHEN u.conv_id % 11 = 3 THEN {q(RUDE)} ELSE '' END, '') AS answer,
         (u.conv_id + u.turn) % {len(PROMPT_TEMPLATES)} AS idx,
         u.conv_id * 4294967296 + u.turn AS request_id,
         CASE WHEN u.conv_id % 13 = 7 THEN 'skipped'
              WHEN u.conv_id % 13 = 5 OR (u.conv_id * 31 + u.turn) % 13 = 0 THEN 'failed' ELSE 'ok' END AS status,
         CASE WHEN u.conv_id % 2 = 0 THEN 'chat' ELSE 'native' END AS provider
  FROM conversations u
  LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
  WHERE u.role = 'user'
),
calls AS (
  SELECT t.request_id, t.provider, t.status, p.pos, p.name, p.args, p.args_ok, p.args_sorted,
         json_valid(p.args) AS valid,
         CASE WHEN t.provider = 'chat' THEN 'call_' || CAST(p.pos + 1 AS VARCHAR)
              ELSE 'call_' || p.name END AS call_id
  FROM turns t JOIN plan p ON p.idx = t.idx WHERE t.status = 'ok'
),
good AS (
  SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY pos) - 1 AS call_pos
  FROM calls WHERE valid
),
pr AS (
  SELECT t.request_id, t.provider, t.status,
         CASE WHEN t.status = 'ok' THEN t.answer END AS llm_text,
         CAST(coalesce(g.n, 0) AS BIGINT) AS n_tool_calls,
         coalesce(g.names, '') AS tool_names, coalesce(g.ids, '') AS tool_ids,
         CAST(coalesce(m.n, 0) AS BIGINT) AS n_malformed,
         CASE WHEN t.status = 'ok' THEN CAST(floor(length(t.text) / 4) AS BIGINT) END AS prompt_tokens,
         CASE WHEN t.status = 'ok' THEN CAST(floor(length(t.answer) / 4) AS BIGINT) END AS completion_tokens,
         coalesce(m.n, 0) > 0 AND coalesce(g.n, 0) = 0 AS malformed_retry,
         CAST(coalesce(g.n_known, 0) AS BIGINT) AS n_charts
  FROM turns t
  LEFT JOIN (SELECT request_id, count(*) AS n, string_agg(name, ',' ORDER BY pos) AS names,
                    string_agg(call_id, ',' ORDER BY pos) AS ids,
                    count(*) FILTER (WHERE args_ok AND list_contains({_KNOWN}, name)) AS n_known
             FROM good GROUP BY request_id) g USING (request_id)
  LEFT JOIN (SELECT request_id, count(*) AS n FROM calls WHERE NOT valid GROUP BY request_id) m
    USING (request_id)
)"""

USERS = """
users AS (SELECT DISTINCT 'usr_' || CAST(o_custkey AS VARCHAR) AS user_id
          FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))"""


def operation(prompt: str, n: str) -> str:
    parts = [f"CASE WHEN {n} > 0 THEN {q(P.OPERATION_WITH_CHARTS)}"]
    for words, op in P.OPERATION_RULES:
        parts.append(f"WHEN {any_sql(f'lower({prompt})', words)} THEN {q(op)}")
    parts.append(f"ELSE {q(P.OPERATION_DEFAULT)} END")
    return " ".join(parts)


INTER = f"""
inter AS (
  SELECT s.request_id, s.user_id, s.ts, s.latency_ms, pr.status, s.effective_prompt AS prompt,
         {operation('s.effective_prompt', 'coalesce(pr.n_charts, 0)')} AS operation,
         left(coalesce(nullif(pr.llm_text, ''), 'No response generated'), 200) AS result_summary,
         CAST(coalesce(pr.n_charts, 0) AS BIGINT) AS n_charts
  FROM scr s LEFT JOIN pr USING (request_id)
  WHERE s.input_passed AND s.user_id IN (SELECT user_id FROM users)
)"""

_BASE = with_(REQUESTS, RULES, RESP, USERS, INTER)

ORACLE: dict[str, str] = {}


def _parse(provider: str) -> str:
    return with_(RESP) + f"""
SELECT request_id, status, llm_text, n_tool_calls, tool_names, tool_ids, n_malformed,
       prompt_tokens, completion_tokens, malformed_retry
FROM pr WHERE provider = {q(provider)}"""


ORACLE["unknown_users"] = with_(REQUESTS, USERS) + """
SELECT request_id, user_id, 'User ''' || user_id || ''' not found.' AS error
FROM req WHERE user_id NOT IN (SELECT user_id FROM users)"""

ORACLE["parse_chat_json"] = _parse("chat")
ORACLE["parse_content_json"] = _parse("native")

ORACLE["route_tool_calls"] = with_(RESP) + """
, r AS (
  SELECT request_id, CAST(call_pos AS BIGINT) AS call_pos, call_id, name AS tool_name,
         CASE WHEN args_ok THEN args END AS args, args_ok,
         CASE name WHEN 'plot_monthly_spending_trend' THEN 'monthly_spending_trend'
                   WHEN 'plot_category_breakdown' THEN 'category_breakdown'
                   WHEN 'plot_income_vs_expense' THEN 'income_vs_expense' END AS chart_type
  FROM good)
SELECT request_id, call_pos, call_id, tool_name, CASE WHEN args_ok THEN chart_type END AS chart_type,
  args_ok AND chart_type IS NOT NULL AS success,
  CASE WHEN chart_type IS NULL THEN 'Unknown tool: ' || tool_name
       WHEN NOT args_ok THEN 'Tool execution error: invalid arguments' END AS error,
  CASE WHEN args_ok AND tool_name = 'plot_monthly_spending_trend'
         THEN coalesce(CAST(json_extract_string(args, '$.months') AS BIGINT), 1)
       WHEN args_ok AND tool_name = 'plot_income_vs_expense'
         THEN coalesce(CAST(json_extract_string(args, '$.months') AS BIGINT), 6) END AS months,
  CASE WHEN args_ok AND tool_name = 'plot_category_breakdown'
         THEN coalesce(json_extract_string(args, '$.period'), 'last_3_months') END AS period,
  CASE WHEN args_ok AND tool_name = 'plot_category_breakdown'
         THEN coalesce(CAST(json_extract_string(args, '$.top_n') AS BIGINT), 7) END AS top_n,
  CASE WHEN args_ok AND tool_name = 'plot_monthly_spending_trend'
         THEN json_extract_string(args, '$.category_filter') END AS category_filter,
  CASE WHEN args_ok AND tool_name = 'plot_income_vs_expense'
         THEN coalesce(CAST(json_extract_string(args, '$.show_net_line') AS BOOLEAN), true) END
    AS show_net_line,
  CASE WHEN args_ok AND tool_name = 'plot_monthly_spending_trend'
         THEN 'Monthly spending trend chart generated for the last '
              || CAST(coalesce(CAST(json_extract_string(args, '$.months') AS BIGINT), 1) AS VARCHAR)
              || ' month(s).'
       WHEN args_ok AND tool_name = 'plot_category_breakdown'
         THEN 'Category breakdown donut chart generated for '
              || replace(coalesce(json_extract_string(args, '$.period'), 'last_3_months'), '_', ' ') || '.'
       WHEN args_ok AND tool_name = 'plot_income_vs_expense'
         THEN 'Income vs expense chart generated for the last '
              || CAST(coalesce(CAST(json_extract_string(args, '$.months') AS BIGINT), 6) AS VARCHAR)
              || ' month(s).' END AS description
FROM r"""

ORACLE["infer_operation"] = _BASE + "SELECT request_id, n_charts, operation FROM inter"

ORACLE["viz_state"] = _BASE + """
, ch AS (
  SELECT i.user_id, i.ts, g.request_id, g.call_pos, g.name, g.args, g.args_sorted,
         CASE g.name WHEN 'plot_monthly_spending_trend' THEN 'monthly_spending_trend'
                     WHEN 'plot_category_breakdown' THEN 'category_breakdown'
                     WHEN 'plot_income_vs_expense' THEN 'income_vs_expense' END AS chart_type
  FROM good g JOIN inter i USING (request_id) WHERE i.status = 'ok' AND g.args_ok),
last AS (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, request_id DESC, call_pos DESC) AS r
  FROM ch WHERE chart_type IS NOT NULL)
SELECT user_id, chart_type AS last_chart_type, args_sorted AS axes, args_sorted AS filters,
  CASE WHEN name = 'plot_monthly_spending_trend'
         THEN coalesce(CAST(json_extract_string(args, '$.months') AS BIGINT), 1)
       WHEN name = 'plot_income_vs_expense'
         THEN coalesce(CAST(json_extract_string(args, '$.months') AS BIGINT), 6) END AS months,
  CASE WHEN name = 'plot_category_breakdown'
         THEN coalesce(json_extract_string(args, '$.period'), 'last_3_months') END AS period,
  CASE WHEN name = 'plot_category_breakdown'
         THEN coalesce(CAST(json_extract_string(args, '$.top_n') AS BIGINT), 7) END AS top_n,
  CASE WHEN name = 'plot_monthly_spending_trend'
         THEN json_extract_string(args, '$.category_filter') END AS category_filter,
  CASE WHEN name = 'plot_income_vs_expense'
         THEN coalesce(CAST(json_extract_string(args, '$.show_net_line') AS BOOLEAN), true) END
    AS show_net_line,
  ts AS updated_at
FROM last WHERE r = 1"""

ORACLE["cache_hit"] = _BASE + """
SELECT request_id, user_id,
       row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) > 1 AS cache_hit
FROM inter"""

ORACLE["failure_runs"] = f"""
WITH c AS (
  SELECT event_id AS call_id, 'svc_' || CAST(user_id % 4 AS VARCHAR) AS instance_id, ts,
         CASE WHEN event_type IN ('error', 'signup') THEN 'failed' WHEN event_type = 'purchase' THEN 'skipped'
              ELSE 'ok' END AS status
  FROM events),
a AS (
  SELECT *,
    sum(CASE WHEN status = 'failed' THEN 1 ELSE 0 END)
      OVER (PARTITION BY instance_id ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING) AS fail_cum
  FROM c),
b AS (
  SELECT *, fail_cum - coalesce(max(CASE WHEN status = 'ok' THEN fail_cum END)
      OVER (PARTITION BY instance_id ORDER BY ts, call_id ROWS UNBOUNDED PRECEDING), 0) AS pos
  FROM a),
t AS (
  SELECT *, status = 'failed' AND pos % {P.BREAKER_THRESHOLD} = 0 AS tripped FROM b),
u AS (
  SELECT *, max(CASE WHEN tripped THEN ts END)
      OVER (PARTITION BY instance_id ORDER BY ts, call_id
            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_trip
  FROM t)
SELECT call_id, instance_id, status,
  CASE WHEN status = 'failed' THEN CAST(pos AS BIGINT) END AS fail_pos, tripped,
  last_trip IS NOT NULL AND ts < last_trip + INTERVAL {P.BREAKER_COOLDOWN_SECONDS} SECOND AS in_cooldown,
  array_to_string(list_concat(
    CASE WHEN status = 'failed' THEN ['LLM_UNAVAILABLE'] ELSE []::VARCHAR[] END,
    CASE WHEN tripped THEN ['CIRCUIT_BREAKER_TRIPPED'] ELSE []::VARCHAR[] END,
    CASE WHEN status = 'skipped' THEN ['CIRCUIT_BREAKER_OPEN'] ELSE []::VARCHAR[] END), '|') AS flags
FROM u"""


def severity_case(k: str, idx: int, default: str) -> str:
    return ("CASE " + " ".join(f"WHEN {k} = {q(n)} THEN {q(v[idx])}" for n, v in P.FLAG_SEVERITY.items())
            + f" ELSE {default} END")


ORACLE["request_report"] = _BASE + """
, r AS (
  SELECT request_id, user_id, latency_ms,
         row_number() OVER (PARTITION BY user_id ORDER BY ts, request_id) > 1 AS cache_hit, n_charts
  FROM inter
  UNION ALL
  SELECT request_id, user_id, latency_ms, false, 0 FROM scr
  WHERE NOT input_passed AND user_id IN (SELECT user_id FROM users))
SELECT request_id, user_id, latency_ms,
  CASE WHEN latency_ms < 2000 THEN 'green' WHEN latency_ms < 5000 THEN 'orange' ELSE 'red' END
    AS latency_band,
  cache_hit, CAST(n_charts AS BIGINT) AS num_visualizations
FROM r"""

ORACLE["conversation_suffix"] = f"""
WITH t AS (SELECT *, CAST(greatest(1, floor(length(text) / 4)) AS BIGINT) AS tokens FROM conversations),
s AS (SELECT *, CAST(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS BIGINT) AS suffix_tokens FROM t)
SELECT conv_id, turn, role, tokens, suffix_tokens, suffix_tokens <= {CONVERSATION_TOKENS} AS kept FROM s"""
