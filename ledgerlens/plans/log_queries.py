"""Registered request-log and model-response queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import columns as C
from ..operators import llm_tables as L
from ..operators import screening as G
from ..operators import sequences as Q
from ..operators.cache_state import merge_batch
from ..session import ensure_checkpoint_dir
from ..sources import derived as D
from ..sources.ledger import driver_ledger, read_table
from . import pipeline as PL
from .store import stored


def known_users(spark: SparkSession, d: str) -> DataFrame:
    return driver_ledger(spark, d, need=()).select(C.USER).distinct()


def parsed_responses(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_responses(D.responses(spark, d))


def n_charts_expr():
    """Successful chart calls of a response, counted without exploding."""
    return F.size(F.filter(F.coalesce(F.col("tool_calls"), F.array()),
                           lambda c: L.valid_arguments(c["name"], F.try_parse_json(c["arguments"])))).cast("bigint")


def interactions(spark: SparkSession, d: str) -> DataFrame:
    """Answered requests (known owner, passed input rules) with their model
    text: the log the history/few-shot/cache operators read."""
    scr = G.screen_prompts(D.requests(spark, d))
    answered = scr.where("input_passed").join(known_users(spark, d), C.USER, "left_semi")
    resp = parsed_responses(spark, d).select("request_id", "status", "llm_text", "tool_calls")
    j = answered.join(resp, "request_id", "left").withColumn("n_charts", n_charts_expr())
    return j.select(
        "request_id", C.USER, "ts", "latency_ms", "status",
        F.col("effective_prompt").alias("prompt"),
        Q.infer_operation("effective_prompt", "n_charts").alias("operation"),
        F.substring(F.coalesce(F.nullif(F.col("llm_text"), F.lit("")),
                               F.lit("No response generated")), 1, 200).alias("result_summary"),
        "n_charts")


LOG_INPUTS = ("conversations", "lineitem", "orders", "customer", "part", "supplier")


def log_tables(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(screened requests, answers): stored tables that the history, message and
    result queries of a session share. The answers are final (after fallback,
    replacement, chart summary and notes)."""
    inputs = [f"{d}/{t}.parquet" for t in LOG_INPUTS]
    made = {}

    def owners():
        if not made:
            made.update(PL.owner_tables(D.requested_ledger(spark, d)))
        return made

    rows = stored(spark, "screened", inputs, lambda: PL.screened(D.requests(spark, d), owners()["names"]))
    answers = stored(spark, "answers", inputs, lambda: PL.answered(
        rows.where("known AND input_passed"), owners(), D.responses(spark, d)))
    return rows, answers


def result_rows(spark: SparkSession, d: str) -> DataFrame:
    return PL.results(*log_tables(spark, d))


def stored_interactions(spark: SparkSession, d: str) -> DataFrame:
    inputs = [f"{d}/{t}.parquet" for t in ("conversations", "lineitem", "orders")]
    return stored(spark, "interactions", inputs, lambda: interactions(spark, d))


def unknown_users(spark: SparkSession, d: str) -> DataFrame:
    """Requests whose owner has no ledger rows -> error record."""
    r = D.requests(spark, d).join(known_users(spark, d), C.USER, "left_anti")
    return r.select("request_id", C.USER,
                    F.concat(F.lit("User '"), F.col(C.USER), F.lit("' not found.")).alias("error"))


def _parse(spark, d, provider):
    p = parsed_responses(spark, d).where(F.col("provider") == provider)
    return p.select(
        "request_id", "status", "llm_text",
        F.size("tool_calls").cast("bigint").alias("n_tool_calls"),
        F.array_join(F.transform("tool_calls", lambda c: c["name"]), ",").alias("tool_names"),
        F.array_join(F.transform("tool_calls", lambda c: c["id"]), ",").alias("tool_ids"),
        "n_malformed", "prompt_tokens", "completion_tokens", "malformed_retry")


def parse_chat_json(spark: SparkSession, d: str) -> DataFrame:
    return _parse(spark, d, "chat")


def parse_content_json(spark: SparkSession, d: str) -> DataFrame:
    return _parse(spark, d, "native")


def route_tool_calls(spark: SparkSession, d: str) -> DataFrame:
    return L.route_tool_calls(parsed_responses(spark, d)).drop("arguments", "raw_arguments")


def recent_history(spark: SparkSession, d: str) -> DataFrame:
    h = Q.recent_history(log_tables(spark, d)[1])
    return h.select(C.USER, "request_id", "position", "prompt", "operation", "result_summary")


def few_shot(spark: SparkSession, d: str) -> DataFrame:
    f = Q.few_shot(log_tables(spark, d)[1])
    return f.select("request_id", C.USER, F.size("prev").cast("bigint").alias("n_previous"),
                    "few_shot")


def infer_operation(spark: SparkSession, d: str) -> DataFrame:
    return stored_interactions(spark, d).select("request_id", "n_charts", "operation")


def viz_state(spark: SparkSession, d: str) -> DataFrame:
    inter = stored_interactions(spark, d).where(F.col("status") == "ok").select("request_id", C.USER, "ts")
    charts = L.route_tool_calls(parsed_responses(spark, d)).join(inter, "request_id")
    state = Q.viz_state(charts)
    return state.withColumns({c: F.to_json(c) for c in ("axes", "filters")})


def cache_hit(spark: SparkSession, d: str) -> DataFrame:
    h = Q.cache_hits(stored_interactions(spark, d))
    return h.select("request_id", C.USER, "cache_hit")


def failure_runs(spark: SparkSession, d: str) -> DataFrame:
    f = Q.failure_runs(D.call_log(spark, d))
    return f.select("call_id", "instance_id", "status", "fail_pos", "tripped", "in_cooldown",
                    F.array_join("flags", "|").alias("flags"))


def flag_report(spark: SparkSession, d: str) -> DataFrame:
    """All flags of every request of a known owner: input, budget, model call
    and answer rules, in pipeline order."""
    r = result_rows(spark, d)
    return Q.flag_report(r.where(F.col("error").isNull()), "request_id", "guardrail_flags")


def request_report(spark: SparkSession, d: str) -> DataFrame:
    """Every request of a known owner, blocked ones too (no cache hit, no chart)."""
    cols = ["request_id", C.USER, "latency_ms", "cache_hit", "n_charts"]
    blocked = (G.screen_prompts(D.requests(spark, d)).where(~F.col("input_passed"))
               .join(known_users(spark, d), C.USER, "left_semi")
               .withColumn("cache_hit", F.lit(False)).withColumn("n_charts", F.lit(0).cast("bigint")))
    h = Q.cache_hits(stored_interactions(spark, d)).select(*cols).unionByName(blocked.select(*cols))
    return h.select("request_id", C.USER, "latency_ms", Q.latency_band("latency_ms").alias("latency_band"),
                    "cache_hit", F.col("n_charts").alias("num_visualizations"))


def _clears(role: str = "role", text: str = "text"):
    """Turns that clear a conversation: system turns, and user turns whose length
    is a multiple of seven (a given column stands in for the button)."""
    return (F.col(role) == "system") | ((F.col(role) == "user") & (F.length(text) % 7 == 0))


def chat_history(spark: SparkSession, d: str) -> DataFrame:
    """Conversation messages in order, per conversation (long form), with
    what is visible since the last clear; an answer carries the metadata of its
    request's result."""
    cv = Q.visible_history(read_table(spark, d, "conversations"), _clears())
    last = cv.groupBy("conv_id").agg(F.max("turn").alias("_last"))
    meta = result_rows(spark, d).where(F.col("error").isNull()).select(
        F.shiftright("request_id", 32).alias("conv_id"), (F.col("request_id").bitwiseAND(F.lit((1 << 32) - 1)) + 1).alias("turn"),
        F.lit("assistant").alias("role"), "cache_hit", "latency_ms", F.array_join("guardrail_flags", "|").alias("flags"))
    return (cv.join(last, "conv_id").join(meta, ["conv_id", "turn", "role"], "left")
            .select("conv_id", (F.col("turn") + 1).alias("position"), "role",
                    F.col("text").alias("content"),
                    F.length("text").cast("bigint").alias("n_chars"),
                    (F.col("turn") == F.col("_last")).alias("is_last"),
                    "visible", "visible_position", "cache_hit", "latency_ms", "flags"))


#: Tokens of conversation history that a context may hold.
CONVERSATION_TOKENS = 400


def conversation_suffix(spark: SparkSession, d: str) -> DataFrame:
    """M2 to M4: the newest turns of every conversation within the budget."""
    s = Q.budgeted_suffix(read_table(spark, d, "conversations"), CONVERSATION_TOKENS)
    return s.select("conv_id", "turn", "role", "tokens", "suffix_tokens", "kept")


def cache_hit_batches(spark: SparkSession, d: str) -> DataFrame:
    """W5 in two batches: an owner's first two conversations, then the others;
    the state goes from batch to batch through its table."""
    folder = f"{ensure_checkpoint_dir(spark)}/tables/cache-{uuid.uuid4().hex}"
    log = log_tables(spark, d)[1].select("request_id", C.USER, "ts")
    batch = F.floor(F.pmod(F.shiftright("request_id", 32), F.lit(D.OWNER_CONVERSATIONS)) * 2
                    / D.OWNER_CONVERSATIONS).cast("int")
    done = [merge_batch(log.where(batch == b), folder, b).withColumn("batch", F.lit(b)) for b in (0, 1)]
    return done[0].unionByName(done[1]).select("request_id", C.USER, "batch", "cache_hit")


QUERIES = {
    "unknown_users": unknown_users,
    "parse_chat_json": parse_chat_json,
    "parse_content_json": parse_content_json,
    "route_tool_calls": route_tool_calls,
    "recent_history": recent_history,
    "few_shot": few_shot,
    "infer_operation": infer_operation,
    "viz_state": viz_state,
    "cache_hit": cache_hit,
    "failure_runs": failure_runs,
    "flag_report": flag_report,
    "request_report": request_report,
    "chat_history": chat_history,
    "conversation_suffix": conversation_suffix,
    "cache_hit_batches": cache_hit_batches,
}
