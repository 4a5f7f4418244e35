"""The request pipeline in batch form: every request of a log answered at once.

answer_requests(requests, ledger, responses) -> one result row per request:

1. unknown owners  -> error rows (no audit record)                     R2
2. input screening -> blocked rows with the rule's message             R3
3. passing rows    -> owner profile/summaries (computed once per owner,
   joined), model output from the response table (text, fallback when
   the call failed or the breaker was open, chart-only summary), output
   screening, history/few-shot and the message context with its budget
   flag                                                                R1
4. flags concatenated in stage order                                   U3

Only the ledger rows of owners that the log names are aggregated: the ledger is
semi-joined with them before its one large shuffle. Frames that several later
steps read are written once to the checkpoint folder (owner facts, screened
requests, parsed responses, answers before and after screening), so no step
derives them anew and plans stay small; these jobs run while the result's frame
is built. Per-owner tables are small per owner and joined to requests (AQE
broadcasts them when they fit the broadcast threshold).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import columns as C
from ..functions import exprs as X
from ..operators import grounding as GR
from ..operators import llm_tables as L
from ..operators import messages as M
from ..operators import profile as PR
from ..operators import screening as G
from ..operators import sequences as Q
from ..session import cut_lineage

EMPTY = "array<string>"


def _flags(*parts) -> F.Column:
    return F.concat(*[F.coalesce(p, F.array().cast(EMPTY)) for p in parts])


def owner_tables(ledger: DataFrame, requests: DataFrame | None = None) -> dict[str, DataFrame]:
    """Per-owner input of the pipeline from one pass over the ledger, written
    once: ``facts`` (``profile.owner_facts``), and what is made of them, namely
    names, cards (profile, summary text, summary map) and actuals (verified
    numbers as rows). With ``requests`` only of their owners."""
    has_merchants = C.MERCHANT in ledger.columns
    led = ledger if has_merchants else ledger.withColumn(C.MERCHANT, F.lit(None).cast("string"))
    if requests is not None:
        led = led.join(requests.select(C.USER).distinct(), C.USER, "left_semi")
    facts = cut_lineage(PR.owner_facts(led))
    names = facts.where("grain = 'owner'").groupBy(C.USER).agg(F.min(C.NAME).alias("_name"))
    cards = (PR.cards_of(facts).withColumn("text_summary", PR.summary_text(has_merchants))
             .withColumn("data_summary", PR.data_summary_map()))
    return {"facts": facts, "names": names, "cards": cards, "actuals": PR.actual_rows(facts=facts)}


def screened(requests: DataFrame, names: DataFrame) -> DataFrame:
    """All requests, screened, with ``known`` (their owner has ledger rows) and
    the owner's ``_name``, written once."""
    rows = requests.join(names.withColumn("known", F.lit(True)), C.USER, "left")
    return cut_lineage(G.screen_prompts(rows.withColumn("known", F.coalesce("known", F.lit(False)))))


#: What the history, the message context and the result rows read of an answer.
HISTORY = ["request_id", C.USER, "ts", "prompt", "operation", "result_summary"]
ANSWERED = [*HISTORY, C.NAME, "final_response", "visualizations", "cache_hit", "latency_ms",
            "input_flag", "_llm_flags", "output_flags", "effective_prompt", "_profile_text",
            "text_summary", "data_summary"]


def answered(passed: DataFrame, owners: dict[str, DataFrame], responses: DataFrame,
             bucket: str = Q.DEFAULT_BUCKET) -> DataFrame:
    """R1 for screened requests that passed, up to the final answer: fallback,
    chart summary, output screening, and what the history keeps of it (prompt,
    operation, result_summary); the columns ANSWERED. ``owners``:
    ``owner_tables``; ``passed`` is read twice."""
    ok = Q.cache_hits(passed)
    parsed = cut_lineage(L.parse_responses(responses).select(
        "request_id", "instance_id", "ts", "status", "llm_text", "tool_calls", "malformed_retry"))
    resp = parsed.drop("instance_id", "ts", "tool_calls")
    breaker = Q.failure_runs(
        parsed.select("request_id", "instance_id", "ts", "status"),
        key="instance_id", tie="request_id", bucket=bucket).select(
        "request_id", "tripped")
    routed = L.route_tool_calls(parsed).where("success")
    charts = routed.groupBy("request_id").agg(F.sort_array(F.collect_list(F.struct(
        "call_pos", "chart_type", "description"))).alias("_charts"))
    a = (ok.join(resp, "request_id", "left").join(breaker, "request_id", "left")
         .join(charts, "request_id", "left")
         .join(owners["cards"], C.USER))
    viz = F.transform(F.coalesce(F.col("_charts"), F.array()), lambda c: c["chart_type"])
    a = a.withColumn("visualizations", viz.cast(EMPTY)) \
         .withColumn("_n_charts", F.size("visualizations"))
    failed = F.col("status") == "failed"
    skipped = F.col("status") == "skipped"
    fallback = failed | skipped | F.col("status").isNull()
    text = (F.when(fallback, PR.fallback_text())
            .when((G.py_strip(F.coalesce(F.col("llm_text"), F.lit(""))) == "") & (F.col("_n_charts") > 0),
                  M.chart_summary(C.NAME, "_n_charts"))
            .otherwise(F.coalesce(F.col("llm_text"), F.lit(""))))
    a = a.withColumn("response_raw", text).withColumn("_fallback", fallback)
    a = cut_lineage(a.withColumn("_profile_text", PR.profile_text(a)).drop(
        "categories", "top_categories", "top_merchants", "months", "_charts"))
    numbers = GR.number_flags(a.where(~F.col("_fallback")), owners["actuals"], "request_id", C.USER, "response_raw")
    a = G.screen_answers(a.join(numbers, "request_id", "left"), text_col="response_raw",
                         numbers_col="number_flags", start_col="first_date", end_col="last_date",
                         rows_col="n_rows", skip_grounding_col="_fallback")
    llm_flags = (F.when(skipped, F.array(F.lit("CIRCUIT_BREAKER_OPEN")))
                 .when(failed, F.when(F.col("tripped"), F.array(
                     F.lit("LLM_UNAVAILABLE"), F.lit("CIRCUIT_BREAKER_TRIPPED")))
                       .otherwise(F.array(F.lit("LLM_UNAVAILABLE"))))
                 .when(F.col("malformed_retry"), F.array(F.lit("MALFORMED_TOOL_CALL_RETRY"))))
    a = (a.withColumn("_llm_flags", llm_flags)
            .withColumn("prompt", F.col("effective_prompt"))
            .withColumn("operation", Q.infer_operation("effective_prompt", "_n_charts"))
            .withColumn("result_summary", F.substring(F.coalesce(
                F.nullif(F.col("final_response"), F.lit("")), F.lit("No response generated")), 1, 200)))
    return a.select(*ANSWERED)


def with_messages(a: DataFrame, bucket: str = Q.DEFAULT_BUCKET) -> DataFrame:
    """Answered requests with their few-shot block and message context."""
    a = Q.few_shot(a, bucket=bucket)
    return a.withColumn("messages", M.build_messages("_profile_text", "text_summary", "few_shot",
                                                     "effective_prompt"))


def answer_requests(requests: DataFrame, ledger: DataFrame, responses: DataFrame,
                    bucket: str = Q.DEFAULT_BUCKET,
                    tables: dict[str, DataFrame] | None = None) -> DataFrame:
    owners = tables or owner_tables(ledger, requests)
    rows = screened(requests, owners["names"])
    answers = cut_lineage(answered(rows.where("known AND input_passed"), owners, responses, bucket))
    return results(rows, answers, bucket)


EMPTY_SUMMARY = "map<string,string>"


def results(rows: DataFrame, answers: DataFrame, bucket: str = Q.DEFAULT_BUCKET) -> DataFrame:
    """One result row per request from the screened requests and the answers."""
    unknown, known = rows.where(~F.col("known")), rows.where("known")

    # --- R2: unknown owner ---------------------------------------------------
    err = unknown.select(
        "request_id", C.USER, "ts", F.lit(None).cast("string").alias(C.NAME),
        F.lit(None).cast("string").alias("response"),
        F.lit(None).cast(EMPTY_SUMMARY).alias("data_summary"),
        F.lit(None).cast(EMPTY).alias("visualizations"),
        F.lit(None).cast("boolean").alias("cache_hit"), F.col("latency_ms"),
        F.lit(None).cast(EMPTY).alias("guardrail_flags"),
        F.concat(F.lit("User '"), F.col(C.USER), F.lit("' not found.")).alias("error"),
        F.col("prompt").alias("effective_prompt"))

    # --- R3: blocked by an input rule ----------------------------------------
    # the name is known only if an earlier request of the owner passed (Q24)
    passed_first = known.where("input_passed").groupBy(C.USER).agg(
        F.min(F.struct("ts", "request_id")).alias("_first_pass"))
    blocked = (known.where(~F.col("input_passed"))
               .join(passed_first, C.USER, "left"))
    seen = F.col("_first_pass").isNotNull() & (F.col("_first_pass") < F.struct("ts", "request_id"))
    blk = blocked.select(
        "request_id", C.USER, "ts",
        F.when(seen, F.col("_name")).otherwise(F.lit("Unknown")).alias(C.NAME),
        F.col("input_message").alias("response"),
        F.create_map().cast(EMPTY_SUMMARY).alias("data_summary"),
        F.array().cast(EMPTY).alias("visualizations"),
        F.lit(False).alias("cache_hit"), "latency_ms",
        F.array(F.col("input_flag")).alias("guardrail_flags"),
        F.lit(None).cast("string").alias("error"), "effective_prompt")

    # --- R1: answered ---------------------------------------------------------
    # history (needs final answers) -> few-shot -> messages -> budget flag
    a = with_messages(answers, bucket)
    a = a.withColumn("_budget", M.budget_flag(F.col("messages")))
    ans = a.select(
        "request_id", C.USER, "ts", C.NAME,
        F.col("final_response").alias("response"), "data_summary", "visualizations", "cache_hit", "latency_ms",
        _flags(F.array_compact(F.array(F.col("input_flag"))),
               F.array_compact(F.array(F.col("_budget"))),
               F.col("_llm_flags"), F.col("output_flags")).alias("guardrail_flags"),
        F.lit(None).cast("string").alias("error"), "effective_prompt")

    return err.unionByName(blk).unionByName(ans)


def audit_records(results: DataFrame) -> DataFrame:
    """One audit record per screened request (unknown owners excluded),
    owner and prompt hashed, no raw text."""
    r = results.where(F.col("error").isNull())
    return r.select(
        "request_id",
        F.col("ts").alias("timestamp"),
        X.hash_user_id(C.USER).alias("user_id_hash"),
        X.hash_prompt("effective_prompt").alias("prompt_hash"),
        F.length("effective_prompt").cast("bigint").alias("prompt_length"),
        F.length("response").cast("bigint").alias("response_length"),
        X.cents(F.col("latency_ms")).alias("latency_ms"),
        F.col("guardrail_flags"),
        "cache_hit",
        F.size("visualizations").cast("bigint").alias("num_visualizations"),
        F.lit(None).cast("string").alias("error"))


def write_audit(audit: DataFrame, path: str, batch_id: str = "0") -> None:
    """JSON-lines sink (one object per request), a folder for each batch: a
    rerun of a batch replaces its records, another batch adds its own."""
    audit.write.mode("overwrite").json(f"{path}/batch={batch_id}")


def run_batch(requests: DataFrame, ledger: DataFrame, responses: DataFrame, out_dir: str,
              bucket: str = Q.DEFAULT_BUCKET, batch_id: str = "0") -> DataFrame:
    """Batch job: results are checkpointed to the cluster's shared checkpoint
    folder (reliable, survives executor loss) and go to parquet, audit records
    to the batch's folder of the JSON sink."""
    results = cut_lineage(answer_requests(requests, ledger, responses, bucket))
    results.write.mode("overwrite").parquet(f"{out_dir}/results")
    write_audit(audit_records(results), f"{out_dir}/audit", batch_id)
    return results
