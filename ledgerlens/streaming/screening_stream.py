"""Screening and audit on a request *stream* (Structured Streaming).

The reference has no streaming operator; its input rules, response parsing
and hashing are stateless column expressions, so they run unchanged on a
streaming DataFrame. Profile lookups are a stream-static join against the
(periodically rewritten) owner table. The audit sink is append-only and
idempotent per micro-batch: each epoch writes to its own folder, so a
retried batch after an executor or driver failure overwrites, never
duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import columns as C
from ..functions import exprs as X
from ..operators import screening as G

REQUEST_SCHEMA = ("request_id bigint, instance_id string, ts timestamp_ntz, user_id string, "
                  "prompt string, latency_ms double")


def screen_request_stream(requests: DataFrame, owners: DataFrame) -> DataFrame:
    """Streaming requests -> screened rows with owner known/unknown, input
    verdict, effective prompt and hashed ids (map-only, plus a stream-static
    semi-join shape done as a left join on the owner table)."""
    # an owner with several names is one row, or its requests would double
    known = owners.groupBy(C.USER).agg(F.min(C.NAME).alias(C.NAME)).withColumn("_known", F.lit(True))
    s = G.screen_prompts(requests.join(known, C.USER, "left"))
    return s.select(
        "request_id", "ts", C.USER,
        F.coalesce(F.col("_known"), F.lit(False)).alias("known_owner"),
        F.when(F.col("_known").isNull(),
               F.concat(F.lit("User '"), F.col(C.USER), F.lit("' not found."))).alias("error"),
        "input_passed", "input_flag", "input_message", "effective_prompt",
        X.hash_user_id(C.USER).alias("user_id_hash"),
        X.hash_prompt("effective_prompt").alias("prompt_hash"),
        F.length("effective_prompt").cast("bigint").alias("prompt_length"),
        X.cents("latency_ms").alias("latency_ms"))


def audit_stream(screened: DataFrame, path: str, checkpoint: str,
                 trigger_once: bool = False) -> StreamingQuery:
    """Append screened requests of known owners to a JSON-lines audit folder,
    with all ten fields of a record. A blocked request is answered by its rule's
    message; for one that passed, what only its answer tells is null."""
    def write_batch(batch: DataFrame, epoch_id: int) -> None:
        blocked = ~F.col("input_passed")
        rows = batch.where("known_owner").select(
            F.col("ts").alias("timestamp"), "user_id_hash", "prompt_hash", "prompt_length",
            F.when(blocked, F.length("input_message").cast("bigint")).alias("response_length"), "latency_ms",
            F.array_compact(F.array("input_flag")).alias("guardrail_flags"),
            F.when(blocked, F.lit(False)).alias("cache_hit"),
            F.when(blocked, F.lit(0).cast("bigint")).alias("num_visualizations"), "error")
        rows.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{path}/epoch={epoch_id}")

    w = screened.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint)
    if trigger_once:
        w = w.trigger(availableNow=True)
    return w.start()
