"""Registered screening queries (prompts, answers, whole documents)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import columns as C
from ..functions import exprs as X
from ..functions import patterns as P
from ..operators import grounding as GR
from ..operators import profile as PR
from ..operators import screening as G
from ..session import cut_lineage
from ..sources import derived as D
from ..sources.ledger import COPY, DEALT, hot_owners, owner_ledger, read_table, rows_of_owners
from .store import bucketed, fingerprint, stored


def _screened(spark, d):
    return G.screen_prompts(D.requests(spark, d))


def prompt_injection(spark: SparkSession, d: str) -> DataFrame:
    r = D.requests(spark, d)
    return r.select("request_id", C.USER, G.injection_hit("prompt").alias("is_injection"))


def cross_user(spark: SparkSession, d: str) -> DataFrame:
    r = D.requests(spark, d)
    return r.select("request_id", C.USER, G.cross_user_hit("prompt", C.USER).alias("is_cross_user"))


def off_topic(spark: SparkSession, d: str) -> DataFrame:
    r = D.requests(spark, d)
    return r.select("request_id", C.USER, G.off_topic_hit("prompt").alias("is_off_topic"))


def prompt_length(spark: SparkSession, d: str) -> DataFrame:
    r = D.requests(spark, d)
    return r.select("request_id", F.length("prompt").cast("bigint").alias("prompt_length"),
                    G.too_long("prompt").alias("is_too_long"),
                    F.substring("prompt", 1, P.MAX_PROMPT_LENGTH).alias("truncated_prompt"))


def screen_prompts(spark: SparkSession, d: str) -> DataFrame:
    s = _screened(spark, d)
    return s.select("request_id", C.USER, "input_passed", "input_flag", "input_message",
                    F.length("effective_prompt").cast("bigint").alias("effective_length"))


def prompt_hashes(spark: SparkSession, d: str) -> DataFrame:
    s = _screened(spark, d)
    return s.select("request_id", X.hash_user_id(C.USER).alias("user_id_hash"),
                    X.hash_prompt("effective_prompt").alias("prompt_hash"),
                    X.estimate_tokens("effective_prompt").alias("prompt_tokens"))


def screen_documents(spark: SparkSession, d: str) -> DataFrame:
    """Input and output rules over whole document texts (long-text safety)."""
    doc = (read_table(spark, d, "documents").select("doc_id", "text")
           .withColumn("_low", F.lower("text"))
           .withColumn("_low_strip", G.py_strip(F.col("_low"))))
    lo, ls = F.col("_low"), F.col("_low_strip")
    return doc.select(
        "doc_id",
        G.matches_any(ls, P.INJECTION_PATTERNS).alias("is_injection"),
        G.matches_any(ls, P.OFF_TOPIC_PATTERNS).alias("off_topic_pattern"),
        X.contains_any(ls, P.FINANCIAL_KEYWORDS).alias("has_financial_keyword"),
        F.size(F.regexp_extract_all(lo, F.lit(P.USER_ID_PATTERN), F.lit(0)))
        .cast("bigint").alias("n_user_ids"),
        F.size(G.extracted_numbers("text")).cast("bigint").alias("n_numbers"),
        X.contains_any(lo, P.TOXICITY_KEYWORDS).alias("is_toxic"),
        X.contains_any(lo, P.HEDGING_PHRASES).alias("is_hedging"),
    )


#: Most bytes of line items for a bucket of owner facts: what a task sorts and groups.
BUCKET_BYTES = 16 << 20


def owner_facts(spark, d):
    """The facts of the ledger with and without merchants (told apart by
    ``COPY``), bucketed by owner, stored once a session: one pass for the
    answers and the numbers that they are checked against."""
    inputs = [f"{d}/{t}.parquet" for t in ("lineitem", "orders", "customer", "part", "supplier")]
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions", "200")),
                  fingerprint(spark, inputs[0])[1] // BUCKET_BYTES)

    def build():
        hot = stored(spark, "hot_owners", inputs[1:2], lambda: hot_owners(spark, d))
        return PR.owner_facts(owner_ledger(spark, d, hot, buckets), names=False, together=True, apart=(COPY, DEALT))
    return bucketed(spark, "owner_facts", inputs, C.USER, buckets, build)


def _answers(spark, d):
    """Answers with the flags of the numbers that their owner's ledger does not
    back. The answers, read by both sides of the join, are written once."""
    facts = owner_facts(spark, d)
    a = cut_lineage(D.answers(spark, d, facts))
    actuals = rows_of_owners(facts.where(F.col(COPY).isNotNull()),
                             lambda f, together: PR.actual_rows(facts=f, together=together))
    flags = GR.number_flags(a, actuals, "answer_id")
    return a.join(flags, "answer_id", "left")


def number_grounding(spark: SparkSession, d: str) -> DataFrame:
    a = _answers(spark, d)
    return a.select("answer_id", F.coalesce(F.array_join("number_flags", "|"), F.lit("")).alias("number_flags"))


def date_grounding(spark: SparkSession, d: str) -> DataFrame:
    a = D.answers(spark, d)
    return a.select("answer_id", F.array_join(
        G.ungrounded_date_flags("response", "first_date", "last_date"), "|").alias("date_flags"))


def toxicity(spark: SparkSession, d: str) -> DataFrame:
    a = D.answers(spark, d)
    return a.select("answer_id", G.toxic_hit("response").alias("is_toxic"))


def confidence(spark: SparkSession, d: str) -> DataFrame:
    a = D.answers(spark, d)
    return a.select("answer_id", G.hedging_hit("response").alias("is_hedging"),
                    (F.col("n_rows") < P.SPARSE_ROWS).alias("is_sparse"))


def screen_answers(spark: SparkSession, d: str) -> DataFrame:
    s = G.screen_answers(_answers(spark, d))
    return s.select("answer_id", "output_passed",
                    F.array_join("output_flags", "|").alias("output_flags"),
                    "output_message", "final_response")


QUERIES = {
    "prompt_injection": prompt_injection,
    "cross_user": cross_user,
    "off_topic": off_topic,
    "prompt_length": prompt_length,
    "screen_prompts": screen_prompts,
    "prompt_hashes": prompt_hashes,
    "screen_documents": screen_documents,
    "number_grounding": number_grounding,
    "date_grounding": date_grounding,
    "toxicity": toxicity,
    "confidence": confidence,
    "screen_answers": screen_answers,
}
