"""Registered pipeline queries: messages, budget, trimming, results, audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import columns as C
from ..operators import messages as M
from ..operators.sequences import FEW_SHOT_HEADER
from ..sources.ledger import read_table
from . import pipeline as PL
from .log_queries import log_tables, result_rows


def _messages(spark, d):
    return PL.with_messages(log_tables(spark, d)[1])


def build_messages(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    return m.select("request_id", C.USER, F.size("messages").cast("bigint").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda x: x["role"]), ",").alias("roles"),
                    F.sha2(F.array_join(F.transform("messages", lambda x: x["content"]), "\u0000"),
                           256).alias("content_sha256"))


def token_budget(spark: SparkSession, d: str) -> DataFrame:
    m = _messages(spark, d)
    return m.select("request_id", M.context_tokens(F.col("messages")).alias("context_tokens"),
                    M.token_sum(F.col("messages")).alias("message_tokens"),
                    M.budget_flag(F.col("messages")).alias("budget_flag"))


def trim_messages(spark: SparkSession, d: str) -> DataFrame:
    t = M.trim_messages(_messages(spark, d))
    return t.select("request_id", F.size("trimmed").cast("bigint").alias("n_messages"),
                    M.token_sum(F.col("trimmed")).alias("message_tokens"))


def answer_requests(spark: SparkSession, d: str) -> DataFrame:
    return result_rows(spark, d).select(
        "request_id", C.USER, C.NAME, "response",
        F.array_join(F.array_sort(F.transform(F.map_entries("data_summary"), lambda e: F.concat(
            e["key"], F.lit("="), e["value"]))), "|").alias("data_summary"),
        F.array_join("visualizations", ",").alias("visualizations"),
        "cache_hit", "latency_ms",
        F.array_join("guardrail_flags", "|").alias("guardrail_flags"), "error")


def audit_records(spark: SparkSession, d: str) -> DataFrame:
    """S4; the flags, an array in the sink, are joined here for comparison."""
    return PL.audit_records(result_rows(spark, d)).withColumn(
        "guardrail_flags", F.array_join("guardrail_flags", "|"))


def document_contexts(spark: SparkSession, d: str) -> DataFrame:
    """M3 and M4 on long texts: each document, once to eight times in a row, as
    a message context (a third of it as history, as data summary and as prompt),
    cut to the budget's characters and trimmed step by step."""
    doc = read_table(spark, d, "documents").select("doc_id", F.repeat(
        F.coalesce("text", F.lit("")), (F.col("doc_id") % 8 + 1).cast("int")).alias("text"))
    n = F.floor(F.length("text") / 3).cast("int")
    part = lambda a, length: F.substring(F.col("text"), a, length)
    doc = doc.select("doc_id", F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("about"),
                     part(n + 1, n).alias("summary"), F.concat(F.lit(FEW_SHOT_HEADER), part(F.lit(1), n)).alias("history"),
                     part(2 * n + 1, F.length("text")).alias("prompt"))
    t = M.trim_messages(doc.select("doc_id", M.build_messages("about", "summary", "history", "prompt").alias("messages")))
    joined = F.array_join(F.transform("trimmed", lambda m: m["content"]), "\u0000")
    return t.select("doc_id", M.context_tokens(F.col("messages")).alias("context_tokens"),
                    M.budget_flag(F.col("messages")).alias("budget_flag"),
                    F.sha2(M.cut_context(F.col("messages")), 256).alias("cut_sha256"),
                    F.size("trimmed").cast("bigint").alias("n_messages"),
                    M.token_sum(F.col("trimmed")).alias("message_tokens"), F.sha2(joined, 256).alias("trimmed_sha256"))


QUERIES = {
    "document_contexts": document_contexts,
    "build_messages": build_messages,
    "token_budget": token_budget,
    "trim_messages": trim_messages,
    "answer_requests": answer_requests,
    "audit_records": audit_records,
}
