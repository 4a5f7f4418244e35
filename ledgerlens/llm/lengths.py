"""Token counts from an exact length histogram (operator 6).

Documents are aggregated by encoded length. Suffix sums over the lengths then
answer, for every context limit, how many documents and tokens there are, how
many reach the limit, what remains if each is cut at the limit, and any
quantile, without going back to documents.

Defined cases: a null or empty text has length 0; repeated rows count each; an
empty table has an empty histogram; extra columns play no part.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .bpe import count_tokens
from .common import cut_lineage

#: Lengths of one block of the suffix sums: block sums first, then within blocks.
BLOCK_LENGTHS = 512


def histogram(df: DataFrame, vocab: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs): how many documents have each encoded length."""
    counted = count_tokens(df.select(text_col), vocab, text_col)
    return counted.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L of the histogram: docs_at_least and tokens_at_least
    (documents of length L or more), total_docs, total_tokens and
    truncated_total (tokens that remain if every document is cut at L)."""
    # read twice below; a row a length, so that documents are encoded once
    hist = cut_lineage(hist)
    hist = hist.withColumn("__block", F.floor(F.col("n_tokens") / BLOCK_LENGTHS)) \
        .withColumn("__tokens", F.col("n_tokens") * F.col("n_docs"))
    blocks = hist.groupBy("__block").agg(F.sum("n_docs").alias("__d"), F.sum("__tokens").alias("__t"))
    later = W.orderBy(F.desc("__block")).rowsBetween(W.unboundedPreceding, W.currentRow)
    every = W.partitionBy()
    base = blocks.select(
        "__block", (F.sum("__d").over(later) - F.col("__d")).alias("__d0"),
        (F.sum("__t").over(later) - F.col("__t")).alias("__t0"),
        F.sum("__d").over(every).alias("total_docs"), F.sum("__t").over(every).alias("total_tokens"))
    inner = W.partitionBy("__block").orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.currentRow)
    out = hist.join(base, "__block").select(
        "n_tokens", "n_docs", (F.col("__d0") + F.sum("n_docs").over(inner)).alias("docs_at_least"),
        (F.col("__t0") + F.sum("__tokens").over(inner)).alias("tokens_at_least"), "total_docs", "total_tokens")
    return out.withColumn("truncated_total", F.col("total_tokens") - F.col("tokens_at_least")
                          + F.col("n_tokens") * F.col("docs_at_least"))


def answers(sums: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit: documents and tokens in documents of at most
    that length, and what remains if every document is cut at the limit. Read
    off the next length above the limit."""
    asked = sums.sparkSession.createDataFrame([(int(x),) for x in sorted(set(limits))], "context_limit long")
    above = sums.select("n_tokens", "docs_at_least", "tokens_at_least")
    whole = sums.agg(F.max("total_docs").alias("d"), F.max("total_tokens").alias("t"))
    nearest = asked.join(above, F.col("n_tokens") > F.col("context_limit"), "left").groupBy("context_limit").agg(
        F.min_by(F.struct("docs_at_least", "tokens_at_least"), "n_tokens").alias("x"))
    over_docs = F.coalesce("x.docs_at_least", F.lit(0))
    over_tokens = F.coalesce("x.tokens_at_least", F.lit(0))
    return nearest.join(whole).select(
        "context_limit", (F.coalesce("d", F.lit(0)) - over_docs).alias("docs_that_fit"),
        (F.coalesce("t", F.lit(0)) - over_tokens).alias("tokens_that_fit"),
        (F.coalesce("t", F.lit(0)) - over_tokens + F.col("context_limit") * over_docs).alias("truncated_total"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The smallest length that at least this share of the documents does not exceed."""
    asked = sums.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    upto = F.col("total_docs") - F.col("docs_at_least") + F.col("n_docs")
    return asked.join(sums, upto >= F.ceil(F.col("share") * F.col("total_docs"))) \
        .groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
