"""The corpus pipeline: quality rules, SimHash near-dedup, substring dedup,
mixing sources to target weights, byte-level BPE. Each stage works on all rows
its predecessor kept; ``run`` applies the stages to ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm import bpe, mixing, quality, simhash, substrings
from ledgerlens.llm.common import cut_lineage, read_table
from ledgerlens.llm.queries import vocabulary

#: No SQL: fingerprints, ids and the seeded flow have none in DuckDB. The
#: stages are tested against brute force instead.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return quality.filter_quality(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (smallest doc_id)."""
    return simhash.keep_one(docs, words=4, bits=4)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a 13-word window of an earlier document
    repeats; a document that has no word left goes."""
    cut = substrings.remove_repeats(docs)
    left = cut.where("n_words = 0 OR n_removed < n_words")
    if "n_chars" in docs.columns:
        left = left.withColumn("n_chars", F.length("text").cast("long"))
    return left.select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.repeat_rows(mixing.mix(docs), docs.columns)


def encode_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids and each id's byte offset."""
    encoded = bpe.encode(docs, vocabulary())
    return encoded.withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("quality_rules", quality_rules), ("simhash_dedup", simhash_dedup),
          ("substring_dedup", substring_dedup), ("mix_sources", mix_sources),
          ("encode_bpe", encode_bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are cut from their
    lineage by a checkpoint before the next reads them."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, cut_lineage(docs) if k else docs, sf_dir)
    return docs
