"""The thin ``opN_<name>`` queries: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, compression, html, katz, lengths, mixing, neighbours, quality, ranking, sharding, simhash,
               substrings, whitening)
from .common import read_table


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def op1_byte_bpe(spark: SparkSession, d: str) -> DataFrame:
    """Encode every document, decode the ids, digest both."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    path = vocabulary()
    back = bpe.decode(bpe.encode(docs, path, drop_text=True), path)
    return back.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"))


def op3_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Words covered by a 13-word window that a smaller doc_id also has go."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    kept = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " "))
    return substrings.remove_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2(kept, 256).alias("kept_sha256"))


def op4_quality_rules(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return quality.cascade(docs, measures=True).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept")


def op5_simhash(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return simhash.near_duplicates(docs, words=4, bits=4).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op10_mixing(spark: SparkSession, d: str) -> DataFrame:
    docs = read_table(spark, d, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, drop_text=True).select("doc_id", "size", "source_size", "target", "taken")


def op8_sharding(spark: SparkSession, d: str) -> DataFrame:
    """All documents into 8 shards with counts of rows at most one apart;
    documents of equal text share a shard as far as there is room."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    return sharding.shard_documents(docs, 8)


def op2_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The 20 nearest rows by inner product for every row whose id is divisible by 20."""
    vectors = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 20 == 0), k=20)


def op6_token_counts(spark: SparkSession, d: str) -> DataFrame:
    """Documents by encoded length, with suffix sums for every length as limit."""
    docs = read_table(spark, d, "documents").select("text")
    return lengths.suffix_sums(lengths.histogram(docs, vocabulary()))


def op7_html_text(spark: SparkSession, d: str) -> DataFrame:
    pages = read_table(spark, d, "pages").select("page_id", "url", "html")
    return html.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op9_lm_scores(spark: SparkSession, d: str) -> DataFrame:
    """Katz scores of every document by runs of up to two words (the operator's
    default order; order 3 exceeds the check tool's disk limit, see the README);
    one fifth (by checksum of the id) is held out."""
    docs = read_table(spark, d, "documents").select(
        "doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 5 == 1).alias("held_out"))
    flagged = docs.withColumn("train", ~F.coalesce("held_out", F.lit(False)))
    return katz.score(flagged, "train", drop_text=True).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op11_quality_classifier(spark: SparkSession, d: str) -> DataFrame:
    """Score every document; three quarters of the labels (by checksum of the id) train."""
    docs = read_table(spark, d, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = compression.fit(docs, read_table(spark, d, "labels").select("doc_id", "quality"), ~held_out)
    return compression.classify(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op12_ranked_search(spark: SparkSession, d: str) -> DataFrame:
    """The 10 highest-scoring documents for each benchmark item."""
    return ranking.search(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"), k=10)


def op13_whitening(spark: SparkSession, d: str) -> DataFrame:
    """Each embedding on the first four whitened components, fitted on each distinct vector once."""
    return whitening.whiten(read_table(spark, d, "embeddings"), k=4, weights="one")
