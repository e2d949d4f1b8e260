"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import decontamination, jaccard, language, licenses, lines, mixing, quality, secrets, sharding, spelling, substrings, tokens, whitening
from gridtide.llm.store import written


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    """How often each document is taken for the target weights of the sources."""
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_shard(spark: SparkSession, sf: str) -> DataFrame:
    """Shard and slot of each document, shards of near-equal bytes."""
    return sharding.shard(table(spark, sf, "documents"))


def op3_decontaminate(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document inside windows of benchmark items."""
    found = decontamination.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", (F.col("n_hit") > 0).alias("contaminated"))


def op4_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Known licences of each document's whole text and of its lines."""
    return licenses.scan(table(spark, sf, "documents"))


def op5_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each document that lie in repeated windows of 35 words, and the digest of the rest."""
    return substrings.deduplicated(table(spark, sf, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op6_language_id(spark: SparkSession, sf: str) -> DataFrame:
    """Predicted language of each document."""
    return language.identify(table(spark, sf, "documents"))


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Lines of each document that many sources share, and the digest of the text without them."""
    return lines.deduplicated(table(spark, sf, "documents")).select("doc_id", "n_lines", "n_removed", F.md5("kept_text").alias("kept_md5"))


def op8_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Secrets and linked credential parts of each document."""
    return secrets.scan(table(spark, sf, "documents"))


def op9_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Near-duplicate component of each document."""
    return jaccard.join_components(table(spark, sf, "documents"))


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Statistics of each document and the verdict of base rules and learned list."""
    counted = written(quality.statistics(table(spark, sf, "documents"), "doc_id"), "quality-statistics")
    rules = quality.fit(counted, table(spark, sf, "labels"))
    return quality.judged(counted, rules).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Near words, form and root of each word of the documents."""
    return spelling.variants(table(spark, sf, "documents"))


def op12_whitening(spark: SparkSession, sf: str) -> DataFrame:
    """Leading whitened components of each embedding."""
    return whitening.whiten(table(spark, sf, "embeddings"))


def op13_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Bytes and tokens of each document, and whether it exceeds the context length."""
    return tokens.count_tokens(table(spark, sf, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_shard, op3_decontaminate, op4_license_scan, op5_substring_dedup, op6_language_id,
                                   op7_line_dedup, op8_secret_scan, op9_jaccard_join, op10_quality_rules, op11_spelling_variants,
                                   op12_whitening, op13_token_counts)}
ORACLES: dict[str, str] = {"op4_license_scan": licenses.SCAN_SQL, "op7_line_dedup": lines.DEDUP_SQL}
