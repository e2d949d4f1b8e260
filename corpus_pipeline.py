"""A training corpus from raw documents: quality rules, near duplicates, benchmark leaks, source mix, shards.

Each stage takes (spark, docs, sf_dir), where docs is what the stage before kept, written as Parquet and
read again. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridtide.llm import decontamination, jaccard, mixing, quality, sharding
from gridtide.llm.store import word_count, written

#: The mix and the learned rules can't be written as SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the list learned from the labels of the documents at hand."""
    counted = written(quality.statistics(docs, "doc_id"), "pipeline-statistics")
    rules = quality.fit(counted, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.judged(quality.statistics(quality.whole_rows(docs), "row"), rules).filter("kept").select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: the one with the least id, a null id last. Texts without words all stay.

    Rows are told by a hash of id and text, so repeated rows, rows without an id and reused ids are components like others.
    """
    rows = written(docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at")), "pipeline-rows")
    keyed = rows.select(F.xxhash64("row.doc_id", "row.text").alias("key"), F.col("row.doc_id").alias("doc_id"), F.col("row.text").alias("text"), "at")
    found = jaccard.join_components(keyed.select(F.col("key").alias("doc_id"), "text")).filter("n_shingles > 0")
    component = found.select(F.col("doc_id").alias("key"), F.col("component_id").alias("component")).distinct()
    first = keyed.groupBy("key").agg(F.min("doc_id").alias("doc_id"), F.min("at").alias("at")).join(component, "key")
    kept = first.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key", "at")).alias("least"))
    chosen = rows.join(kept.select(F.col("least.at").alias("at")), "at", "left_semi")
    return chosen.select("row").union(rows.filter(word_count(F.col("row.text")) == 0).select("row")).select("row.*")


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item."""
    found = decontamination.scan(quality.whole_rows(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), carried=("row",))
    return found.filter("n_hit = 0").select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it."""
    return mixing.repeated(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix."""
    return sharding.shard(docs)


STAGES = [("quality rules", quality_rules), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", benchmark_leaks),
          ("mixing sources to target weights", source_mix), ("sharding", shards)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`, each stage's result written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for at, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{at}")
    return docs
