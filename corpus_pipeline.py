"""The corpus pipeline: quality, exact dedup, near dedup, decontamination, mixing.

Every stage reads the documents that its predecessor kept, in whole, and all but the
last return the columns of ``documents``.  Before a stage the executors give back the heap
that the stages before it have grown, since its Python workers need the memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terraloom.llm.decontaminate import decontaminate
from terraloom.llm.exact_dedup import exact_dedup
from terraloom.llm.filters import without
from terraloom.llm.mixing import mix
from terraloom.llm.ngram_join import ngram_components
from terraloom.llm.quality import score_quality
from terraloom.llm.runtime import spared, written


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects (score below its threshold) go; null texts are scored as empty."""
    spared(spark)
    scored = score_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return without(docs, scored.where("predicted = 0").select("doc_id"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the smallest id stays; rows that repeat both id and text become one."""
    spared(spark)
    found = written(exact_dedup(docs), "exact")
    by_id = found.groupBy("doc_id").agg(F.max("kept").alias("some"), F.min("kept").alias("all"), F.count("*").alias("n"))
    left = without(docs, by_id.where("NOT some").select("doc_id"))
    repeated = written(by_id.where("n > 1 AND some AND NOT all").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return left
    again = left.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return without(left, repeated).unionByName(again)


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of similar ones stays: the smallest id."""
    spared(spark)
    return without(docs, ngram_components(docs).where("doc_id <> component_id").select("doc_id"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    spared(spark)
    found = decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return without(docs, found.where("contaminated").select("doc_id"))


def mixing_to_target_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each remaining document."""
    spared(spark)
    return mix(docs)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup_stage),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_to_target_weights", mixing_to_target_weights),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
