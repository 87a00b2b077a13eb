"""The corpus pipeline: five stages over documents, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridmill.llm import decontamination, line_dedup, minhash_dedup, mixing, quality
from gridmill.llm.kernels import own, settle, settle_stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Common blocks leave the later of two documents; a document with nothing left goes."""
    return line_dedup.dedup(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id stays."""
    groups = settle(minhash_dedup.near_groups(docs))
    return docs.join(groups.filter(F.col("doc_id") != F.col("keep")).select("doc_id"), "doc_id", "left_anti").select(*own(docs))


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources drawn to their target weights; a document may come more than once, told by ``copy``."""
    return mixing.mix(docs)


STAGES = [("quality", quality_stage), ("line dedup", line_stage), ("near dedup", near_stage), ("decontamination", benchmark_stage), ("mixing", mixing_stage)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle_stage(lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), over=docs)
    return STAGES[-1][1](spark, docs, sf_dir)
