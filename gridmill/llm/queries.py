"""The queries of this subpackage and their SQL, for the driver's entry module."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"  #: the rank file that op5 reads, on every worker


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmill.llm.substring_dedup import repeated_spans

    return repeated_spans(_table(spark, sf_dir, "documents"))


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmill.llm.decontamination import matches

    return matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmill.llm.line_dedup import trimmed

    return trimmed(_table(spark, sf_dir, "documents"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmill.llm.token_counts import count_tokens

    return count_tokens(_table(spark, sf_dir, "documents"), VOCABULARY)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents with their scores."""
    from gridmill.llm.toxicity import scores

    return scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).filter("toxic").select("doc_id", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmill.llm.mixing import mix

    return mix(_table(spark, sf_dir, "documents")).select("doc_id", "source", "copy", "slot", "n_tokens")


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmill.llm.exact_topk import nearest

    return nearest(_table(spark, sf_dir, "embeddings"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmill.llm.lm_scoring import score_documents

    return score_documents(_table(spark, sf_dir, "documents"))


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gridmill.llm.minhash_dedup import near_groups

    return near_groups(_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps, with their perplexities."""
    from gridmill.llm.quality import perplexities

    return perplexities(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")).filter("keep").select("doc_id", "perplexity", "threshold")


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_exact_topk, op3_lm_scoring, op4_line_dedup, op5_token_counts, op6_substring_dedup, op7_minhash_dedup, op8_toxicity, op9_mixing, op10_quality)}


def sql() -> dict[str, str]:
    from gridmill.llm import exact_topk, lm_scoring, mixing, substring_dedup

    return {"op2_exact_topk": exact_topk.SQL, "op3_lm_scoring": lm_scoring.SQL, "op6_substring_dedup": substring_dedup.SQL, "op9_mixing": mixing.SQL}
