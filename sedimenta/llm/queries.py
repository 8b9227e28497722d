"""The operators of this subpackage applied to the tables of a folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat_format, embedding_dedup, lm_scoring, mixing, near_dedup, packing, pii, quality_classifier, quality_rules, token_counts


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, folder, "documents"))


def op2_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.best_fit(_table(spark, folder, "documents"))


def op3_cotraining_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op4_line_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.line_frequency(_table(spark, folder, "documents")).drop("removed_lines")


def op5_systematic_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.systematic_mix(_table(spark, folder, "documents"))


def op6_stupid_backoff(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.stupid_backoff(_table(spark, folder, "documents")).withColumn("log_score", F.round("log_score", 3))


def op7_embedding_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return embedding_dedup.near_embeddings(_table(spark, folder, "embeddings"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, folder, "documents"), tokenizer("piece_bpe_32k.model"))


def op9_preference_format(spark: SparkSession, folder: str) -> DataFrame:
    out = chat_format.preferences(chat_format.derived_pairs(_table(spark, folder, "conversations")))
    return out.withColumns({c: chat_format.mask_text(out[c]) for c in ("chosen_mask", "rejected_mask")})


def op10_contextual_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.find(_table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_minhash_near_dedup, op2_best_fit_packing, op3_cotraining_quality, op4_line_frequency, op5_systematic_mix, op6_stupid_backoff, op7_embedding_near_dedup, op8_token_counts, op9_preference_format, op10_contextual_pii)
}
SQL: dict[str, str] = {
    "op4_line_frequency": quality_rules.QUERY_SQL,
    "op5_systematic_mix": mixing.QUERY_SQL,
    "op6_stupid_backoff": lm_scoring.QUERY_SQL,
    "op7_embedding_near_dedup": embedding_dedup.QUERY_SQL,
    "op9_preference_format": chat_format.QUERY_SQL,
}
