"""Queries of the subpackage: each takes (spark, sf_dir) and applies an operator to whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fingerprint, language_crf, line_rules, mixing, packing, quality, sharding, signature_join, token_counts, toxicity
from .common import fold, read, shared_dir


def op1_pack_length_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), columns=["doc_id"])


def op2_mix_pareto_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read(spark, sf_dir, "documents")).drop("copies")


def op3_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(read(spark, sf_dir, "documents"), shared_dir(spark, "shards"))


def op4_toxicity_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, out_col="score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_quality_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, read(spark, sf_dir, "labels"))
    scored = quality.score(docs, model, out_col="score")
    return scored.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_oph_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_report(read(spark, sf_dir, "documents"))


def op7_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.report(read(spark, sf_dir, "documents"))


def op8_longest_match_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    matcher = token_counts.LongestMatch(*token_counts.load_vocabulary())
    return token_counts.count_tokens(docs, matcher).drop("text")


def op9_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language_crf.fit(docs)
    out = language_crf.predict(docs.select("doc_id", "text"), model, score_col="score")
    return out.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")


def op10_signature_tree_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_join.linked_components(read(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_pack_length_buckets": op1_pack_length_buckets,
        "op2_mix_pareto_sample": op2_mix_pareto_sample,
        "op3_shard_compaction": op3_shard_compaction,
        "op4_toxicity_compression": op4_toxicity_compression,
        "op5_quality_embeddings": op5_quality_embeddings,
        "op6_oph_fingerprints": op6_oph_fingerprints,
        "op7_line_rules": op7_line_rules,
        "op8_longest_match_tokens": op8_longest_match_tokens,
        "op9_language_crf": op9_language_crf,
        "op10_signature_tree_join": op10_signature_tree_join,
    }
