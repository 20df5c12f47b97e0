"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe_fst, divergence, grammar_files, importance, media_ts, mixing, oracles, pii, quality, quality_model, simhash, site_tree, suffix_dedup, token_counts
from sparkloom.llm.common import documents


def op1_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    streams = media_ts.store_texts(documents(spark, sf_dir))
    return media_ts.stream_features(streams, keep=("n_bytes",))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe_fst.encoding_digests(documents(spark, sf_dir), path, public_tokenizers.PATTERN)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix_plan(documents(spark, sf_dir))
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken")


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicate_groups(documents(spark, sf_dir))
    digits = F.lower(F.lpad(F.hex("fingerprint"), 16, "0"))
    return groups.select("doc_id", digits.alias("fingerprint"), "component_id")


def op5_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.removed_strings(documents(spark, sf_dir))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_figures(documents(spark, sf_dir))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return site_tree.extract_main_text(pages).withColumn("n_chars", F.length("text").cast("long"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = grammar_files.token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return grammar_files.token_file_digests(files)


def op11_importance_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    drawn = importance.importance_draw(documents(spark, sf_dir), benchmark)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


def op12_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence_audit(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_transport_streams, op2_byte_bpe, op3_source_mixing, op4_simhash_groups, op5_personal_data, op6_repeated_strings, op7_quality_rules, op8_token_counts, op9_main_text, op10_token_files, op11_importance_draw, op12_quality_scores, op13_source_divergence)}


def oracle_sql() -> dict[str, str]:
    return {"op6_repeated_strings": oracles.REPEATED_STRINGS, "op11_importance_draw": oracles.IMPORTANCE_DRAW, "op13_source_divergence": oracles.SOURCE_DIVERGENCE}
