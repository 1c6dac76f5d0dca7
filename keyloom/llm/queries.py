"""The registered queries of the training-data operators: thin digests over the operators' outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontam, html_main, line_dedup, mixing, near_dup, quality_mil, quality_rules, substring, token_count, toxicity
from keyloom.llm.common import documents

TOKEN_LIMIT = 2048


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_count.count_tokens(documents(spark, sf_dir)).withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(documents(spark, sf_dir))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(documents(spark, sf_dir))
    return judged.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(documents(spark, sf_dir))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.remove_repeats(documents(spark, sf_dir))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.report(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_main.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_counts, op2_source_mix, op3_line_dedup, op6_quality_rules, op8_decontamination, op9_near_dedup, op10_substring_dedup, op4_quality_classifier, op5_toxicity, op7_html_extraction)}
ORACLES: dict[str, str] = {"op2_source_mix": mixing.ORACLE, "op3_line_dedup": line_dedup.ORACLE, "op6_quality_rules": quality_rules.ORACLE, "op8_decontamination": decontam.ORACLE, "op10_substring_dedup": substring.ORACLE}
