"""The corpus pipeline: quality classifier, line dedup, near-dedup, benchmark decontamination, source mixing.

Each stage is (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame with the columns of
documents, the last one the mixed corpus with a copy number. Stages are written as Parquet in the shared folder and read
again, so a lost executor never costs more than the stage it was in.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyloom.llm import decontam, line_dedup, mixing, near_dup, quality_mil
from keyloom.llm.common import column, documents, materialise


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go; the labels table is what it learns from."""
    return quality_mil.accept(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).select(*map(column, docs.columns))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that three documents or more hold stay in one; n_chars follows the text that is left."""
    kept = line_dedup.dedup_lines(docs).select(*map(column, docs.columns))
    return kept.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else kept


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays."""
    return near_dup.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it."""
    return mixing.mix(docs)


STAGES = [("quality classifier", quality), ("line dedup", lines), ("near dedup", near), ("decontamination", benchmark), ("source mixing", mixture)]

#: The quality classifier is learned, so SQL can't express the rows; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
