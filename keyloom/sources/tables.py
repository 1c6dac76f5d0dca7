"""Typed tables of a keyspace on any file system that Spark reads: one Parquet table per container type."""

from __future__ import annotations

import time
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file that makes a version count.
MARKER = "_COMMITTED"

SCHEMAS = {
    "kv_string": "key string, value binary, expire_ms long",
    "kv_hash": "key string, field string, value binary, field_expire_ms long",
    "kv_list": "key string, pos long, value binary",
    "kv_set": "key string, member binary",
    "kv_zset": "key string, member binary, score double",
    "kv_bits": "key string, pos long",
    "kv_stream": "key string, ms decimal(20,0), seq decimal(20,0), fields array<struct<f:string,v:binary>>",
    "command_log": "seq long, cmd string, key string, args array<binary>",
}


def empty(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], SCHEMAS[name])


def save(tables: dict[str, DataFrame], path: str, buckets: int = 0) -> None:
    """SAVE: a snapshot, one folder per table. ``buckets`` spreads each table by key, so later reads of a key are pruned."""
    for name, df in tables.items():
        out = df.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets))).repartition("bucket") if buckets else df
        writer = out.write.mode("overwrite")
        (writer.partitionBy("bucket") if buckets else writer).parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}").drop("bucket") for n in names}


def _files(spark: SparkSession, path: str) -> tuple[Any, Any, Any]:
    """The Java gateway, and the file system and path of ``path``."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def commit(tables: dict[str, DataFrame], path: str, buckets: int = 0) -> str:
    """A durable snapshot: a new version, which counts from the moment that its marker is there, after all its tables.

    A writer that dies leaves a version without a marker, which nobody reads; readers of older versions are not disturbed.
    """
    spark = next(iter(tables.values())).sparkSession
    version = f"v{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"
    save(tables, f"{path}/{version}", buckets)
    _, fs, marker = _files(spark, f"{path}/{version}/{MARKER}")
    fs.create(marker, False).close()
    return version


def versions(spark: SparkSession, path: str) -> list[str]:
    """The committed versions, oldest first."""
    _, fs, found = _files(spark, f"{path}/v*/{MARKER}")
    return sorted(x.getPath().getParent().getName() for x in fs.globStatus(found) or [])


def current(spark: SparkSession, path: str, names: list[str]) -> dict[str, DataFrame]:
    """The tables of the newest committed version."""
    known = versions(spark, path)
    if not known:
        raise FileNotFoundError(f"no committed version under {path}")
    return restore(spark, f"{path}/{known[-1]}", names)


def last_save(spark: SparkSession, path: str) -> int:
    """LASTSAVE: when the newest version was begun, in seconds; 0 without any."""
    known = versions(spark, path)
    return int(known[-1][1:21]) // 1_000_000_000 if known else 0


def discard_old(spark: SparkSession, path: str, keep: int = 1) -> None:
    """Versions but the newest ``keep`` committed ones go; uncommitted ones that are newer stay, they may be under way."""
    known = versions(spark, path)
    for version in known[: len(known) - keep]:
        _, fs, where = _files(spark, f"{path}/{version}")
        fs.delete(where, True)


def append_log(log: DataFrame, path: str) -> None:
    """The command log is append-only; tables are folds of it."""
    log.write.mode("append").parquet(f"{path}/command_log")


def compact(log: DataFrame) -> DataFrame:
    """The rows of a log (seq, cmd, key, args) that still matter: per key, those since its last SET or DEL.

    A key whose last command is a DEL vanishes.
    """
    whole = F.col("cmd").isin("SET", "DEL")
    last = log.filter(whole).groupBy("key").agg(F.max("seq").alias("last"), F.max_by("cmd", "seq").alias("how"))
    joined = log.join(last, "key", "left").filter(F.col("last").isNull() | (F.col("seq") > F.col("last")) | ((F.col("seq") == F.col("last")) & (F.col("how") == "SET")))
    return joined.select("seq", "cmd", "key", "args")
