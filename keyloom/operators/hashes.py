"""Hashes: rows (key, field, value, field_expire_ms)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.operators.keys import millis_left, seconds_left, set_deadline


def live(h: DataFrame, now_ms: int) -> DataFrame:
    """The fields that have not expired: every read and every update starts from these, as if the others were not there."""
    return h.filter(F.col("field_expire_ms").isNull() | (F.col("field_expire_ms") > now_ms))


def upsert(h: DataFrame, new: DataFrame, only_new: bool = False) -> DataFrame:
    """HSET (HSETNX): the last value of each (key, field) of the log ``new`` (key, field, seq, value); HSET drops a field's deadline.

    added is 1 for a field that was not there.
    """
    pick = F.min_by if only_new else F.max_by
    n = new.groupBy("key", "field").agg(pick("value", "seq").alias("new"))
    both = h.join(n, ["key", "field"], "full")
    value = F.coalesce("value", "new") if only_new else F.coalesce("new", "value")
    return both.select("key", "field", value.alias("value"), F.when(F.col("value").isNull(), 1).otherwise(0).alias("added"))


def as_map(h: DataFrame) -> DataFrame:
    """One row per key with its fields as a map in field order."""
    pairs = F.array_sort(F.collect_list(F.struct("field", "value")))
    return h.groupBy("key").agg(F.map_from_entries(pairs).alias("fields"))


def mget(h: DataFrame, fields: list[str]) -> DataFrame:
    """One row per key with the asked fields as columns, null where missing: one aggregation for all."""
    return h.groupBy("key").agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])


def delete(h: DataFrame, fields: list[str]) -> DataFrame:
    return h.filter(~F.col("field").isin(fields))


def increase(h: DataFrame, by: DataFrame) -> DataFrame:
    """HINCRBY of many (key, field, delta) rows: pre-aggregated, added to the integer value; a missing field starts at 0."""
    d = by.groupBy("key", "field").agg(F.sum("delta").alias("delta"))
    total = F.coalesce(F.col("value").cast(d.schema["delta"].dataType), F.lit(0)) + F.coalesce("delta", F.lit(0))
    return h.select("key", "field", "value").join(d, ["key", "field"], "right").select("key", "field", total.alias("value"))


def expire_fields(h: DataFrame, fields: list[str], at_ms: int, condition: str | None = None) -> DataFrame:
    new = set_deadline(F.col("field_expire_ms"), F.lit(at_ms).cast("long"), condition)
    return h.withColumn("field_expire_ms", F.when(F.col("field").isin(fields), new).otherwise(F.col("field_expire_ms")))


def time_left(h: DataFrame, now_ms: int, unit: str = "s") -> DataFrame:
    """-1 without a deadline; expired fields have no row."""
    left = (seconds_left if unit == "s" else millis_left)(F.col("field_expire_ms"), now_ms)
    return live(h, now_ms).select("key", "field", left.alias("left"))
