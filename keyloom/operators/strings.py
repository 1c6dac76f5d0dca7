"""Strings: rows (key, value) with lengths, slices and overwrites in bytes, and ordered logs of updates."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def live(rows: DataFrame, now_ms: int, expire: str = "expire_ms") -> DataFrame:
    """Rows without a deadline, or before it."""
    return rows.filter(F.col(expire).isNull() | (F.col(expire) > now_ms))


def mget(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per asked key (key, pos), in request order, with a null value where there is none."""
    return keys.join(rows.select("key", "value"), "key", "left").select("pos", "key", "value")


def byte_slice(value: Column, start: int, end: int, clamp_end: bool = True) -> Column:
    """Bytes start to end, both counted, negative from the end. ``clamp_end``: an end before byte 0 is byte 0."""
    n = F.octet_length(value)
    a = F.greatest(n + start, F.lit(0)) if start < 0 else F.lit(start)
    b = n + end if end < 0 else F.lit(end)
    if clamp_end:
        b = F.greatest(b, F.lit(0))
    b = F.least(b, n - 1)
    raw = value.cast("binary")
    return F.when((a > b) | (n == 0) | (b < 0), F.lit(b"")).otherwise(F.substring(raw, a + 1, b - a + 1))


def byte_overwrite(value: Column, offset: int, new: bytes) -> Column:
    """The bytes with ``new`` written at ``offset``; a gap is filled with zero bytes."""
    raw, k = value.cast("binary"), len(new)
    if not k:
        return raw
    n = F.octet_length(raw)
    head = F.when(n >= offset, F.substring(raw, F.lit(1), F.lit(offset))).otherwise(F.concat(raw, F.unhex(F.repeat(F.lit("00"), F.lit(offset) - n))))
    return F.concat(head, F.lit(new), F.when(n > offset + k, F.substring(raw, F.lit(offset + k + 1), n)).otherwise(F.lit(b"")))


def last_set(log: DataFrame, first: bool = False) -> DataFrame:
    """The value of the last SET of each key (the first, for SET NX), from rows (key, seq, value)."""
    pick = F.min_by if first else F.max_by
    return log.groupBy("key").agg(pick("value", "seq").alias("value"))


def set_log(rows: DataFrame, log: DataFrame, only_new: bool = False, only_old: bool = False, keep_ttl: bool = False) -> DataFrame:
    """SET of a log (key, seq, value, expire_ms) over the live rows (key, value, expire_ms): NX, XX and KEEPTTL.

    NX writes a missing key once, XX only keys that are there, and a write replaces the deadline unless KEEPTTL.
    """
    if only_new and only_old:
        raise ValueError("NX and XX do not go together")
    pick = F.min_by if only_new else F.max_by
    new = log.groupBy("key").agg(pick(F.struct("value", "expire_ms"), "seq").alias("n"))
    held = rows.select("key", F.struct("value", "expire_ms").alias("h"))
    both = held.join(new, "key", "left" if only_old else "full")
    had = F.col("h").isNotNull()
    writes = F.col("n").isNotNull() & (~had if only_new else F.lit(True))
    expire = F.when(writes & ~F.lit(keep_ttl), F.col("n.expire_ms")).otherwise(F.col("h.expire_ms"))
    return both.select("key", F.when(writes, F.col("n.value")).otherwise(F.col("h.value")).alias("value"), expire.cast("long").alias("expire_ms"))


def replaced(log: DataFrame) -> DataFrame:
    """What each SET of the log replaced: the value before it, null for the first."""
    return log.withColumn("old", F.lag("value").over(Window.partitionBy("key").orderBy("seq")))


def counters(log: DataFrame) -> DataFrame:
    """Counters from rows (key, seq, op, amount), op being set, incr or del: the sum since the last set or deletion.

    Sums are exact and an overflow raises. A key whose last command is a deletion has no row.
    """
    resets = log.filter(F.col("op").isin("set", "del")).groupBy("key").agg(F.max("seq").alias("reset"))
    since = log.join(resets, "key", "left").filter(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))
    value = F.sum(F.when(F.col("op").isin("set", "incr"), F.col("amount")).otherwise(F.lit(0)))
    last = F.max_by("op", "seq")
    return since.groupBy("key").agg(value.alias("value"), last.alias("last")).filter("last <> 'del'").drop("last")


def appended(log: DataFrame) -> DataFrame:
    """APPEND in the order of seq: the whole value and its length in bytes."""
    parts = F.array_sort(F.collect_list(F.struct("seq", "value")))
    whole = F.array_join(F.transform(parts, lambda x: x["value"]), "")
    return log.groupBy("key").agg(whole.alias("value")).withColumn("length", F.octet_length("value"))


def lcs_length(a: str, b: str) -> int:
    """The length in bytes of the longest common subsequence, with one machine word row per symbol (bit-parallel)."""
    x, y = a.encode(), b.encode()
    if len(x) < len(y):
        x, y = y, x
    masks: dict[int, int] = {}
    for i, c in enumerate(x):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(x)) - 1
    v = full
    for c in y:
        u = v & masks.get(c, 0)
        v = ((v + u) | (v - u)) & full
    return len(x) - bin(v).count("1")


def lcs(pairs: DataFrame) -> DataFrame:
    """Rows (a, b) with lcs, the length of the longest common subsequence; a null value is empty."""

    @F.pandas_udf("long")
    def longest(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in parts:
            yield pd.Series([lcs_length(x or "", y or "") for x, y in zip(a, b, strict=True)])

    return pairs.withColumn("lcs", longest("a", "b"))


def put_if_none(rows: DataFrame, new: DataFrame) -> DataFrame:
    """MSETNX: all of ``new`` or, if one of its keys exists, nothing."""
    taken = new.join(rows, "key", "left_semi").agg((F.count(F.lit(1)) > 0).alias("taken")).scalar()
    return rows.select("key", "value").unionAll(new.filter(~taken).select("key", "value"))
