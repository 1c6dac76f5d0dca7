"""Bitmaps as rows (key, pos) of set bits; bit 0 is the highest bit of byte 0. The sparse form needs no dense strings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Bits of a block of a string that is laid out.
BLOCK = 1 << 16


def set_bits(bits: DataFrame, log: DataFrame) -> DataFrame:
    """SETBIT for a log (key, pos, seq, bit) of distinct seq: the last command of each bit decides."""
    last = log.groupBy("key", "pos").agg(F.max_by("bit", "seq").alias("bit"))
    both = bits.withColumn("was", F.lit(1)).join(last, ["key", "pos"], "full")
    return both.filter(F.coalesce("bit", "was") == 1).select("key", "pos")


def get_bits(bits: DataFrame, asked: DataFrame) -> DataFrame:
    hit = bits.select("key", "pos").distinct().withColumn("bit", F.lit(1))
    return asked.join(hit, ["key", "pos"], "left").select("key", "pos", F.coalesce("bit", F.lit(0)).alias("bit"))


def byte_size(bits: DataFrame) -> DataFrame:
    return bits.groupBy("key").agg((F.floor(F.max("pos") / 8) + 1).alias("bytes"))


def _bounds(size: Column, start: int, end: int) -> tuple[Column, Column]:
    """Ends counted from the back if negative, then at least 0; the later end at most the last unit."""
    a, b = (F.greatest(size + x, F.lit(0)) if x < 0 else F.lit(x) for x in (start, end))
    return a, F.least(b, size - 1)


def count(bits: DataFrame, start: int | None = None, end: int = -1, unit: str = "BYTE") -> DataFrame:
    """BITCOUNT of every key, over bytes or bits start to end."""
    if start is None:
        return bits.groupBy("key").agg(F.count_distinct("pos").alias("n"))
    per = 8 if unit == "BYTE" else 1
    sized = bits.distinct().join(byte_size(bits), "key").withColumn("units", F.col("bytes") * (8 // per))
    a, b = _bounds(F.col("units"), start, end)
    at = F.floor(F.col("pos") / per)
    return sized.groupBy("key").agg(F.count_if((at >= a) & (at <= b) & (F.lit(not (start < 0 and end < 0 and start > end)))).alias("n"))


def first_set(bits: DataFrame, start: int = 0) -> DataFrame:
    """BITPOS key 1 start (in bytes): -1 where there is none."""
    sized = bits.join(byte_size(bits), "key")
    a, _ = _bounds(F.col("bytes"), start, -1)
    return sized.groupBy("key").agg(F.coalesce(F.min(F.when(F.col("pos") >= a * 8, F.col("pos"))), F.lit(-1)).cast("long").alias("pos"))


def first_clear(bits: DataFrame) -> DataFrame:
    """BITPOS key 0 without an end: the first bit that is 0, right after the string if it is all ones."""
    w = Window.partitionBy("key").orderBy("pos")
    gaps = bits.distinct().withColumn("rank", F.row_number().over(w) - 1)
    run = F.max(F.when(F.col("pos") == F.col("rank"), F.col("pos") + 1))
    return gaps.groupBy("key").agg(F.coalesce(run, F.lit(0)).cast("long").alias("pos"))


def combine(bits: DataFrame, operation: str, keys: list[str]) -> DataFrame:
    """BITOP over ``keys`` as the set bits (pos) of the result: AND OR XOR DIFF DIFF1 ANDOR ONE, in one aggregation.

    With X the first key and Y the others: DIFF is X and no Y, DIFF1 any Y and not X, ANDOR X and any Y, ONE exactly one.
    """
    x, y = F.max((F.col("key") == keys[0]).cast("int")), F.sum((F.col("key") != keys[0]).cast("int"))
    per = bits.filter(F.col("key").isin(keys)).distinct().groupBy("pos").agg(x.alias("x"), y.alias("y"), F.count(F.lit(1)).alias("n"))
    rule = {"AND": F.col("n") == len(keys), "OR": F.col("n") > 0, "XOR": F.col("n") % 2 == 1, "ONE": F.col("n") == 1, "DIFF": (F.col("x") == 1) & (F.col("y") == 0), "DIFF1": (F.col("x") == 0) & (F.col("y") > 0), "ANDOR": (F.col("x") == 1) & (F.col("y") > 0)}
    return per.filter(rule[operation]).select("pos")


def invert(bits: DataFrame, key: str) -> DataFrame:
    """BITOP NOT: the clear bits of the key's bytes, laid out in blocks of BLOCK bits, so no array grows with the key."""
    own = bits.filter(F.col("key") == key)
    blocks = byte_size(own).select((F.col("bytes") * 8).alias("size"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("bytes") * 8 - 1) / BLOCK))).alias("block"))
    every = blocks.select("size", F.explode(F.sequence(F.col("block") * BLOCK, F.least((F.col("block") + 1) * BLOCK, F.col("size")) - 1)).alias("pos")).select("pos")
    return every.join(own.select("pos"), "pos", "left_anti")


def field(bits: DataFrame, offset: int, width: int, signed: bool = False) -> DataFrame:
    """BITFIELD GET of an integer of ``width`` bits at a bit offset, for every key that has bits."""
    shift = F.lit(offset + width - 1) - F.col("pos")
    inside = (F.col("pos") >= offset) & (F.col("pos") < offset + width)
    parts = [F.when(inside & (shift == k), F.lit(1 << k if k < 63 else -(1 << 63))) for k in range(min(width, 64))]
    one = reduce(lambda a, b: F.coalesce(a, b), parts)
    value = F.coalesce(F.sum(one), F.lit(0)).cast("long")
    out = bits.distinct().groupBy("key").agg(value.alias("value"))
    if signed and width < 64:
        out = out.withColumn("value", F.when(F.col("value") >= (1 << (width - 1)), F.col("value") - (1 << width)).otherwise(F.col("value")))
    return out


def field_add(value: Column, delta: int, width: int, signed: bool, overflow: str = "WRAP") -> Column:
    """BITFIELD INCRBY: the new value of a field of up to 62 bits under WRAP, SAT or FAIL (null)."""
    low, high = (-(1 << (width - 1)), (1 << (width - 1)) - 1) if signed else (0, (1 << width) - 1)
    new = value + F.lit(delta).cast("long")
    if overflow == "SAT":
        return F.least(F.greatest(new, F.lit(low).cast("long")), F.lit(high).cast("long"))
    if overflow == "FAIL":
        return F.when((new >= low) & (new <= high), new)
    return F.pmod(new - low, F.lit(1 << width).cast("long")) + low
