"""HyperLogLog as register rows (key, reg, rank), 2**14 registers, built and merged with map-side aggregation.

The hash is xxhash64, so registers are those of this library; the estimate follows the usual formula: linear counting
for small sets, otherwise alpha m^2 / sum(2^-rank), cut to a whole number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 14
REGISTERS = 1 << BITS
ALPHA = 0.7213 / (1 + 1.079 / REGISTERS)


def add(elements: DataFrame) -> DataFrame:
    """Registers of rows (key, element); an empty element adds nothing. The rank is that of the upper 50 hash bits."""
    h = F.xxhash64("element")
    high = F.shiftrightunsigned(F.col("h"), BITS)
    rank = F.when(high == 0, 64 - BITS + 1).otherwise(64 - BITS - F.length(F.bin(high)) + 1)
    hashed = elements.filter(F.length(F.col("element").cast("string")) > 0).select("key", h.alias("h"))
    return hashed.select("key", F.col("h").bitwiseAND(REGISTERS - 1).cast("int").alias("reg"), rank.cast("int").alias("rank")).groupBy("key", "reg").agg(F.max("rank").alias("rank"))


def merge(registers: DataFrame, keys: list[str], target: str) -> DataFrame:
    return registers.filter(F.col("key").isin(keys)).groupBy("reg").agg(F.max("rank").alias("rank")).select(F.lit(target).alias("key"), "reg", "rank")


def estimate(registers: DataFrame) -> DataFrame:
    own = registers.groupBy("key").agg(F.count(F.lit(1)).alias("used"), F.sum(F.pow(F.lit(2.0), -F.col("rank"))).alias("s"))
    zeros = REGISTERS - F.col("used")
    raw = F.lit(ALPHA * REGISTERS * REGISTERS) / (F.col("s") + zeros)
    linear = F.lit(float(REGISTERS)) * F.log(F.lit(float(REGISTERS)) / zeros)
    return own.select("key", F.when((raw <= 2.5 * REGISTERS) & (zeros > 0), linear).otherwise(raw).cast("long").alias("n"))
