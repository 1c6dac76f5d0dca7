"""The keyspace: existence, patterns, lifetimes, renames and sorting, over rows that have a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.functions.ranges import matches


def delete(rows: DataFrame, keys: DataFrame) -> DataFrame:
    return rows.join(keys, "key", "left_anti")


def count_existing(rows: DataFrame, keys: DataFrame) -> DataFrame:
    """How many of the asked keys exist, an asked key as often as it is asked."""
    return keys.join(rows.select("key").distinct(), "key", "left_semi").agg(F.count(F.lit(1)).alias("n"))


def matching(rows: DataFrame, pattern: str) -> DataFrame:
    return rows.filter(matches(F.col("key"), pattern)).select("key").distinct()


def rename(rows: DataFrame, old: str, new: str, only_if_free: bool = False) -> DataFrame:
    """Value and lifetime move; what ``new`` held goes, unless ``only_if_free`` keeps everything as it was."""
    moved = rows.filter((F.col("key") != new) | F.lit(only_if_free)).withColumn("key", F.when(F.col("key") == old, F.lit(new)).otherwise(F.col("key")))
    if not only_if_free:
        return moved
    taken = rows.filter(F.col("key") == new).agg((F.count(F.lit(1)) > 0).alias("taken")).scalar()
    return rows.withColumn("key", F.when(~taken & (F.col("key") == old), F.lit(new)).otherwise(F.col("key")))


def copy(rows: DataFrame, source: str, target: str) -> DataFrame:
    """COPY ... REPLACE."""
    return rows.filter(F.col("key") != target).unionAll(rows.filter(F.col("key") == source).withColumn("key", F.lit(target)).select(*rows.columns))


def set_deadline(old: Column, new: Column, condition: str | None = None) -> Column:
    """The deadline after EXPIRE with NX, XX, GT or LT. No deadline counts as later than any: GT fails on it, LT succeeds."""
    if condition is None:
        return new
    ok = {"NX": old.isNull(), "XX": old.isNotNull(), "GT": old.isNotNull() & (new > old), "LT": old.isNull() | (new < old)}[condition]
    return F.when(ok, new).otherwise(old)


def seconds_left(deadline: Column, now_ms: int) -> Column:
    """Rounded to the nearest second, -1 without a deadline."""
    return F.when(deadline.isNull(), F.lit(-1)).otherwise(F.floor((deadline - now_ms + 500) / 1000)).cast("long")


def millis_left(deadline: Column, now_ms: int) -> Column:
    return F.when(deadline.isNull(), F.lit(-1)).otherwise(deadline - now_ms).cast("long")


def sort(values: DataFrame, alpha: bool = False, descending: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    """SORT of the rows (value): as numbers, ties by bytes, or ALPHA by bytes; a value that is no number raises."""
    key = F.col("value") if alpha else F.col("value").cast("double")
    order = [key.desc(), F.col("value").desc()] if descending else [key.asc(), F.col("value").asc()]
    out = values.orderBy(*order)
    if offset:
        out = out.offset(offset)
    return out if count is None else out.limit(count)


def evict(rows: DataFrame, keep: int, policy: str) -> DataFrame:
    """The keys that stay under a limit of ``keep``: by last access (lru), access count (lfu), deadline (ttl) or hash.

    Exact, not sampled; policies named volatile-* only ever evict keys with a deadline. Nothing is sorted as a whole: a
    quantile puts nearly all rows on one side or the other, and only rows about the limit are put in order.
    """
    scope, _, kind = policy.partition("-")
    hashed = F.conv(F.substring(F.md5(F.col("key").cast("binary")), 1, 12), 16, 10).cast("long")
    worth = {"lru": F.col("accessed"), "lfu": F.col("hits"), "ttl": F.coalesce("expire_ms", F.lit((1 << 62))), "random": -hashed}[kind].cast("long")
    tie = F.md5(F.col("key").cast("binary")) if kind == "random" else F.col("key")
    if scope == "volatile":
        safe, other = rows.filter("expire_ms IS NULL"), rows.filter("expire_ms IS NOT NULL")
        n = safe.count()
        return _best(safe, keep, worth, tie) if n >= keep else safe.unionAll(_best(other, keep - n, worth, tie))
    return _best(rows, keep, worth, tie)


def _best(rows: DataFrame, keep: int, worth: Column, tie: Column) -> DataFrame:
    """The ``keep`` rows of the largest worth, ties by ``tie``."""
    n = rows.count()
    if keep >= n:
        return rows
    share = 1 - keep / n
    near = [max(0.0, share - 0.001), min(1.0, share + 0.001)]
    low, high = rows.agg(F.percentile_approx(worth, near, 10_000)).first()[0]
    sure = rows.filter(worth > high)
    return sure.unionAll(rows.filter((worth >= low) & (worth <= high)).orderBy(worth.desc(), tie).limit(keep - sure.count()))
