"""Sets: distinct rows (key, member)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def add(s: DataFrame, new: DataFrame) -> DataFrame:
    return s.select("key", "member").union(new.select("key", "member")).distinct()


def remove(s: DataFrame, gone: DataFrame) -> DataFrame:
    return s.join(gone, ["key", "member"], "left_anti")


def card(s: DataFrame) -> DataFrame:
    return s.groupBy("key").agg(F.count_distinct("member").alias("n"))


def contains(s: DataFrame, members: DataFrame) -> DataFrame:
    """1 or 0 for each asked (key, member)."""
    found = s.select("key", "member").distinct().withColumn("found", F.lit(1))
    return members.join(found, ["key", "member"], "left").select("key", "member", F.coalesce("found", F.lit(0)).alias("found"))


def sample(s: DataFrame, n: int, repeat: bool = False) -> DataFrame:
    """n members of each key in the order of a hash; with ``repeat`` exactly n rows, going round and round."""
    w = Window.partitionBy("key").orderBy(F.md5(F.col("member").cast("binary")), "member")
    r = s.withColumn("at", F.row_number().over(w) - 1)
    if not repeat:
        return r.filter(F.col("at") < n).drop("at")
    sized = r.withColumn("size", F.count(F.lit(1)).over(Window.partitionBy("key"))).filter(F.col("at") < n)
    turns = F.floor((F.lit(n) - F.col("at") - 1) / F.col("size")) + 1
    return sized.select("key", "member", F.explode(F.sequence(F.lit(1), turns.cast("int"))).alias("turn"))


def pop(s: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Members taken from each key (see ``sample``), and what is left."""
    taken = sample(s, n)
    return taken, s.join(taken, ["key", "member"], "left_anti")


def move(s: DataFrame, source: str, target: str, member: str) -> DataFrame:
    """The sets after the move; nothing changes if ``source`` lacks the member."""
    hit = (F.col("key") == source) & (F.col("member") == member)
    return s.withColumn("key", F.when(hit, F.lit(target)).otherwise(F.col("key"))).distinct()


def inter(s: DataFrame, keys: list[str]) -> DataFrame:
    """One aggregation whatever the number of keys: members found under each of them."""
    of = s.filter(F.col("key").isin(keys)).groupBy("member").agg(F.count_distinct("key").alias("n"))
    return of.filter(F.col("n") == len(set(keys))).select("member")


def inter_card(s: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    n = inter(s, keys).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(limit)).alias("n")) if limit else n


def union(s: DataFrame, keys: list[str]) -> DataFrame:
    return s.filter(F.col("key").isin(keys)).select("member").distinct()


def diff(s: DataFrame, keys: list[str]) -> DataFrame:
    first = F.max((F.col("key") == keys[0]).cast("int"))
    other = F.max((F.col("key") != keys[0]).cast("int"))
    return s.filter(F.col("key").isin(keys)).groupBy("member").agg(first.alias("a"), other.alias("b")).filter("a = 1 AND b = 0").select("member")


def store(members: DataFrame, key: str) -> DataFrame:
    return members.select(F.lit(key).alias("key"), "member")


def scan(rows: DataFrame, by: str, after: int | None, count: int, pattern: str | None = None) -> DataFrame:
    """A cursor page: the next ``count`` rows in the order of a hash of ``by``, after the cursor; filtered after paging.

    The cursor of the next page is the largest ``cursor`` of this one.
    """
    from keyloom.functions.ranges import matches

    r = rows.withColumn("cursor", F.conv(F.substring(F.md5(F.col(by).cast("binary")), 1, 12), 16, 10).cast("long"))
    if after is not None:
        r = r.filter(F.col("cursor") > after)
    page = r.orderBy("cursor", by).limit(count)
    return page.filter(matches(F.col(by), pattern)) if pattern else page
