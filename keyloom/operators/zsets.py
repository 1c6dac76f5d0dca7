"""Sorted sets: rows (key, member, score); order within a key is (score, member bytes).

Every operator works on all keys of its input at once. Reads by rank need one window per key; reads by score or member
are filters, counts are aggregates with map-side combine.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.ranges import lex_between, position_between, score_between


def _order(rev: bool = False) -> list[Column]:
    return [F.col("score").desc(), F.col("member").desc()] if rev else [F.col("score").asc(), F.col("member").asc()]


def ranked(z: DataFrame, rev: bool = False) -> DataFrame:
    """rank from 0, and size of the key."""
    w = Window.partitionBy("key")
    return z.withColumn("rank", (F.row_number().over(w.orderBy(*_order(rev))) - 1).cast("long")).withColumn("size", F.count(F.lit(1)).over(w))


def rank(z: DataFrame, members: DataFrame, rev: bool = False) -> DataFrame:
    """Rank and score of the asked members (key, member); an absent one has no row."""
    return ranked(z, rev).join(members, ["key", "member"], "left_semi").select("key", "member", "rank", "score")


def range_by_rank(z: DataFrame, start: int, stop: int, rev: bool = False) -> DataFrame:
    r = ranked(z, rev)
    return r.filter(position_between(F.col("rank"), F.col("size"), start, stop)).select("key", "rank", "member", "score")


def _limited(rows: DataFrame, order: list[Column], offset: int, count: int | None) -> DataFrame:
    if count is None and not offset:
        return rows
    r = rows.withColumn("__at", F.row_number().over(Window.partitionBy("key").orderBy(*order)) - 1).filter(F.col("__at") >= offset)
    return (r if count is None or count < 0 else r.filter(F.col("__at") < offset + count)).drop("__at")


def range_by_score(z: DataFrame, low: str, high: str, rev: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    return _limited(z.filter(score_between(F.col("score"), low, high)), _order(rev), offset, count)


def range_by_lex(z: DataFrame, low: str, high: str, rev: bool = False, offset: int = 0, count: int | None = None) -> DataFrame:
    member = F.col("member").desc() if rev else F.col("member").asc()
    return _limited(z.filter(lex_between(F.col("member"), low, high)), [member], offset, count).select("key", "member")


def count_by_score(z: DataFrame, low: str, high: str) -> DataFrame:
    return z.groupBy("key").agg(F.count_if(score_between(F.col("score"), low, high)).alias("n"))


def count_by_lex(z: DataFrame, low: str, high: str) -> DataFrame:
    return z.groupBy("key").agg(F.count_if(lex_between(F.col("member"), low, high)).alias("n"))


def card(z: DataFrame) -> DataFrame:
    return z.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


def score(z: DataFrame, members: DataFrame) -> DataFrame:
    """One row per asked (key, member), with a null score where it is absent."""
    return members.join(z, ["key", "member"], "left").select("key", "member", "score")


def add(z: DataFrame, new: DataFrame, only_new: bool = False, only_old: bool = False, greater: bool = False, less: bool = False) -> DataFrame:
    """Upsert of distinct (key, member, score); NX, XX, then GT and LT, which never stop a missing member.

    A NaN score is refused where it would be written; a member that NX or XX passes over is not looked at. changed is 1
    for a member added or moved, added is 1 for one added.
    """
    if only_new and (only_old or greater or less) or greater and less:
        raise ValueError("NX, XX, GT and LT do not go together like this")
    both = z.join(new.select("key", "member", F.col("score").alias("new")), ["key", "member"], "full")
    passed = F.col("score").isNotNull() if only_new else F.col("score").isNull() if only_old else F.lit(False)
    refused = F.isnan("new") & ~passed
    both = both.withColumn("new", F.when(refused, F.raise_error(F.lit("score is not a number"))).otherwise(F.col("new")))
    old, fresh = F.col("score"), F.col("new")
    move = fresh.isNotNull() & ~F.lit(only_new)
    if greater:
        move = move & (fresh > old)
    if less:
        move = move & (fresh < old)
    out = both.filter(old.isNotNull()) if only_old else both
    value = F.when(old.isNull(), fresh).when(move, fresh).otherwise(old)
    return out.select("key", "member", value.alias("score"), F.when(old.isNull(), 1).otherwise(0).alias("added"), F.when(old.isNull() | (value != old), 1).otherwise(0).alias("changed"))


def increase(z: DataFrame, by: DataFrame) -> DataFrame:
    """Adds of many (key, member, delta) rows, pre-aggregated; a missing member starts at 0."""
    summed = by.groupBy("key", "member").agg(F.sum("delta").alias("delta"))
    return z.join(summed, ["key", "member"], "full").select("key", "member", (F.coalesce("score", F.lit(0.0)) + F.coalesce("delta", F.lit(0.0))).alias("score"))


def remove(z: DataFrame, members: DataFrame) -> DataFrame:
    return z.join(members, ["key", "member"], "left_anti")


def pop(z: DataFrame, n: int, highest: bool = False) -> tuple[DataFrame, DataFrame]:
    """The n lowest (or highest) members of each key, and what is left."""
    r = ranked(z, highest)
    return r.filter(F.col("rank") < n).drop("rank", "size"), r.filter(F.col("rank") >= n).drop("rank", "size")


def pop_first(z: DataFrame, keys: list[str], n: int, highest: bool = False) -> DataFrame:
    """Pop from the first of ``keys`` that has members."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    first = z.filter(F.col("key").isin(keys)).agg(F.min_by("key", place).alias("first"))
    return pop(z.join(F.broadcast(first), F.col("key") == F.col("first"), "left_semi"), n, highest)[0]


def remove_by_score(z: DataFrame, low: str, high: str) -> DataFrame:
    return z.filter(~score_between(F.col("score"), low, high))


def remove_by_rank(z: DataFrame, start: int, stop: int) -> DataFrame:
    r = ranked(z)
    return r.filter(~position_between(F.col("rank"), F.col("size"), start, stop)).drop("rank", "size")


def remove_by_lex(z: DataFrame, low: str, high: str) -> DataFrame:
    return z.filter(~lex_between(F.col("member"), low, high))


def sample(z: DataFrame, n: int, seed: str = "0") -> DataFrame:
    """n members of each key in the order of a hash: a random choice that reruns repeat."""
    w = Window.partitionBy("key").orderBy(F.md5(F.concat(F.lit(seed), F.col("member")).cast("binary")), "member")
    return z.withColumn("__at", F.row_number().over(w)).filter(F.col("__at") <= n).drop("__at")


def _weighted(z: DataFrame, keys: list[str], weights: list[float] | None) -> DataFrame:
    weights = weights or [1.0] * len(keys)
    if len(weights) != len(keys):
        raise ValueError("as many weights as keys")
    parts = [z.filter(F.col("key") == k).select("member", F.lit(i).alias("source"), F.nanvl(F.col("score") * F.lit(float(w)), F.lit(0.0)).alias("score")) for i, (k, w) in enumerate(zip(keys, weights, strict=True))]
    return reduce(DataFrame.unionAll, parts)


_AGGREGATE = {"SUM": F.sum, "MIN": F.min, "MAX": F.max}


def union(z: DataFrame, keys: list[str], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    """Members of any key: score times weight (NaN is 0), then SUM, MIN or MAX. A plain set has scores of 1."""
    return _weighted(z, keys, weights).groupBy("member").agg(F.nanvl(_AGGREGATE[aggregate]("score"), F.lit(0.0)).alias("score"))


def inter(z: DataFrame, keys: list[str], weights: list[float] | None = None, aggregate: str = "SUM") -> DataFrame:
    """Members of all keys."""
    both = _weighted(z, keys, weights).groupBy("member").agg(F.nanvl(_AGGREGATE[aggregate]("score"), F.lit(0.0)).alias("score"), F.count(F.lit(1)).alias("hits"))
    return both.filter(F.col("hits") == len(keys)).drop("hits")


def inter_card(z: DataFrame, keys: list[str], limit: int = 0) -> DataFrame:
    n = inter(z, keys).agg(F.count(F.lit(1)).alias("n"))
    return n.select(F.least("n", F.lit(limit)).alias("n")) if limit else n


def diff(z: DataFrame, keys: list[str]) -> DataFrame:
    """Members of the first key and of no other, with the first key's scores."""
    first = z.filter(F.col("key") == keys[0]).select("member", "score")
    return first.join(z.filter(F.col("key").isin(keys[1:])).select("member"), "member", "left_anti")


def store(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(F.lit(key).alias("key"), "member", "score")


def from_set(s: DataFrame) -> DataFrame:
    return s.select("key", "member", F.lit(1.0).alias("score"))
