"""Lists: rows (key, pos, value), pos giving the order; positions in results count from 0.

Reads and most updates are windows over a key. A log of pushes needs none: a push to the right sorts after everything
before it, a push to the left before. Only logs that pop are folded in order, key by key.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.ranges import position_between


def indexed(rows: DataFrame) -> DataFrame:
    """at (from 0) and size of every element."""
    w = Window.partitionBy("key")
    return rows.withColumn("idx", (F.row_number().over(w.orderBy("pos")) - 1).cast("long")).withColumn("size", F.count(F.lit(1)).over(w))


def slice_(rows: DataFrame, start: int, stop: int) -> DataFrame:
    """LRANGE, and what LTRIM keeps."""
    return indexed(rows).filter(position_between(F.col("idx"), F.col("size"), start, stop)).select("key", "idx", "value")


def element(rows: DataFrame, index: int) -> DataFrame:
    at = F.col("size") + index if index < 0 else F.lit(index)
    return indexed(rows).filter(F.col("idx") == at).select("key", "value")


def replace_at(rows: DataFrame, index: int, value: str) -> DataFrame:
    """LSET; a key whose list is too short keeps its elements, with a null ``ok``."""
    i = indexed(rows)
    at = F.col("size") + index if index < 0 else F.lit(index)
    inside = (at >= 0) & (at < F.col("size"))
    return i.select("key", "idx", F.when(F.col("idx") == at, F.lit(value)).otherwise(F.col("value")).alias("value"), F.when(inside, F.lit(True)).alias("ok"))


def insert(rows: DataFrame, pivot: str, value: str, after: bool = False) -> DataFrame:
    """LINSERT before or after the first pivot of each key; a list without it stays as it is."""
    i = indexed(rows)
    first = F.min(F.when(F.col("value") == pivot, F.col("idx"))).over(Window.partitionBy("key"))
    i = i.withColumn("first", first)
    new = i.filter(F.col("idx") == F.col("first")).select("key", (F.col("idx") + (0.5 if after else -0.5)).alias("pos"), F.lit(value).alias("value"))
    return indexed(i.select("key", F.col("idx").cast("double").alias("pos"), "value").unionAll(new)).select("key", "idx", "value")


def remove(rows: DataFrame, count: int, value: str) -> DataFrame:
    """LREM: the first ``count`` matches go, the last ones if it is negative, all if it is 0."""
    i = indexed(rows)
    order = F.col("idx").desc() if count < 0 else F.col("idx").asc()
    nth = F.row_number().over(Window.partitionBy("key", "value").orderBy(order))
    gone = (F.col("value") == value) & ((nth <= abs(count)) if count else F.lit(True))
    return indexed(i.withColumn("gone", gone).filter("NOT gone").select("key", F.col("idx").alias("pos"), "value")).select("key", "idx", "value")


def positions(rows: DataFrame, value: str, rank: int = 1, count: int = 1, maxlen: int = 0) -> DataFrame:
    """LPOS: places of matches from the ``rank``-th on (from the end if negative) among the first (last) ``maxlen``; count 0 is all."""
    i = indexed(rows)
    if maxlen:
        i = i.filter((F.col("idx") < maxlen) if rank > 0 else (F.col("idx") >= F.col("size") - maxlen))
    order = F.col("idx").asc() if rank > 0 else F.col("idx").desc()
    m = i.filter(F.col("value") == value).withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy(order)))
    m = m.filter(F.col("nth") >= abs(rank))
    if count:
        m = m.filter(F.col("nth") < abs(rank) + count)
    return m.select("key", "idx")


def pushes(log: DataFrame) -> DataFrame:
    """Lists made by a log (key, seq, side, value) of pushes, side L or R, without any ordered fold."""
    return log.select("key", F.when(F.col("side") == "L", -F.col("seq")).otherwise(F.col("seq")).alias("pos"), "value")


def pop(rows: DataFrame, n: int, right: bool = False) -> tuple[DataFrame, DataFrame]:
    """The n elements popped off each key, in popping order, and the rest."""
    i = indexed(rows)
    turn = F.col("size") - F.col("idx") - 1 if right else F.col("idx")
    i = i.withColumn("turn", turn)
    return i.filter(F.col("turn") < n).select("key", "turn", "value"), i.filter(F.col("turn") >= n).select("key", "pos", "value")


def pop_first(rows: DataFrame, keys: list[str], n: int, right: bool = False) -> DataFrame:
    """LMPOP: from the first of ``keys`` that has elements."""
    place = F.array_position(F.array(*[F.lit(k) for k in keys]), F.col("key"))
    first = rows.filter(F.col("key").isin(keys)).agg(F.min_by("key", place).alias("first"))
    return pop(rows.join(F.broadcast(first), F.col("key") == F.col("first"), "left_semi"), n, right)[0]


def move(rows: DataFrame, source: str, target: str, from_right: bool, to_right: bool) -> DataFrame:
    """LMOVE: the lists after one element has moved."""
    i = indexed(rows).withColumn("place", F.col("idx").cast("double"))
    last = F.when(F.col("key") == source, F.col("size") - 1 if from_right else F.lit(0))
    hit = (F.col("key") == source) & (F.col("idx") == last)
    place = F.when(hit, F.lit(1e18 if to_right else -1e18)).otherwise(F.col("place"))
    moved = i.select(F.when(hit, F.lit(target)).otherwise(F.col("key")).alias("key"), place.alias("pos"), "value")
    return indexed(moved).select("key", "idx", "value")


def fold(log: DataFrame) -> DataFrame:
    """Lists after a log (key, seq, op, value) of lpush, rpush, lpop, rpop and del, folded in order key by key.

    For logs whose commands depend on the state before them. A key's log is one group; logs of pushes alone use
    ``pushes``, which has no such group.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        from collections import deque

        out: deque = deque()
        for op, value in pdf.sort_values("seq")[["op", "value"]].itertuples(index=False):
            if op == "lpush":
                out.appendleft(value)
            elif op == "rpush":
                out.append(value)
            elif op == "del":
                out.clear()
            elif out:
                out.popleft() if op == "lpop" else out.pop()
        return pd.DataFrame({"key": pdf["key"].iloc[0], "idx": range(len(out)), "value": list(out)}).astype({"key": object, "value": object})

    return log.groupBy("key").applyInPandas(run, "key string, idx long, value string")
