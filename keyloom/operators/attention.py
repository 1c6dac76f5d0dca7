"""Attention reads over stored keys and values, block selection, caches and buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.operators.vectors import _queries


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def partials(rows: DataFrame, queries: DataFrame, scale: float | None = None, key: str = "k", value: str = "v") -> DataFrame:
    """Per query and partition: the largest score m, the sum s of exp(score - m), and the weighted value sums acc.

    This is the online softmax: partitions are read once per block of queries, and one row per query leaves each of them.
    """
    out = None
    for block in _queries(queries, "q"):
        part = _partials_block(rows, block, scale, key, value)
        out = part if out is None else out.unionAll(part)
    return out


def _partials_block(rows: DataFrame, block: tuple[list, np.ndarray], scale: float | None, key: str, value: str) -> DataFrame:
    """The partials of one block of queries."""
    sent = rows.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, asked = sent.value
        m = np.full(len(who), -np.inf)
        s, acc = np.zeros(len(who)), None
        for pdf in batches:
            if not len(pdf) or not len(who):
                continue
            k, v = (np.stack(pdf[c].to_numpy()).astype(np.float64) for c in (key, value))
            z = asked @ k.T * (1 / np.sqrt(k.shape[1]) if scale is None else scale)
            new = np.maximum(m, z.max(1))
            w = np.exp(z - new[:, None])
            old = np.where(np.isinf(m), 0, np.exp(m - new))
            s = s * old + w.sum(1)
            acc = w @ v if acc is None else acc * old[:, None] + w @ v
            m = new
        if acc is not None:
            yield pd.DataFrame({"query": who, "m": m, "s": s, "acc": list(acc)}).astype({"query": object})

    return rows.select(key, value).mapInPandas(run, "query string, m double, s double, acc array<double>")


def merge(parts: DataFrame) -> DataFrame:
    """query, out (attention output), lse (log of the sum of exponentials) from partial rows, however many there are."""
    top = F.max("m").over(Window.partitionBy("query"))
    scaled = parts.withColumn("f", F.exp(F.col("m") - top)).withColumn("top", top)
    sums = scaled.groupBy("query").agg(F.sum(F.col("s") * F.col("f")).alias("s"), F.max("top").alias("top"))
    dims = scaled.select("query", "f", F.posexplode("acc").alias("dim", "a")).groupBy("query", "dim").agg(F.sum(F.col("a") * F.col("f")).alias("a"))
    wide = dims.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("dim", "a"))).alias("d"))
    return wide.join(sums, "query").select("query", F.transform("d", lambda x: x["a"] / F.col("s")).alias("out"), (F.log("s") + F.col("top")).alias("lse"))


def attend(rows: DataFrame, queries: DataFrame, scale: float | None = None) -> DataFrame:
    """softmax(q k / sqrt(d)) v over rows (k, v) for every query (query, q)."""
    return merge(partials(rows, queries, scale))


def attend_fused(prefix: DataFrame, suffix: DataFrame, queries: DataFrame, scale: float | None = None) -> DataFrame:
    """Attention over a stored prefix and a suffix, merged as if they were one."""
    return merge(partials(prefix, queries, scale).unionAll(partials(suffix, queries, scale)))


def select_blocks(rows: DataFrame, query: list[float], block: int, top_k: int, selector: int = 0) -> DataFrame:
    """The best blocks of ``block`` tokens for one query: by query . mean(keys), or by the upper bound of query . key."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dims = rows.select(F.floor(F.col("token") / block).alias("block"), F.posexplode("k").alias("dim", "x"))
    per = dims.groupBy("block", "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"), F.min("x").cast("double").alias("low"), F.max("x").cast("double").alias("high"))
    w = F.get(q, F.col("dim"))
    part = w * F.col("mean") if selector == 0 else F.greatest(w * F.col("low"), w * F.col("high"))
    scores = per.groupBy("block").agg(F.sum(part).alias("score"))
    return scores.orderBy(F.round("score", 9).desc(), "block").limit(top_k).select("block", "score")


def nearest_cached(entries: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """query, element, score: for each query its most similar entry, if at or above the threshold (cosine)."""
    from keyloom.operators.vectors import nearest

    return nearest(entries, queries, 1, "cos_dist").select("query", "element", (1 - F.col("score")).alias("score")).filter(F.round("score", 9) >= threshold)


#: Entries of a semantic cache at most. Fixed value.
CACHED = 10_000


def cache_set(log: DataFrame, most: int = CACHED) -> DataFrame:
    """AI.SEMANTIC_CACHE SET of rows (query, seq, embedding, response): the last response of each query, the newest ``most``."""
    rest = [c for c in log.columns if c != "query"]
    last = log.groupBy("query").agg(F.max_by(F.struct(*rest), "seq").alias("l")).select("query", "l.*")
    return last.orderBy(F.col("seq").desc(), "query").limit(most).drop("seq")


def explained(entries: DataFrame, queries: DataFrame, threshold: float) -> DataFrame:
    """AI.SEMANTIC_CACHE EXPLAIN: the most similar entry of every query, its similarity, and whether it would be a hit."""
    from keyloom.operators.vectors import nearest

    found = nearest(entries, queries, 1, "cos_dist").select("query", "element", (1 - F.col("score")).alias("score"))
    return found.withColumn("hit", F.round("score", 9) >= threshold)


def recall(memories: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """AI.MEMORY RECALL: query, element, score: the k most similar memories of the query's own session.

    ``memories`` (session, element, embedding) and ``queries`` (session, query, embedding) meet in an equi-join on the
    session; similarities are column arithmetic, and the best k per query are kept by one window.
    """
    norm = lambda v: F.sqrt(dot(F.col(v), F.col(v)))
    asked = queries.select("session", "query", F.col("embedding").alias("q"), norm("embedding").alias("nq"))
    both = memories.withColumn("n", norm("embedding")).join(asked, "session")
    score = F.when((F.col("n") > 0) & (F.col("nq") > 0), dot(F.col("embedding"), F.col("q")) / (F.col("n") * F.col("nq"))).otherwise(0.0)
    w = Window.partitionBy("query").orderBy(F.round("score", 12).desc(), "element")
    return both.select("query", "element", score.alias("score")).withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def remember(log: DataFrame) -> DataFrame:
    """AI.MEMORY ADD of rows (session, seq, role, text): each session's memories numbered in order."""
    return log.withColumn("pos", F.row_number().over(Window.partitionBy("session").orderBy("seq")) - 1).drop("seq")


def ring_write(size: int, writes: DataFrame) -> DataFrame:
    """A ring buffer of ``size`` bytes per key after ordered writes (key, seq, offset, data): the last write of each byte wins.

    A write longer than the buffer laps itself; bytes never written are 0.
    """
    b = writes.select("key", "seq", "offset", F.posexplode(F.split(F.hex("data"), "(?<=\\G..)")).alias("i", "byte")).filter("byte <> ''")
    last = b.groupBy("key", ((F.col("offset") + F.col("i")) % size).alias("at")).agg(F.max_by("byte", F.struct("seq", "i")).alias("byte"))
    known = last.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("at", "byte"))).alias("m"))
    every = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at("m", i.cast("bigint")), F.lit("00")))
    return known.select("key", F.unhex(F.array_join(every, "")).alias("data"))
