"""Vector sets and exact nearest neighbours: rows (element, vector) with a unit vector and its norm."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of query vectors that are broadcast at a time.
QUERY_BYTES = 64 << 20
#: Rows whose scores are held against the best so far at a time.
CHUNK = 2048


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit_rows(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """VADD: unit vector and norm of each element; a zero vector stays zero."""
    n = rows.withColumn("norm", norm(F.col(vector)))
    return n.withColumn("unit", F.transform(vector, lambda x: F.when(F.col("norm") > 0, x.cast("double") / F.col("norm")).otherwise(0.0)))


def restored(rows: DataFrame) -> DataFrame:
    """VEMB: unit times norm."""
    return rows.withColumn("vector", F.transform("unit", lambda x: x * F.col("norm")))


def _queries(queries: DataFrame, vector: str) -> Iterator[tuple[list, np.ndarray]]:
    """All query vectors of a search, named, in blocks of at most QUERY_BYTES (one vector at least); one empty block if there are none."""
    names: list = []
    rows: list = []
    size = 0
    for name, v in queries.select("query", vector).toLocalIterator():
        width = 8 * len(v)
        if names and size + width > QUERY_BYTES:
            yield names, np.array(rows, np.float64)
            names, rows, size = [], [], 0
        names.append(name)
        rows.append(np.array(v, np.float64))
        size += width
    yield names, np.array(rows, np.float64)


def nearest(rows: DataFrame, queries: DataFrame, k: int, metric: str = "cosine", element: str = "element", vector: str = "embedding") -> DataFrame:
    """query, element, score: the k nearest elements of every query, exact.

    The queries go to every partition of the rows in blocks of QUERY_BYTES; the rows are read once per block. A partition
    multiplies its batches with all queries at once and keeps the k best so far of each, so what is shuffled is k rows
    per query and partition. metric: ``cosine`` gives (1 + cos) / 2, highest first; ``l2`` the squared distance and
    ``cos_dist`` 1 - cos, lowest first. Ties go to the smaller element.
    """
    low_first = metric != "cosine"
    out = None
    for block in _queries(queries, vector):
        found = _nearest_block(rows, block, k, metric, element, vector)
        out = found if out is None else out.unionAll(found)
    rounded = F.round("score", 12)
    w = Window.partitionBy("query").orderBy(rounded.asc() if low_first else rounded.desc(), "element")
    return out.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def _merged(scores: np.ndarray, keys: np.ndarray, more: np.ndarray, names: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k lowest of the scores so far and of the new ones, for all queries at once; ties to the smaller key."""
    both = np.concatenate([scores, more], 1)
    who = np.concatenate([keys, np.broadcast_to(names, more.shape)], 1)
    rounded = np.round(both, 12)
    if both.shape[1] > k:  # all that are as low as the k-th; ties beyond it are settled below
        limit = np.partition(rounded, k - 1, axis=1)[:, k - 1 : k]
        kept = [np.flatnonzero(r <= x) for r, x in zip(rounded, limit, strict=True)]
    else:
        kept = [np.arange(both.shape[1])] * len(both)
    order = [i[np.lexsort((w[i], r[i]))[:k]] for i, r, w in zip(kept, rounded, who, strict=True)]
    return np.stack([s[i] for s, i in zip(both, order, strict=True)]), np.stack([w[i] for w, i in zip(who, order, strict=True)])


def _nearest_block(rows: DataFrame, block: tuple[list, np.ndarray], k: int, metric: str, element: str, vector: str) -> DataFrame:
    """The k best of every partition for each query of a block."""
    sent = rows.sparkSession.sparkContext.broadcast(block)
    low_first = metric != "cosine"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        who, asked = sent.value
        if not len(who):
            return
        unit = asked / np.maximum(np.linalg.norm(asked, axis=1, keepdims=True), 1e-300)
        scores = np.full((len(who), 0), np.inf)  # the best so far of every query, best first
        keys = np.zeros((len(who), 0), object)
        for pdf in batches:
            if not len(pdf):
                continue
            x = np.stack(pdf[vector].to_numpy()).astype(np.float64)
            if metric == "l2":
                s = ((asked * asked).sum(1)[:, None] - 2 * asked @ x.T + (x * x).sum(1)).clip(min=0)
            else:
                c = unit @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)).T
                s = -(1 + c) / 2 if metric == "cosine" else 1 - c
            for at in range(0, len(pdf), CHUNK):
                scores, keys = _merged(scores, keys, s[:, at : at + CHUNK], pdf[element].to_numpy()[at : at + CHUNK], k)
        if keys.size:
            yield pd.DataFrame({"query": np.repeat(np.array(who, object), keys.shape[1]), "element": keys.ravel(), "score": scores.ravel() if low_first else -scores.ravel()})

    return rows.select(element, vector).mapInPandas(run, f"query string, element {rows.schema[element].dataType.simpleString()}, score double")


#: Bounds of fitting an inverted file: rows that its cells are fitted on, queries that its probes are tried on, cells at
#: most; and the recall that it is fitted for (with room above what is asked of it).
SAMPLE, TRIED, MOST_CELLS, RECALL, ROOM = 20_000, 200, 1024, 0.95, 0.02


class InvertedFile:
    """Approximate nearest neighbours: rows are in the cell of their nearest centroid, queries look into the ``probes`` nearest.

    Cells and probes are fitted on a bounded sample in hash order; every row is indexed. How many cells a query has to look
    into depends on the data (vectors without any grouping need most of them), so it is measured: the fewest that find
    RECALL + ROOM of the sample's own nearest neighbours.
    """

    def __init__(self, centroids: np.ndarray, probes: int):
        self.centroids, self.probes = centroids, probes

    @classmethod
    def fit(cls, rows: DataFrame, k: int = 10, vector: str = "embedding", rounds: int = 8, seed: int = 1) -> InvertedFile:
        some = rows.select(vector).orderBy(F.xxhash64(F.col(vector).cast("string"))).limit(SAMPLE).collect()
        x = np.array([r[0] for r in some], np.float64)
        rng = np.random.default_rng(seed)
        c = x[rng.choice(len(x), min(MOST_CELLS, max(1, int(np.sqrt(len(x)))), len(x)), replace=False)] if len(x) else np.zeros((1, 1))
        for _ in range(rounds if len(x) else 0):
            at = cls._nearest_cells(x, c, 1)[:, 0]
            for j in range(len(c)):
                if (at == j).any():
                    c[j] = x[at == j].mean(0)
        return cls(c, cls._probes(x, c, k, rng))

    @staticmethod
    def _nearest_cells(x: np.ndarray, c: np.ndarray, n: int) -> np.ndarray:
        out = np.empty((len(x), n), np.int64)
        for i in range(0, len(x), 4096):
            out[i : i + 4096] = ((c * c).sum(1) - 2 * x[i : i + 4096] @ c.T).argsort(1, kind="stable")[:, :n]
        return out

    @classmethod
    def _probes(cls, x: np.ndarray, c: np.ndarray, k: int, rng: np.random.Generator) -> int:
        if len(x) < 2 or len(c) < 2:
            return len(c)
        asked = rng.choice(len(x), min(TRIED, len(x)), replace=False)
        near = ((x * x).sum(1) - 2 * x[asked] @ x.T).argsort(1, kind="stable")[:, : min(k, len(x))]
        order = cls._nearest_cells(x[asked], c, len(c))
        place = np.empty_like(order)
        np.put_along_axis(place, order, np.arange(len(c))[None, :].repeat(len(asked), 0), 1)
        depth = np.sort(np.take_along_axis(place, cls._nearest_cells(x, c, 1)[near, 0], 1).ravel())  # how far each neighbour's cell is down the list
        return int(depth[min(len(depth) - 1, int(np.ceil(len(depth) * min(1.0, RECALL + ROOM))))]) + 1

    def cells(self, rows: DataFrame, probes: int = 1, vector: str = "embedding") -> DataFrame:
        """cells: the nearest cells of every row."""
        sent = rows.sparkSession.sparkContext.broadcast(self.centroids)

        @F.pandas_udf("array<int>")
        def near(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for v in parts:
                x = np.stack(v.to_numpy()).astype(np.float64) if len(v) else np.zeros((0, sent.value.shape[1]))
                yield pd.Series(list(InvertedFile._nearest_cells(x, sent.value, probes).astype(np.int32)))

        return rows.withColumn("cells", near(vector))

    def search(self, rows: DataFrame, queries: DataFrame, k: int, element: str = "element", vector: str = "embedding") -> DataFrame:
        """query, element, score (squared distance), rank: the k nearest of the rows in the cells that each query looks into.

        Rows and queries meet in an equi-join on the cell; distances are exact, by column arithmetic.
        """
        index = self.cells(rows.select(element, vector)).select(element, vector, F.get("cells", F.lit(0)).alias("cell"))
        asked = self.cells(queries.select("query", vector), self.probes).select("query", F.col(vector).alias("q"), F.explode("cells").alias("cell"))
        d = F.aggregate(F.zip_with(vector, "q", lambda x, y: (x.cast("double") - y) * (x.cast("double") - y)), F.lit(0.0), lambda a, x: a + x)
        w = Window.partitionBy("query").orderBy(F.round("score", 12), "element")
        near = index.join(asked, "cell").select("query", F.col(element).alias("element"), d.alias("score"))
        return near.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < k)


def quantise_int8(v: str) -> Column:
    """Scalar quantisation over mean +- 8 standard deviations: clamp((x - low) / range * 254) - 127, one array per row."""
    mean = f"aggregate({v}, 0D, (a, x) -> a + x, a -> a / size({v}))"
    body = f"transform({v}, x -> CAST(CASE WHEN d > 0 THEN greatest(-127D, least(127D, round((x - (m - 8 * d)) / (16 * d) * 254 - 127))) ELSE 0 END AS TINYINT))"
    deviation = f"sqrt(aggregate({v}, 0D, (a, x) -> a + (x - m) * (x - m), a -> a / size({v})))"
    return F.expr(f"transform(array({mean}), m -> transform(array({deviation}), d -> {body})[0])[0]")
