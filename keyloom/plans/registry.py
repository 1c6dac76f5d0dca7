"""The registry of queries, and the keyed views that they read."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Keyed views: (table, select list) parts, united. The same text serves Spark and the SQL oracle.
VIEWS: dict[str, list[tuple[str, str]]] = {
    "kv_string": [("customer", "concat('cust:', c_custkey) AS key, c_name AS value, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE (c_custkey % 7) * 1000000 + c_custkey * 500 END AS expire_ms")],
    "kv_hash": [
        ("customer", "concat('cust:', c_custkey) AS key, 'name' AS field, c_name AS value, CASE WHEN c_custkey % 5 = 0 THEN 2000000 + c_custkey * 1000 ELSE NULL END AS field_expire_ms"),
        ("customer", "concat('cust:', c_custkey) AS key, 'segment' AS field, c_mktsegment AS value, NULL AS field_expire_ms"),
        ("customer", "concat('cust:', c_custkey) AS key, 'nation' AS field, concat('', c_nationkey) AS value, CASE WHEN c_custkey % 4 = 0 THEN 4000000 - c_custkey * 1000 ELSE NULL END AS field_expire_ms"),
    ],
    "kv_list": [("conversations", "concat('conv:', conv_id) AS key, turn AS pos, text AS value")],
    "kv_set": [("orders", "DISTINCT o_orderpriority AS key, concat('c', o_custkey) AS member")],
    "kv_zset": [("customer", "c_mktsegment AS key, concat('c', c_custkey) AS member, c_acctbal AS score")],
    "kv_bits": [("events", "DISTINCT event_type AS key, user_id * 16 + event_id % 16 AS pos")],
    "kv_geo": [("customer", "c_mktsegment AS key, concat('c', c_custkey) AS member, (c_custkey * 37) % 360 - 180.0 AS lon, (c_custkey * 17) % 170 - 85.0 AS lat")],
    "vset": [("embeddings", "concat('v', vec_id) AS element, vec_id, embedding, label")],
    "docs": [("documents", "doc_id, text, lang")],
}
#: The moment that reads with a lifetime take as now, in milliseconds.
NOW_MS = 3_000_000

#: Views of the rows of others that have not expired: view, condition.
LIVE_VIEWS = {"kv_live": ("kv_string", f"expire_ms IS NULL OR expire_ms > {NOW_MS}")}

#: The whole query set of a search: every row whose id is divisible by 20.
EVERY = "vec_id % 20 = 0"

Query = Callable[["Tables"], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables as attributes, the keyed views by name."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name in VIEWS:
            return self.view(name)
        if name in LIVE_VIEWS:
            return self.view(LIVE_VIEWS[name][0]).filter(LIVE_VIEWS[name][1])
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def view(self, name: str) -> DataFrame:
        parts = [self.spark.sql(f"SELECT {what} FROM {{source}}", source=getattr(self, table)) for table, what in VIEWS[name]]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionAll(p)
        return out


def with_views(sql: str) -> str:
    """``sql`` after the definitions of the keyed views that it names."""
    live = {n: of for n, of in LIVE_VIEWS.items() if n in sql}
    needed = {of for of, _ in live.values()}
    used = [f"{n} AS ({' UNION ALL '.join(f'SELECT {what} FROM {table}' for table, what in parts)})" for n, parts in VIEWS.items() if n in sql or n in needed]
    used += [f"{n} AS (SELECT * FROM {of} WHERE {condition})" for n, (of, condition) in live.items()]
    if not used:
        return sql
    body = sql.strip()
    return f"WITH {', '.join(used)}{', ' + body[5:] if body.startswith('WITH ') else ' ' + body}"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under ``name``, with SQL that gives the same rows where there is any."""

    def add(f: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return add


def search(name: str, sql: str, few: str, every: str = EVERY) -> Callable[[Callable[["Tables", str], DataFrame]], Callable]:
    """Register a search over the few rows that its SQL asks for, and as ``<name>_every20`` over its whole query set.

    The function takes the condition of the rows asked for; the second SQL is the first with that condition replaced.
    """

    def add(f: Callable[["Tables", str], DataFrame]) -> Callable:
        whole, n = re.subn(re.escape(few) + r"(?!\d)", lambda _: every, sql)
        if not n:
            raise ValueError(f"the SQL of {name} does not ask for {few}")
        query(name, sql)(lambda t: f(t, few))
        query(f"{name}_every20", whole)(lambda t: f(t, every))
        return f

    return add


def bound() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, f in QUERIES.items()}
