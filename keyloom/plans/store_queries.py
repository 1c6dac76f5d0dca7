"""Queries over session stores, registries and the catalog."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from keyloom.operators import stores as S
from keyloom.operators import streams
from keyloom.plans.registry import NOW_MS, query

@query("kv_prefix_blocks", "SELECT o_orderkey // 64 AS block, count(*) AS hashes FROM orders GROUP BY 1")
def kv_prefix_blocks(t):
    return t.orders.groupBy(F.floor(F.col("o_orderkey") / 64).alias("block")).agg(F.count(F.lit(1)).alias("hashes"))


@query("v_commit", "SELECT label AS layer, max(vec_id) AS last FROM vset GROUP BY label HAVING label <> 3")
def v_commit(t):
    """Snapshots, without the one that has been released."""
    snaps = t.vset.groupBy(F.col("label").alias("layer")).agg(F.max("vec_id").alias("last"))
    return snaps.filter("layer <> 3")


@query("v_export", "SELECT concat('s.layer', label, '.part', vec_id // 4096) AS name, count(*) AS tokens FROM vset GROUP BY 1")
def v_export(t):
    rows = t.vset.select(F.col("label").alias("layer"), F.col("vec_id").alias("token"), F.col("embedding").alias("v"))
    return S.export(rows, "s", 64).select("name", "tokens")


#: In SQL, each number over its block's scale; whole numbers for 8 to 2 bits, 3 bits of fraction for fp8.
_PARTS = "x AS (SELECT vec_id, unnest(range(64)) // 32 AS b, unnest(embedding)::DOUBLE AS x FROM vset), s AS (SELECT *, max(abs(x)) OVER (PARTITION BY vec_id, b) AS top FROM x)"
_WHOLE = "greatest(-{0}, least({0}, round_even(x / (top / {0}), 0))) * (top / {0})"
_FP8 = "round_even(x / (top / 448) / exp2(greatest(floor(log2(greatest(abs(x / (top / 448)), 1e-30))), -6) - 3), 0) * exp2(greatest(floor(log2(greatest(abs(x / (top / 448)), 1e-30))), -6) - 3) * (top / 448)"

for _bits, _sql in ((8, _WHOLE.format("127.0::DOUBLE")), (4, _WHOLE.format("7.0::DOUBLE")), (3, _WHOLE.format("3.0::DOUBLE")), (2, _WHOLE.format("1.0::DOUBLE")), ("fp8", _FP8.replace("exp2(", "pow(2.0::DOUBLE, "))):

    @query(f"quantise_blocks_{_bits}", f"WITH {_PARTS} SELECT round(sqrt(avg(pow(x - CASE WHEN top > 0 THEN {_sql} ELSE 0 END, 2))), 5) AS error FROM s")
    def _quantise(t, _bits=_bits):
        """The root mean square error of a block format over all stored vectors."""
        rows = S.quantised(t.vset, _bits).select(F.explode(F.zip_with("embedding", "restored", lambda a, b: (a - b) * (a - b))).alias("e"))
        return rows.agg(F.round(F.sqrt(F.avg("e")), 5).alias("error"))


@query("command_log_compact", "WITH l AS (SELECT o_custkey AS key, o_orderkey AS seq, CASE WHEN o_orderstatus = 'F' THEN 'SET' ELSE 'APPEND' END AS cmd FROM orders), x AS (SELECT key, max(seq) AS last FROM l WHERE cmd = 'SET' GROUP BY key) SELECT l.key, seq, cmd FROM l LEFT JOIN x ON l.key = x.key WHERE last IS NULL OR seq >= last")
def command_log_compact(t):
    from keyloom.sources.tables import compact

    rows = t.orders.selectExpr("o_custkey AS key", "o_orderkey AS seq", "CASE WHEN o_orderstatus = 'F' THEN 'SET' ELSE 'APPEND' END AS cmd", "array(CAST(o_orderpriority AS BINARY)) AS args")
    return compact(rows).select("key", "seq", "cmd")


@query("xread_many", "WITH e AS (SELECT event_type AS key, epoch_us(ts) // 1000 AS ms, event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events) SELECT key, event_id FROM e WHERE key IN ('click', 'view') AND n BETWEEN 101 AND 120")
def xread_many(t):
    """XREAD on two streams from the hundredth entry on."""
    w = Window.partitionBy("key").orderBy("ts", "event_id")
    e = t.events.withColumnRenamed("event_type", "key").filter("key IN ('click', 'view')").withColumn("n", F.row_number().over(w))
    numbered = e.select("key", "event_id", F.col("n").cast("decimal(20,0)").alias("ms"), F.lit(0).cast("decimal(20,0)").alias("seq"))
    last = numbered.select("key").distinct().select("key", F.lit(100).cast("decimal(20,0)").alias("last_ms"), F.lit(0).cast("decimal(20,0)").alias("last_seq"))
    return streams.read_after(numbered, last, 20).select("key", "event_id")


@query("active_expiry", f"SELECT key FROM kv_string WHERE expire_ms IS NOT NULL AND expire_ms <= {NOW_MS}")
def active_expiry(t):
    """What a sweep would remove now."""
    return t.kv_string.filter(F.col("expire_ms") <= NOW_MS).select("key")


@query("echo", "SELECT r_name AS reply FROM region")
def echo(t):
    return t.region.select(F.col("r_name").alias("reply"))
