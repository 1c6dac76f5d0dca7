"""Bitmap and cardinality queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import bitmaps as B
from keyloom.operators import hll
from keyloom.plans.registry import query

K = ["click", "view", "error"]
SIZE = "z AS (SELECT key, floor(max(pos) / 8)::BIGINT + 1 AS bytes FROM kv_bits GROUP BY key)"
LOG = "log AS (SELECT event_type AS key, user_id AS pos, event_id AS seq, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 1 END AS bit FROM events)"


@query("setbit", f"WITH {LOG} SELECT key, pos FROM log GROUP BY key, pos HAVING arg_max(bit, seq) = 1")
def setbit(t):
    log = t.events.select(F.col("event_type").alias("key"), F.col("user_id").alias("pos"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("bit"))
    return B.set_bits(t.kv_bits.limit(0), log)


@query("getbit", "WITH a AS (SELECT 'click' AS key, c_custkey AS pos FROM customer WHERE c_custkey % 7 = 0) SELECT key, pos, CASE WHEN pos IN (SELECT pos FROM kv_bits WHERE key = 'click') THEN 1 ELSE 0 END AS bit FROM a")
def getbit(t):
    return B.get_bits(t.kv_bits, t.customer.filter("c_custkey % 7 = 0").select(F.lit("click").alias("key"), F.col("c_custkey").alias("pos")))


@query("getbit_all", "SELECT k.key, c_custkey AS pos, CASE WHEN b.pos IS NULL THEN 0 ELSE 1 END AS bit FROM (SELECT DISTINCT key FROM kv_bits) k CROSS JOIN customer LEFT JOIN kv_bits b ON b.key = k.key AND b.pos = c_custkey")
def getbit_all(t):
    keys = t.kv_bits.select("key").distinct()
    return B.get_bits(t.kv_bits, t.customer.select(F.col("c_custkey").alias("pos")).crossJoin(keys).select("key", "pos"))


@query("bitcount", "SELECT key, count(DISTINCT pos) AS n FROM kv_bits GROUP BY key")
def bitcount(t):
    return B.count(t.kv_bits)


@query("bitcount_range", f"WITH {SIZE} SELECT key, sum(CASE WHEN pos // 8 >= 1 AND pos // 8 <= bytes - 3 THEN 1 ELSE 0 END)::BIGINT AS n FROM kv_bits JOIN z USING (key) GROUP BY key")
def bitcount_range(t):
    return B.count(t.kv_bits, 1, -3)


@query("bitcount_bits", "SELECT key, sum(CASE WHEN pos BETWEEN 5 AND 30 THEN 1 ELSE 0 END)::BIGINT AS n FROM kv_bits GROUP BY key")
def bitcount_bits(t):
    return B.count(t.kv_bits, 5, 30, "BIT")


@query("bitpos", "SELECT key, coalesce(min(CASE WHEN pos >= 16 THEN pos END), -1) AS pos FROM kv_bits GROUP BY key")
def bitpos(t):
    return B.first_set(t.kv_bits, 2)


@query("bitpos_clear", "SELECT key, coalesce(max(CASE WHEN pos = r THEN pos + 1 END), 0) AS pos FROM (SELECT key, pos, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS r FROM kv_bits) GROUP BY key")
def bitpos_clear(t):
    return B.first_clear(t.kv_bits)


_X, _Y = "pos IN (SELECT pos FROM kv_bits WHERE key = 'click')", "pos IN (SELECT pos FROM kv_bits WHERE key IN ('view', 'error'))"
_EVERY = "SELECT DISTINCT pos FROM kv_bits WHERE key IN ('click', 'view', 'error')"
_N = "SELECT pos FROM kv_bits WHERE key IN ('click', 'view', 'error') GROUP BY pos HAVING count(*)"
for _op, _sql in (("AND", f"{_N} = 3"), ("OR", _EVERY), ("XOR", f"{_N} % 2 = 1"), ("ONE", f"{_N} = 1"), ("DIFF", f"{_EVERY} AND {_X} AND NOT {_Y}"), ("DIFF1", f"{_EVERY} AND NOT {_X} AND {_Y}"), ("ANDOR", f"{_EVERY} AND {_X} AND {_Y}")):

    @query(f"bitop_{_op.lower()}", _sql)
    def _bitop(t, _op=_op):
        return B.combine(t.kv_bits, _op, K)


@query("bitop_not", f"WITH {SIZE} SELECT pos FROM (SELECT unnest(range(bytes * 8)) AS pos FROM z WHERE key = 'click') WHERE pos NOT IN (SELECT pos FROM kv_bits WHERE key = 'click')")
def bitop_not(t):
    return B.invert(t.kv_bits, "click")


_FIELD = "SELECT key, coalesce(sum(CASE WHEN pos BETWEEN 3 AND 12 THEN 1 << (12 - pos) END), 0)::BIGINT AS value FROM kv_bits GROUP BY key"


@query("bitfield_ro", _FIELD)
def bitfield_ro(t):
    return B.field(t.kv_bits, 3, 10)


@query("bitfield_signed", f"SELECT key, CASE WHEN value >= 512 THEN value - 1024 ELSE value END AS value FROM ({_FIELD})")
def bitfield_signed(t):
    return B.field(t.kv_bits, 3, 10, signed=True)


for _how, _sql in (("WRAP", "(value + 700) % 1024"), ("SAT", "least(value + 700, 1023)"), ("FAIL", "CASE WHEN value + 700 <= 1023 THEN value + 700 END")):

    @query(f"bitfield_{_how.lower()}", f"SELECT key, {_sql} AS value FROM ({_FIELD})")
    def _bitfield(t, _how=_how):
        return B.field(t.kv_bits, 3, 10).select("key", B.field_add(F.col("value"), 700, 10, False, _how).alias("value"))


def registers(t):
    return hll.add(t.events.select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("element")))


@query("pfadd")
def pfadd(t):
    return registers(t)


@query("pfcount")
def pfcount(t):
    return hll.estimate(registers(t))


@query("pfmerge")
def pfmerge(t):
    return hll.estimate(hll.merge(registers(t), K, "dst"))


@query("pfdebug")
def pfdebug(t):
    return registers(t).groupBy("key", "rank").agg(F.count(F.lit(1)).alias("registers"))


_EXACT = "SELECT event_type AS key, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY event_type"


@query("pfcount_error", _EXACT)
def pfcount_error(t):
    """The exact number of elements, and whether the estimate is within 3 % of it (the standard error is 0.8 %)."""
    exact = t.events.groupBy(F.col("event_type").alias("key")).agg(F.count_distinct("user_id").alias("exact"))
    return exact.join(pfcount(t), "key").select("key", "exact", (F.abs(F.col("n") - F.col("exact")) <= 0.03 * F.col("exact")).alias("near"))


@query("pfmerge_error", "SELECT count(DISTINCT user_id) AS exact, true AS near FROM events WHERE event_type IN ('click', 'view', 'error')")
def pfmerge_error(t):
    exact = t.events.filter(F.col("event_type").isin(K)).agg(F.count_distinct("user_id").alias("exact"))
    return exact.select("exact", (F.abs(pfmerge(t).select("n").scalar() - F.col("exact")) <= 0.03 * F.col("exact")).alias("near"))
