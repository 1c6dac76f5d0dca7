"""Hash queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import hashes as H
from keyloom.plans.registry import NOW_MS, query

LIVE = f"(field_expire_ms IS NULL OR field_expire_ms > {NOW_MS})"
#: In SQL, the fields that show.
SHOWN = f"(SELECT * FROM kv_hash WHERE {LIVE})"
#: A log of HSETs: every order writes its status and priority to its customer.
LOG = "log AS (SELECT concat('cust:', o_custkey) AS key, 'status' AS field, o_orderkey AS seq, o_orderstatus AS value FROM orders UNION ALL SELECT concat('cust:', o_custkey), 'segment', o_orderkey, o_orderpriority FROM orders WHERE o_orderkey % 3 = 0)"


def live(t):
    return H.live(t.kv_hash, NOW_MS)


def log(t):
    key = F.concat(F.lit("cust:"), "o_custkey").alias("key")
    a = t.orders.select(key, F.lit("status").alias("field"), F.col("o_orderkey").alias("seq"), F.col("o_orderstatus").alias("value"))
    return a.unionAll(t.orders.filter("o_orderkey % 3 = 0").select(key, F.lit("segment"), "o_orderkey", "o_orderpriority"))


for _name in ("hset", "hmset"):

    @query(_name, f"WITH {LOG}, n AS (SELECT key, field, arg_max(value, seq) AS new FROM log GROUP BY key, field) SELECT key, field, coalesce(new, value) AS value, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS added FROM {SHOWN} h FULL JOIN n USING (key, field)")
    def _hset(t):
        return H.upsert(live(t), log(t))


@query("hsetnx", f"WITH {LOG}, n AS (SELECT key, field, arg_min(value, seq) AS new FROM log GROUP BY key, field) SELECT key, field, coalesce(value, new) AS value, CASE WHEN value IS NULL THEN 1 ELSE 0 END AS added FROM {SHOWN} h FULL JOIN n USING (key, field)")
def hsetnx(t):
    return H.upsert(live(t), log(t), only_new=True)


@query("hget", f"SELECT key, value FROM kv_hash WHERE field = 'nation' AND {LIVE}")
def hget(t):
    return live(t).filter("field = 'nation'").select("key", "value")


@query("hmget", f"SELECT key, max(CASE WHEN field = 'nation' THEN value END) AS nation, max(CASE WHEN field = 'name' THEN value END) AS name, NULL::VARCHAR AS missing FROM {SHOWN} GROUP BY key")
def hmget(t):
    return H.mget(live(t), ["nation", "name", "missing"])


@query("hgetall", f"SELECT key, string_agg(field || '=' || value, ';' ORDER BY field) AS fields FROM {SHOWN} GROUP BY key")
def hgetall(t):
    pairs = F.transform(F.map_entries("fields"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return H.as_map(live(t)).select("key", F.array_join(pairs, ";").alias("fields"))


@query("hkeys", f"SELECT key, string_agg(field, ',' ORDER BY field) AS fields FROM {SHOWN} GROUP BY key")
def hkeys(t):
    return H.as_map(live(t)).select("key", F.array_join(F.map_keys("fields"), ",").alias("fields"))


@query("hvals", f"SELECT key, string_agg(value, ',' ORDER BY field) AS vals FROM {SHOWN} GROUP BY key")
def hvals(t):
    return H.as_map(live(t)).select("key", F.array_join(F.map_values("fields"), ",").alias("vals"))


@query("hlen", f"SELECT key, count(*) AS n FROM kv_hash WHERE {LIVE} GROUP BY key")
def hlen(t):
    return live(t).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("hexists", f"SELECT key, count(*) FILTER (field = 'name') > 0 AS found FROM {SHOWN} GROUP BY key")
def hexists(t):
    return H.as_map(live(t)).select("key", F.map_contains_key("fields", "name").alias("found"))


@query("hstrlen", f"SELECT key, strlen(value) AS n FROM {SHOWN} WHERE field = 'segment'")
def hstrlen(t):
    return live(t).filter("field = 'segment'").select("key", F.octet_length("value").alias("n"))


@query("hdel", f"SELECT key, field, value FROM {SHOWN} WHERE field NOT IN ('segment', 'missing')")
def hdel(t):
    return H.delete(live(t), ["segment", "missing"]).select("key", "field", "value")


#: In SQL, orders beside the nation of their customer, null where that field has expired.
NATIONS = f"(SELECT concat('cust:', o_custkey) AS key FROM orders) o LEFT JOIN (SELECT key, value FROM {SHOWN} WHERE field = 'nation') USING (key)"


def by_order(t, delta):
    return t.orders.select(F.concat(F.lit("cust:"), "o_custkey").alias("key"), F.lit("nation").alias("field"), delta.alias("delta"))


@query("hincrby", f"SELECT key, 'nation' AS field, coalesce(max(value::BIGINT), 0) + sum(5)::BIGINT AS value FROM {NATIONS} GROUP BY key")
def hincrby(t):
    return H.increase(live(t), by_order(t, F.lit(5).cast("long")))


@query("hincrbyfloat", f"SELECT key, 'nation' AS field, coalesce(max(value::DOUBLE), 0.0) + count(*) * 0.5::DOUBLE AS value FROM {NATIONS} GROUP BY key")
def hincrbyfloat(t):
    return H.increase(live(t), by_order(t, F.lit(0.5)))


@query("hrandfield", f"SELECT key, field, value FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(concat('0', field)), field) AS n FROM {SHOWN}) WHERE n <= 2")
def hrandfield(t):
    from keyloom.operators.zsets import sample

    return sample(live(t).withColumnRenamed("field", "member"), 2).select("key", F.col("member").alias("field"), "value")


_NEW = {"hexpire": (NOW_MS + 500_000, None), "hpexpire": (NOW_MS + 700, "NX"), "hexpireat": (3_500_000, "GT"), "hpexpireat": (3_200_000, "LT")}
_RULE = {None: "{0}", "NX": "CASE WHEN field_expire_ms IS NULL THEN {0} ELSE field_expire_ms END", "GT": "CASE WHEN field_expire_ms IS NOT NULL AND {0} > field_expire_ms THEN {0} ELSE field_expire_ms END", "LT": "CASE WHEN field_expire_ms IS NULL OR {0} < field_expire_ms THEN {0} ELSE field_expire_ms END"}
for _name, (_at, _how) in _NEW.items():

    @query(_name, f"SELECT key, field, (CASE WHEN field IN ('name', 'nation') THEN {_RULE[_how].format(_at)} ELSE field_expire_ms END)::BIGINT AS field_expire_ms FROM {SHOWN}")
    def _hexpire(t, _at=_at, _how=_how):
        return H.expire_fields(live(t), ["name", "nation"], _at, _how).select("key", "field", F.col("field_expire_ms").cast("long").alias("field_expire_ms"))


@query("hpersist", f"SELECT key, field, NULL::BIGINT AS field_expire_ms FROM {SHOWN} WHERE field = 'name'")
def hpersist(t):
    return live(t).filter("field = 'name'").select("key", "field", F.lit(None).cast("long").alias("field_expire_ms"))


for _name, _now, _unit, _sql in (("httl", NOW_MS, "s", f"floor((field_expire_ms - {NOW_MS} + 500) / 1000)"), ("hpttl", NOW_MS, "ms", f"field_expire_ms - {NOW_MS}"), ("hexpiretime", 0, "s", "floor((field_expire_ms + 500) / 1000)"), ("hpexpiretime", 0, "ms", "field_expire_ms")):

    @query(_name, f"SELECT key, field, CASE WHEN field_expire_ms IS NULL THEN -1 ELSE {_sql} END::BIGINT AS \"left\" FROM kv_hash WHERE field_expire_ms IS NULL OR field_expire_ms > {_now}")
    def _httl(t, _now=_now, _unit=_unit):
        return H.time_left(t.kv_hash, _now, _unit)
