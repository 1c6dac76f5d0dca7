"""Keyspace, lifetime and sort queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import keys as K
from keyloom.operators import sets, strings
from keyloom.plans.registry import NOW_MS, query

LIVE = f"(expire_ms IS NULL OR expire_ms > {NOW_MS})"
#: In SQL, the keys that show.
SHOWN = f"(SELECT * FROM kv_string WHERE {LIVE})"
GONE = "g AS (SELECT concat('cust:', o_custkey) AS key FROM orders WHERE o_orderstatus = 'F')"


def live(t):
    return strings.live(t.kv_string, NOW_MS)


def gone(t):
    return t.orders.filter("o_orderstatus = 'F'").select(F.concat(F.lit("cust:"), "o_custkey").alias("key"))


for _name in ("del", "unlink"):

    @query(_name, f"WITH {GONE} SELECT key, value, expire_ms FROM {SHOWN} WHERE key NOT IN (SELECT key FROM g)")
    def _delete(t):
        return K.delete(live(t), gone(t))


for _name in ("exists", "touch"):

    @query(_name, f"WITH {GONE} SELECT count(*) AS n FROM g WHERE key IN (SELECT key FROM kv_string WHERE {LIVE})")
    def _exists(t):
        return K.count_existing(live(t), gone(t))


TYPES = f"c AS (SELECT key, 'string' AS type FROM {SHOWN} UNION ALL SELECT DISTINCT key, 'hash' FROM (SELECT concat('h:', key) AS key FROM kv_hash) UNION ALL SELECT DISTINCT key, 'list' FROM kv_list UNION ALL SELECT DISTINCT key, 'set' FROM kv_set UNION ALL SELECT DISTINCT key, 'zset' FROM kv_zset)"


def catalog(t):
    hashes = t.kv_hash.select(F.concat(F.lit("h:"), "key").alias("key"))
    parts = [live(t).select("key", F.lit("string").alias("type"))]
    parts += [d.select("key").distinct().withColumn("type", F.lit(k)) for d, k in ((hashes, "hash"), (t.kv_list, "list"), (t.kv_set, "set"), (t.kv_zset, "zset"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query("type", f"WITH {TYPES} SELECT key, type FROM c")
def type_(t):
    return catalog(t)


@query("dbsize", f"WITH {TYPES} SELECT type, count(*) AS n FROM c GROUP BY type")
def dbsize(t):
    return catalog(t).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("keys", f"SELECT DISTINCT key FROM {SHOWN} WHERE regexp_matches(key, '^cust:[1-3].*7$')")
def keys(t):
    return K.matching(live(t), "cust:[1-3]*7")


@query("scan", f"SELECT key, cursor FROM (SELECT key, ('0x' || substr(md5(key), 1, 12))::BIGINT AS cursor FROM {SHOWN} ORDER BY 2, 1 LIMIT 50) WHERE key LIKE 'cust:1%'")
def scan(t):
    return sets.scan(live(t).select("key"), "key", None, 50, "cust:1*")


@query("randomkey", f"SELECT key FROM {SHOWN} ORDER BY md5(key), key LIMIT 1")
def randomkey(t):
    return live(t).select("key").orderBy(F.md5(F.col("key").cast("binary")), "key").limit(1)


@query("rename", f"SELECT CASE WHEN key = 'cust:3' THEN 'cust:6' ELSE key END AS key, value, expire_ms FROM {SHOWN} WHERE key <> 'cust:6'")
def rename(t):
    return K.rename(live(t), "cust:3", "cust:6")


@query("renamenx", f"SELECT CASE WHEN key = 'cust:3' THEN 'fresh' ELSE key END AS key, value, expire_ms FROM {SHOWN}")
def renamenx(t):
    return K.rename(live(t), "cust:3", "fresh", only_if_free=True)


@query("copy", f"SELECT key, value, expire_ms FROM {SHOWN} WHERE key <> 'cust:6' UNION ALL SELECT 'cust:6', value, expire_ms FROM {SHOWN} WHERE key = 'cust:3'")
def copy(t):
    return K.copy(live(t), "cust:3", "cust:6")


@query("sort", "SELECT value FROM (SELECT cast(c_acctbal AS VARCHAR) AS value FROM customer) ORDER BY value::DOUBLE, value LIMIT 20 OFFSET 5")
def sort(t):
    return K.sort(t.customer.select(F.col("c_acctbal").cast("string").alias("value")), offset=5, count=20)


@query("sort_ro", "SELECT value FROM kv_string ORDER BY value DESC LIMIT 15")
def sort_ro(t):
    return K.sort(t.kv_string.select("value"), alpha=True, descending=True, count=15)


NEW = {"expire": "1000 * (length(value) % 7) * 100", "pexpire": "length(value) * 11"}
_RULE = {None: "new", "NX": "CASE WHEN expire_ms IS NULL THEN new ELSE expire_ms END", "XX": "CASE WHEN expire_ms IS NOT NULL THEN new ELSE expire_ms END", "GT": "CASE WHEN expire_ms IS NOT NULL AND new > expire_ms THEN new ELSE expire_ms END", "LT": "CASE WHEN expire_ms IS NULL OR new < expire_ms THEN new ELSE expire_ms END"}

for _name, _how in (("expire", None), ("expire_nx", "NX"), ("expire_xx", "XX"), ("expire_gt", "GT"), ("expire_lt", "LT"), ("pexpire", None), ("expireat", "GT"), ("pexpireat", "LT")):
    _step = NEW["pexpire" if _name.startswith("p") else "expire"]
    _at = f"{'' if _name.endswith('at') else NOW_MS}{'4000000' if _name.endswith('at') else ''} + {_step}"

    @query(_name, f"SELECT key, ({_RULE[_how]})::BIGINT AS expire_ms FROM (SELECT *, {_at} AS new FROM {SHOWN})")
    def _expire(t, _at=_at, _how=_how):
        return live(t).select("key", K.set_deadline(F.col("expire_ms"), F.expr(_at).cast("long"), _how).cast("long").alias("expire_ms"))


@query("ttl", f"SELECT key, CASE WHEN expire_ms IS NULL THEN -1 ELSE floor((expire_ms - {NOW_MS} + 500) / 1000) END::BIGINT AS ttl FROM kv_string WHERE {LIVE}")
def ttl(t):
    return live(t).select("key", K.seconds_left(F.col("expire_ms"), NOW_MS).alias("ttl"))


@query("pttl", f"SELECT key, CASE WHEN expire_ms IS NULL THEN -1 ELSE expire_ms - {NOW_MS} END::BIGINT AS ttl FROM kv_string WHERE {LIVE}")
def pttl(t):
    return live(t).select("key", K.millis_left(F.col("expire_ms"), NOW_MS).alias("ttl"))


@query("expiretime", f"SELECT key, CASE WHEN expire_ms IS NULL THEN -1 ELSE floor((expire_ms + 500) / 1000) END::BIGINT AS at FROM kv_string WHERE {LIVE}")
def expiretime(t):
    return live(t).select("key", K.seconds_left(F.col("expire_ms"), 0).alias("at"))


@query("pexpiretime", f"SELECT key, coalesce(expire_ms, -1)::BIGINT AS at FROM kv_string WHERE {LIVE}")
def pexpiretime(t):
    return live(t).select("key", K.millis_left(F.col("expire_ms"), 0).alias("at"))


@query("persist", f"SELECT key, value, NULL::BIGINT AS expire_ms FROM kv_string WHERE {LIVE}")
def persist(t):
    return live(t).select("key", "value", F.lit(None).cast("long").alias("expire_ms"))


for _name in ("flushall", "flushdb"):

    @query(_name, "SELECT key, value, expire_ms FROM kv_string WHERE false")
    def _flush(t):
        return t.kv_string.limit(0)


@query("dump", "SELECT key, '{\"key\":\"' || key || '\",\"value\":\"' || value || '\"}' AS payload FROM kv_string WHERE " + LIVE)
def dump(t):
    return live(t).select("key", F.to_json(F.struct("key", "value")).alias("payload"))


@query("restore", f"SELECT concat('copy:', key) AS key, value, {NOW_MS + 5000}::BIGINT AS expire_ms FROM {SHOWN}")
def restore(t):
    parsed = F.from_json("payload", "key string, value string")
    return dump(t).select(F.concat(F.lit("copy:"), parsed["key"]).alias("key"), parsed["value"].alias("value"), F.lit(NOW_MS + 5000).cast("long").alias("expire_ms"))


@query("info_keyspace", f"SELECT count(*) AS keys, count(expire_ms) AS expires, round(avg(expire_ms - {NOW_MS}), 3) AS avg_ttl FROM {SHOWN}")
def info_keyspace(t):
    left = (F.col("expire_ms") - NOW_MS).cast("double")
    return live(t).agg(F.count(F.lit(1)).alias("keys"), F.count("expire_ms").alias("expires"), F.round(F.avg(left), 3).alias("avg_ttl"))


@query("memory_usage", "SELECT sum(strlen(key) + strlen(value))::BIGINT AS bytes FROM kv_string")
def memory_usage(t):
    return t.kv_string.agg(F.sum(F.octet_length("key") + F.octet_length("value")).cast("long").alias("bytes"))


ACCESS = "k AS (SELECT concat('cust:', c_custkey) AS key, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey * 7 % 1000 END AS expire_ms, c_custkey * 31 % 977 AS accessed, c_custkey * 17 % 41 AS hits FROM customer)"
for _policy, _order in (("allkeys-lru", "accessed DESC"), ("allkeys-lfu", "hits DESC"), ("volatile-lru", "expire_ms IS NULL DESC, accessed DESC"), ("volatile-lfu", "expire_ms IS NULL DESC, hits DESC"), ("volatile-ttl", "expire_ms IS NULL DESC, expire_ms DESC"), ("allkeys-random", "md5(key)"), ("volatile-random", "expire_ms IS NULL DESC, md5(key)")):

    @query("evict_" + _policy.replace("-", "_"), f"WITH {ACCESS} SELECT key FROM k ORDER BY {_order}, key LIMIT 120")
    def _evict(t, _policy=_policy):
        rows = t.customer.selectExpr("concat('cust:', c_custkey) AS key", "CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey * 7 % 1000 END AS expire_ms", "c_custkey * 31 % 977 AS accessed", "c_custkey * 17 % 41 AS hits")
        return K.evict(rows, 120, _policy).select("key")
