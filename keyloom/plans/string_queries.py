"""String and counter queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import strings as S
from keyloom.plans.registry import NOW_MS, query

LIVE = f"(expire_ms IS NULL OR expire_ms > {NOW_MS})"
#: A command log of values: every order sets its customer's key to its priority, in order of the order key.
LOG = "log AS (SELECT concat('cust:', o_custkey) AS key, o_orderkey AS seq, o_orderpriority AS value FROM orders)"
#: A command log of counters: line items add quantities to their part, line 1 of every 50th order sets it, of every 70th deletes it.
OP = "CASE WHEN l_linenumber = 1 AND l_orderkey % 50 = 0 THEN 'set' WHEN l_linenumber = 1 AND l_orderkey % 70 = 1 THEN 'del' ELSE 'incr' END"
COUNTS = f"log AS (SELECT concat('part:', l_partkey) AS key, l_orderkey * 10000 + l_linenumber * 1000 + l_suppkey % 1000 AS seq, {OP} AS op, CAST(l_quantity AS BIGINT) AS amount FROM lineitem)"


def log(t):
    return t.orders.select(F.concat(F.lit("cust:"), "o_custkey").alias("key"), F.col("o_orderkey").alias("seq"), F.col("o_orderpriority").alias("value"))


def counts(t):
    return t.lineitem.selectExpr("concat('part:', l_partkey) AS key", "l_orderkey * 10000 + l_linenumber * 1000 + l_suppkey % 1000 AS seq", f"{OP} AS op", "CAST(l_quantity AS BIGINT) AS amount")


@query("get", f"SELECT key, value FROM kv_live WHERE key = 'cust:9' AND {LIVE}")
def get(t):
    return t.kv_live.filter("key = 'cust:9'").select("key", "value")


@query("mget", f"WITH w(pos, key) AS (VALUES (0, 'cust:3'), (1, 'cust:none'), (2, 'cust:1'), (3, 'cust:3')) SELECT pos, key, value FROM w LEFT JOIN (SELECT * FROM kv_live WHERE {LIVE}) USING (key)")
def mget(t):
    keys = t.spark.createDataFrame([(0, "cust:3"), (1, "cust:none"), (2, "cust:1"), (3, "cust:3")], "pos int, key string")
    return S.mget(t.kv_live, keys)


@query("set", f"WITH {LOG} SELECT key, arg_max(value, seq) AS value FROM log GROUP BY key")
def set_(t):
    return S.last_set(log(t))


@query("setnx", f"WITH {LOG} SELECT key, arg_min(value, seq) AS value FROM log GROUP BY key")
def setnx(t):
    return S.last_set(log(t), first=True)


#: Commands SET with lifetimes: every order sets its customer's key, every fourth one for a while.
_TIMED = "tl AS (SELECT concat('cust:', o_custkey) AS key, o_orderkey AS seq, o_orderpriority AS value, CASE WHEN o_orderkey % 4 = 0 THEN 5000000 + o_orderkey END::BIGINT AS expire_ms FROM orders)"


def timed(t):
    return t.orders.selectExpr("concat('cust:', o_custkey) AS key", "o_orderkey AS seq", "o_orderpriority AS value", "CAST(CASE WHEN o_orderkey % 4 = 0 THEN 5000000 + o_orderkey END AS BIGINT) AS expire_ms")


_LAST = "ls AS (SELECT key, max(seq) AS seq, arg_max(value, seq) AS value FROM tl GROUP BY key), lx AS (SELECT ls.key, ls.value, tl.expire_ms FROM ls JOIN tl ON tl.key = ls.key AND tl.seq = ls.seq)"


@query("set_xx", f"WITH {_TIMED}, {_LAST} SELECT k.key, coalesce(lx.value, k.value) AS value, CASE WHEN lx.key IS NULL THEN k.expire_ms ELSE lx.expire_ms END::BIGINT AS expire_ms FROM kv_live k LEFT JOIN lx ON lx.key = k.key")
def set_xx(t):
    return S.set_log(t.kv_live, timed(t), only_old=True)


@query("set_nx", f"WITH {_TIMED}, fs AS (SELECT key, min(seq) AS seq FROM tl GROUP BY key) SELECT coalesce(k.key, tl.key) AS key, coalesce(k.value, tl.value) AS value, CASE WHEN k.key IS NULL THEN tl.expire_ms ELSE k.expire_ms END::BIGINT AS expire_ms FROM (SELECT tl.* FROM tl JOIN fs ON fs.key = tl.key AND fs.seq = tl.seq) tl FULL JOIN kv_live k ON k.key = tl.key")
def set_nx(t):
    return S.set_log(t.kv_live, timed(t), only_new=True)


@query("set_keepttl", f"WITH {_TIMED}, {_LAST} SELECT coalesce(k.key, lx.key) AS key, coalesce(lx.value, k.value) AS value, k.expire_ms::BIGINT AS expire_ms FROM kv_live k FULL JOIN lx ON lx.key = k.key")
def set_keepttl(t):
    return S.set_log(t.kv_live, timed(t), keep_ttl=True)


@query("set_get", f"WITH {_TIMED} SELECT tl.key, tl.seq, coalesce(lag(tl.value) OVER (PARTITION BY tl.key ORDER BY tl.seq), k.value) AS old FROM tl LEFT JOIN kv_live k ON k.key = tl.key")
def set_get(t):
    """What each SET ... GET answers: the value before it, from the log or from the store."""
    return S.replaced(timed(t)).join(t.kv_live.select("key", F.col("value").alias("held")), "key", "left").select("key", "seq", F.coalesce("old", "held").alias("old"))


@query("mset", f"WITH {LOG} SELECT key, coalesce(l.value, k.value) AS value FROM kv_live k FULL JOIN (SELECT key, arg_max(value, seq) AS value FROM log GROUP BY key) l USING (key)")
def mset(t):
    new = S.last_set(log(t)).withColumnRenamed("value", "new")
    return t.kv_live.join(new, "key", "full").select("key", F.coalesce("new", "value").alias("value"))


@query("msetnx", "SELECT key, value FROM kv_live UNION ALL SELECT concat('new:', r_regionkey), r_name FROM region")
def msetnx(t):
    return S.put_if_none(t.kv_live, t.region.select(F.concat(F.lit("new:"), "r_regionkey").alias("key"), F.col("r_name").alias("value")))


@query("msetnx_refused", "SELECT key, value FROM kv_live")
def msetnx_refused(t):
    return S.put_if_none(t.kv_live, t.region.select(F.concat(F.lit("cust:"), F.col("r_regionkey") + 1).alias("key"), F.col("r_name").alias("value")))


for _name, _ms in (("setex", 60_000), ("psetex", 1_500), ("msetex", 90_000)):

    @query(_name, f"WITH {LOG} SELECT key, arg_max(value, seq) AS value, {NOW_MS + _ms}::BIGINT AS expire_ms FROM log GROUP BY key")
    def _set_for(t, _ms=_ms):
        return S.last_set(log(t)).withColumn("expire_ms", F.lit(NOW_MS + _ms).cast("long"))


@query("getset", f"WITH {LOG} SELECT key, seq, value, lag(value) OVER (PARTITION BY key ORDER BY seq) AS old FROM log")
def getset(t):
    return S.replaced(log(t))


@query("getdel", "SELECT key, value FROM kv_live WHERE key LIKE 'cust:1%'")
def getdel(t):
    return t.kv_live.filter("key LIKE 'cust:1%'").select("key", "value")


@query("getex", f"SELECT key, value, {NOW_MS + 10_000}::BIGINT AS expire_ms FROM kv_live WHERE {LIVE}")
def getex(t):
    return t.kv_live.select("key", "value", F.lit(NOW_MS + 10_000).cast("long").alias("expire_ms"))


@query("append", f"WITH {LOG} SELECT key, string_agg(value, '' ORDER BY seq) AS value, strlen(string_agg(value, '' ORDER BY seq)) AS length FROM log GROUP BY key")
def append(t):
    return S.appended(log(t))


@query("strlen", "SELECT doc_id, strlen(text) AS n FROM docs")
def strlen(t):
    return t.docs.select("doc_id", F.octet_length("text").alias("n"))


@query("getrange", "SELECT key, substr(value, 3, length(value) - 4) AS part FROM kv_live")
def getrange(t):
    return t.kv_live.select("key", S.byte_slice(F.col("value"), 2, -3).cast("string").alias("part"))


@query("getrange_clamped", "SELECT key, substr(value, 1, 1) AS part FROM kv_live")
def getrange_clamped(t):
    return t.kv_live.select("key", S.byte_slice(F.col("value"), -100, -99).cast("string").alias("part"))


@query("substr", "SELECT key, '' AS part FROM kv_live")
def substr(t):
    return t.kv_live.select("key", S.byte_slice(F.col("value"), -100, -99, clamp_end=False).cast("string").alias("part"))


@query("setrange", "SELECT key, substr(value, 1, 4) || 'XYZ' || substr(value, 8) AS value FROM kv_live")
def setrange(t):
    return t.kv_live.select("key", S.byte_overwrite(F.col("value"), 4, b"XYZ").cast("string").alias("value"))


@query("setrange_gap", "SELECT key, hex(value::BLOB) || repeat('00', 30 - strlen(value)) || '41' AS value FROM kv_live")
def setrange_gap(t):
    return t.kv_live.select("key", F.hex(S.byte_overwrite(F.col("value"), 30, b"A")).alias("value"))


#: In SQL, one row of the table of lengths after the other; a row is the running maximum of what its symbol gives.
_LCS = "WITH RECURSIVE s AS (SELECT c_custkey, c_name AS a, reverse(c_name) AS b FROM customer), f AS (SELECT c_custkey, a, b, 0 AS i, list_transform(range(length(b)), lambda j: 0::BIGINT) AS r FROM s UNION ALL SELECT c_custkey, a, b, i + 1, list_transform(range(1, length(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: greatest(r[k], (CASE WHEN k > 1 THEN r[k - 1] ELSE 0 END) + CASE WHEN a[i + 1] = b[k] THEN 1 ELSE 0 END)))) FROM f WHERE i < length(a)) SELECT c_custkey, a, b, r[length(b)] AS lcs FROM f WHERE i = length(a)"


@query("lcs", _LCS)
def lcs(t):
    c = t.customer
    return S.lcs(c.select("c_custkey", F.col("c_name").alias("a"), F.reverse("c_name").alias("b")))


_SINCE = f"WITH {COUNTS}, x AS (SELECT key, max(seq) AS reset FROM log WHERE op IN ('set', 'del') GROUP BY key), y AS (SELECT log.*, reset FROM log LEFT JOIN x USING (key) WHERE reset IS NULL OR seq >= reset)"
_COUNTER = _SINCE + " SELECT key, sum(CASE WHEN op IN ('set', 'incr') THEN {sign}amount ELSE 0 END)::BIGINT AS value FROM y GROUP BY key HAVING arg_max(op, seq) <> 'del'"


@query("incrby", _COUNTER.format(sign=""))
def incrby(t):
    return S.counters(counts(t))


@query("decrby", _COUNTER.format(sign="-"))
def decrby(t):
    return S.counters(counts(t).withColumn("amount", -F.col("amount")))


@query("incr", "SELECT concat('part:', l_partkey) AS key, count(*) AS value FROM lineitem GROUP BY 1")
def incr(t):
    return S.counters(counts(t).withColumn("op", F.lit("incr")).withColumn("amount", F.lit(1)))


@query("decr", "SELECT concat('part:', l_partkey) AS key, -count(*) AS value FROM lineitem GROUP BY 1")
def decr(t):
    return S.counters(counts(t).withColumn("op", F.lit("incr")).withColumn("amount", F.lit(-1)))


@query("incrbyfloat", "SELECT concat('part:', l_partkey) AS key, sum(CAST(l_discount AS DECIMAL(18,2)))::DOUBLE AS value FROM lineitem GROUP BY 1")
def incrbyfloat(t):
    exact = F.sum(F.col("l_discount").cast("decimal(18,2)")).cast("double")
    return t.lineitem.groupBy(F.concat(F.lit("part:"), "l_partkey").alias("key")).agg(exact.alias("value"))
