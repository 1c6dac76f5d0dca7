"""Set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import sets as S
from keyloom.operators import zsets as Z
from keyloom.operators.hashes import live
from keyloom.plans.registry import NOW_MS, query

A, B, C = "1-URGENT", "2-HIGH", "3-MEDIUM"
IN = "SELECT member FROM kv_set WHERE key = '{}'"
INTER = " INTERSECT ".join(IN.format(k) for k in (A, B, C))
UNION = " UNION ".join(IN.format(k) for k in (A, B))
DIFF = " EXCEPT ".join(IN.format(k) for k in (A, B))
CURSOR = "('0x' || substr(md5({}), 1, 12))::BIGINT"


def more(t):
    return t.customer.filter("c_custkey % 10 = 0").select(F.lit(A).alias("key"), F.concat(F.lit("c"), "c_custkey").alias("member"))


MORE = f"m AS (SELECT '{A}' AS key, concat('c', c_custkey) AS member FROM customer WHERE c_custkey % 10 = 0)"


@query("sadd", f"WITH {MORE} SELECT key, member FROM kv_set UNION SELECT key, member FROM m")
def sadd(t):
    return S.add(t.kv_set, more(t))


@query("srem", f"WITH {MORE} SELECT key, member FROM kv_set EXCEPT SELECT key, member FROM m")
def srem(t):
    return S.remove(t.kv_set, more(t))


@query("scard", "SELECT key, count(DISTINCT member) AS n FROM kv_set GROUP BY key")
def scard(t):
    return S.card(t.kv_set)


@query("sismember", f"SELECT key, member FROM kv_set WHERE key = '{A}' AND member = 'c4'")
def sismember(t):
    return t.kv_set.filter((F.col("key") == A) & (F.col("member") == "c4"))


@query("smismember", f"WITH {MORE} SELECT key, member, CASE WHEN (key, member) IN (SELECT (key, member) FROM kv_set) THEN 1 ELSE 0 END AS found FROM m")
def smismember(t):
    return S.contains(t.kv_set, more(t))


@query("smembers", f"SELECT member FROM kv_set WHERE key = '{A}'")
def smembers(t):
    return t.kv_set.filter(F.col("key") == A).select("member")


@query("srandmember", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(member), member) AS n FROM kv_set) WHERE n <= 3")
def srandmember(t):
    return S.sample(t.kv_set, 3)


@query("srandmember_repeat", "SELECT key, count(*)::BIGINT AS n FROM (SELECT DISTINCT key FROM kv_set), range(5000) GROUP BY key")
def srandmember_repeat(t):
    return S.sample(t.kv_set, 5000, repeat=True).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("spop", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(member), member) AS n FROM kv_set) WHERE n > 2")
def spop(t):
    return S.pop(t.kv_set, 2)[1]


@query("smove", f"SELECT DISTINCT CASE WHEN key = '{A}' AND member = 'c4' THEN '{B}' ELSE key END AS key, member FROM kv_set")
def smove(t):
    return S.move(t.kv_set, A, B, "c4")


@query("sinter", INTER)
def sinter(t):
    return S.inter(t.kv_set, [A, B, C])


@query("sinterstore", f"SELECT 'dst' AS key, member FROM ({INTER})")
def sinterstore(t):
    return S.store(S.inter(t.kv_set, [A, B, C]), "dst")


@query("sintercard", f"SELECT least(count(*), 100) AS n FROM ({INTER})")
def sintercard(t):
    return S.inter_card(t.kv_set, [A, B, C], 100)


@query("sunion", UNION)
def sunion(t):
    return S.union(t.kv_set, [A, B])


@query("sunionstore", f"SELECT 'dst' AS key, member FROM ({UNION})")
def sunionstore(t):
    return S.store(S.union(t.kv_set, [A, B]), "dst")


@query("sdiff", DIFF)
def sdiff(t):
    return S.diff(t.kv_set, [A, B])


@query("sdiffstore", f"SELECT 'dst' AS key, member FROM ({DIFF})")
def sdiffstore(t):
    return S.store(S.diff(t.kv_set, [A, B]), "dst")


@query("sscan", f"SELECT member, cursor FROM (SELECT member, {CURSOR.format('member')} AS cursor FROM kv_set WHERE key = '{A}' ORDER BY 2, 1 LIMIT 40) WHERE member LIKE 'c1%'")
def sscan(t):
    return S.scan(t.kv_set.filter(F.col("key") == A).select("member"), "member", None, 40, "c1*")


@query("zscan", f"SELECT member, score, cursor FROM (SELECT member, score, {CURSOR.format('member')} AS cursor FROM kv_zset WHERE key = 'BUILDING') WHERE cursor > 100000000000000 ORDER BY cursor, member LIMIT 25")
def zscan(t):
    return S.scan(t.kv_zset.filter("key = 'BUILDING'").select("member", "score"), "member", 100_000_000_000_000, 25)


@query("hscan", f"SELECT field, value, cursor FROM (SELECT field, value, {CURSOR.format('field')} AS cursor FROM kv_hash WHERE key = 'cust:20' AND (field_expire_ms IS NULL OR field_expire_ms > {NOW_MS})) WHERE field LIKE '%n%' ORDER BY cursor LIMIT 10")
def hscan(t):
    return S.scan(live(t.kv_hash.filter("key = 'cust:20'"), NOW_MS).select("field", "value"), "field", None, 10, "*n*")


@query("zset_of_set", f"SELECT key, member, 1.0::DOUBLE AS score FROM kv_set WHERE key = '{C}'")
def zset_of_set(t):
    return Z.from_set(t.kv_set.filter(F.col("key") == C))
