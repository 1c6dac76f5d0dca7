"""Sorted set queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import zsets as Z
from keyloom.plans.registry import query

SPEND = "spend AS (SELECT o_orderpriority AS key, concat('c', o_custkey) AS member, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS score FROM orders GROUP BY 1, 2)"
A, B, C = "1-URGENT", "2-HIGH", "3-MEDIUM"
RANKED = "r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) - 1 AS rank, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) - 1 AS rrank, count(*) OVER (PARTITION BY key) AS size FROM kv_zset)"


def spend(t):
    total = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("score")
    return t.orders.groupBy(F.col("o_orderpriority").alias("key"), F.concat(F.lit("c"), "o_custkey").alias("member")).agg(total)


def asked(t):
    return t.kv_zset.filter("member LIKE 'c1%'").select("key", "member")


@query("zrank", f"WITH {RANKED} SELECT key, member, rank, score FROM r WHERE member LIKE 'c1%'")
def zrank(t):
    return Z.rank(t.kv_zset, asked(t))


@query("zrevrank", f"WITH {RANKED} SELECT key, member, rrank AS rank, score FROM r WHERE member LIKE 'c1%'")
def zrevrank(t):
    return Z.rank(t.kv_zset, asked(t), rev=True)


@query("zrank_all", f"WITH {RANKED} SELECT key, member, rank, score FROM r")
def zrank_all(t):
    return Z.rank(t.kv_zset, t.kv_zset.select("key", "member"))


@query("zrevrank_all", f"WITH {RANKED} SELECT key, member, rrank AS rank, score FROM r")
def zrevrank_all(t):
    return Z.rank(t.kv_zset, t.kv_zset.select("key", "member"), rev=True)


@query("zrange", f"WITH {RANKED} SELECT key, rank, member, score FROM r WHERE rank BETWEEN 2 AND size - 3")
def zrange(t):
    return Z.range_by_rank(t.kv_zset, 2, -3)


@query("zrevrange", f"WITH {RANKED} SELECT key, rrank AS rank, member, score FROM r WHERE rrank BETWEEN 0 AND 9")
def zrevrange(t):
    return Z.range_by_rank(t.kv_zset, 0, 9, rev=True)


@query("zrangebyscore", "SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score, member) AS n FROM kv_zset WHERE score > 1000 AND score <= 8000) WHERE n BETWEEN 3 AND 22")
def zrangebyscore(t):
    return Z.range_by_score(t.kv_zset, "(1000", "8000", offset=2, count=20)


@query("zrevrangebyscore", "SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY score DESC, member DESC) AS n FROM kv_zset WHERE score < 5000) WHERE n <= 7")
def zrevrangebyscore(t):
    return Z.range_by_score(t.kv_zset, "-inf", "(5000", rev=True, count=7)


@query("zrangebylex", "SELECT key, member FROM kv_zset WHERE member >= 'c10' AND member < 'c3'")
def zrangebylex(t):
    return Z.range_by_lex(t.kv_zset, "[c10", "(c3")


@query("zrevrangebylex", "SELECT key, member FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY member DESC) AS n FROM kv_zset WHERE member <= 'c5') WHERE n <= 4")
def zrevrangebylex(t):
    return Z.range_by_lex(t.kv_zset, "-", "[c5", rev=True, count=4)


@query("zcount", "SELECT key, sum(CASE WHEN score >= 0 AND score < 4000 THEN 1 ELSE 0 END)::BIGINT AS n FROM kv_zset GROUP BY key")
def zcount(t):
    return Z.count_by_score(t.kv_zset, "0", "(4000")


@query("zlexcount", "SELECT key, sum(CASE WHEN member > 'c2' THEN 1 ELSE 0 END)::BIGINT AS n FROM kv_zset GROUP BY key")
def zlexcount(t):
    return Z.count_by_lex(t.kv_zset, "(c2", "+")


@query("zcard", "SELECT key, count(*) AS n FROM kv_zset GROUP BY key")
def zcard(t):
    return Z.card(t.kv_zset)


@query("zscore", "SELECT key, member, score FROM kv_zset WHERE member = 'c7'")
def zscore(t):
    return t.kv_zset.filter("member = 'c7'")


WANTED = "w AS (SELECT k AS key, m AS member FROM (SELECT DISTINCT key AS k FROM kv_zset), (VALUES ('c7'), ('c8'), ('c999999')) AS v(m))"


@query("zmscore", f"WITH {WANTED} SELECT key, member, score FROM w LEFT JOIN kv_zset USING (key, member)")
def zmscore(t):
    keys = t.kv_zset.select("key").distinct()
    wanted = keys.select("key", F.explode(F.array(*[F.lit(m) for m in ("c7", "c8", "c999999")])).alias("member"))
    return Z.score(t.kv_zset, wanted)


@query("zincrby", "WITH d AS (SELECT c_mktsegment AS key, concat('c', o_custkey) AS member, count(*) * 10.0 AS delta FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) SELECT key, member, score + coalesce(delta, 0.0)::DOUBLE AS score FROM kv_zset LEFT JOIN d USING (key, member)")
def zincrby(t):
    orders = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    return Z.increase(t.kv_zset, orders.select(F.col("c_mktsegment").alias("key"), F.concat(F.lit("c"), "o_custkey").alias("member"), F.lit(10.0).alias("delta")))


def moved(t):
    return t.customer.filter("c_custkey % 4 = 0").select(F.col("c_mktsegment").alias("key"), F.concat(F.lit("c"), F.col("c_custkey") + F.when(F.col("c_custkey") % 8 == 0, 0).otherwise(10_000_000)).alias("member"), F.lit(2500.0).alias("score"))


NEW = "n AS (SELECT c_mktsegment AS key, concat('c', c_custkey + CASE WHEN c_custkey % 8 = 0 THEN 0 ELSE 10000000 END) AS member, 2500.0::DOUBLE AS new FROM customer WHERE c_custkey % 4 = 0), j AS (SELECT * FROM kv_zset FULL JOIN n USING (key, member))"
_ADD = "SELECT key, member, v AS score, CASE WHEN score IS NULL THEN 1 ELSE 0 END AS added, CASE WHEN score IS NULL OR v <> score THEN 1 ELSE 0 END AS changed FROM (SELECT *, {} AS v FROM j {})"


@query("zadd", f"WITH {NEW} " + _ADD.format("coalesce(new, score)", ""))
def zadd(t):
    return Z.add(t.kv_zset, moved(t))


@query("zadd_nx", f"WITH {NEW} " + _ADD.format("coalesce(score, new)", ""))
def zadd_nx(t):
    return Z.add(t.kv_zset, moved(t), only_new=True)


@query("zadd_xx", f"WITH {NEW} " + _ADD.format("coalesce(new, score)", "WHERE score IS NOT NULL"))
def zadd_xx(t):
    return Z.add(t.kv_zset, moved(t), only_old=True)


@query("zadd_gt", f"WITH {NEW} " + _ADD.format("CASE WHEN score IS NULL OR new > score THEN new ELSE score END", ""))
def zadd_gt(t):
    return Z.add(t.kv_zset, moved(t), greater=True)


@query("zadd_lt", f"WITH {NEW} " + _ADD.format("CASE WHEN score IS NULL OR new < score THEN new ELSE score END", ""))
def zadd_lt(t):
    return Z.add(t.kv_zset, moved(t), less=True)


@query("zrem", "SELECT key, member, score FROM kv_zset WHERE member NOT LIKE 'c1%'")
def zrem(t):
    return Z.remove(t.kv_zset, asked(t))


@query("zpopmin", f"WITH {RANKED} SELECT key, member, score FROM r WHERE rank < 3")
def zpopmin(t):
    return Z.pop(t.kv_zset, 3)[0]


@query("zpopmax", f"WITH {RANKED} SELECT key, member, score FROM r WHERE rrank < 2")
def zpopmax(t):
    return Z.pop(t.kv_zset, 2, highest=True)[0]


@query("zpopmin_rest", f"WITH {RANKED} SELECT key, member, score FROM r WHERE rank >= 3")
def zpopmin_rest(t):
    return Z.pop(t.kv_zset, 3)[1]


@query("zmpop", f"WITH {RANKED} SELECT key, member, score FROM r WHERE key = 'BUILDING' AND rrank < 4")
def zmpop(t):
    return Z.pop_first(t.kv_zset, ["NONE", "BUILDING", "MACHINERY"], 4, highest=True)


for _name, _high in (("bzpopmin", False), ("bzpopmax", True)):  # without the wait, a blocking pop takes one member

    @query(_name, f"WITH {RANKED} SELECT key, member, score FROM r WHERE key = 'MACHINERY' AND {'rrank' if _high else 'rank'} = 0")
    def _bzpop(t, _high=_high):
        return Z.pop_first(t.kv_zset, ["NONE", "MACHINERY", "BUILDING"], 1, highest=_high)


@query("bzmpop", f"WITH {RANKED} SELECT key, member, score FROM r WHERE key = 'MACHINERY' AND rank < 2")
def bzmpop(t):
    return Z.pop_first(t.kv_zset, ["MACHINERY"], 2)


@query("zrandmember", "SELECT key, member, score FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY md5(concat('0', member)), member) AS n FROM kv_zset) WHERE n <= 5")
def zrandmember(t):
    return Z.sample(t.kv_zset, 5)


_W = "SELECT member, score * {w} AS score FROM spend WHERE key = '{k}'"
_U = "WITH " + SPEND + " SELECT member, {agg}(score) AS score FROM (" + " UNION ALL ".join(_W.format(w=w, k=k) for w, k in ((2.0, A), (0.5, B), (1.0, C))) + ") GROUP BY member{having}"


@query("zunion", _U.format(agg="sum", having=""))
def zunion(t):
    return Z.union(spend(t), [A, B, C], [2.0, 0.5, 1.0])


@query("zunion_max", _U.format(agg="max", having=""))
def zunion_max(t):
    return Z.union(spend(t), [A, B, C], [2.0, 0.5, 1.0], "MAX")


@query("zunionstore", "SELECT 'dst' AS key, member, score FROM (" + _U.format(agg="min", having="") + ")")
def zunionstore(t):
    return Z.store(Z.union(spend(t), [A, B, C], [2.0, 0.5, 1.0], "MIN"), "dst")


@query("zinter", _U.format(agg="sum", having=" HAVING count(*) = 3"))
def zinter(t):
    return Z.inter(spend(t), [A, B, C], [2.0, 0.5, 1.0])


@query("zinterstore", "SELECT 'dst' AS key, member, score FROM (" + _U.format(agg="max", having=" HAVING count(*) = 3") + ")")
def zinterstore(t):
    return Z.store(Z.inter(spend(t), [A, B, C], [2.0, 0.5, 1.0], "MAX"), "dst")


@query("zintercard", "SELECT least(count(*), 50) AS n FROM (" + _U.format(agg="max", having=" HAVING count(*) = 3") + ")")
def zintercard(t):
    return Z.inter_card(spend(t), [A, B, C], 50)


_D = "WITH " + SPEND + f" SELECT {{}}member, score FROM spend WHERE key = '{A}' AND member NOT IN (SELECT member FROM spend WHERE key IN ('{B}', '{C}'))"


@query("zdiff", _D.format(""))
def zdiff(t):
    return Z.diff(spend(t), [A, B, C])


@query("zdiffstore", _D.format("'dst' AS key, "))
def zdiffstore(t):
    return Z.store(Z.diff(spend(t), [A, B, C]), "dst")


@query("zunion_sets", f"SELECT member, CAST(count(*) AS DOUBLE) AS score FROM kv_set WHERE key IN ('{A}', '{B}') GROUP BY member")
def zunion_sets(t):
    return Z.union(Z.from_set(t.kv_set), [A, B])


@query("zrangestore", f"WITH {RANKED} SELECT 'dst' AS key, member, score FROM r WHERE key = 'BUILDING' AND rank BETWEEN 5 AND 14")
def zrangestore(t):
    return Z.store(Z.range_by_rank(t.kv_zset.filter("key = 'BUILDING'"), 5, 14), "dst")


@query("zremrangebyscore", "SELECT key, member, score FROM kv_zset WHERE NOT (score >= 1000 AND score <= 5000)")
def zremrangebyscore(t):
    return Z.remove_by_score(t.kv_zset, "1000", "5000")


@query("zremrangebyrank", f"WITH {RANKED} SELECT key, member, score FROM r WHERE NOT (rank BETWEEN 1 AND size - 2)")
def zremrangebyrank(t):
    return Z.remove_by_rank(t.kv_zset, 1, -2)


@query("zremrangebylex", "SELECT key, member, score FROM kv_zset WHERE NOT (member >= 'c2' AND member <= 'c4')")
def zremrangebylex(t):
    return Z.remove_by_lex(t.kv_zset, "[c2", "[c4")
