"""List queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import lists as L
from keyloom.plans.registry import query

I = "i AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx, count(*) OVER (PARTITION BY key) AS size FROM kv_list)"  # noqa: E741
#: Lists of repeated values: the roles of a conversation.
ROLES = "i AS (SELECT concat('conv:', conv_id) AS key, role AS value, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, count(*) OVER (PARTITION BY conv_id) AS size FROM conversations)"


def roles(t):
    return t.conversations.select(F.concat(F.lit("conv:"), "conv_id").alias("key"), F.col("turn").alias("pos"), F.col("role").alias("value"))


@query("llen", "SELECT key, count(*) AS n FROM kv_list GROUP BY key")
def llen(t):
    return t.kv_list.groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("lrange", f"WITH {I} SELECT key, idx, value FROM i WHERE idx BETWEEN 1 AND size - 2")
def lrange(t):
    return L.slice_(t.kv_list, 1, -2)


@query("ltrim", f"WITH {I} SELECT key, idx, value FROM i WHERE idx >= greatest(size - 2, 0)")
def ltrim(t):
    return L.slice_(t.kv_list, -2, -1)


@query("lindex", f"WITH {I} SELECT key, value FROM i WHERE idx = size - 1")
def lindex(t):
    return L.element(t.kv_list, -1)


@query("lset", f"WITH {I} SELECT key, idx, CASE WHEN idx = 2 THEN 'new' ELSE value END AS value, CASE WHEN size > 2 THEN true END AS ok FROM i")
def lset(t):
    return L.replace_at(t.kv_list, 2, "new")


@query("linsert", f"WITH {ROLES}, f AS (SELECT key, min(idx) AS f FROM i WHERE value = 'assistant' GROUP BY key), u AS (SELECT key, idx::DOUBLE AS pos, value FROM i UNION ALL SELECT key, f - 0.5, 'new' FROM f) SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx, value FROM u")
def linsert(t):
    return L.insert(roles(t), "assistant", "new")


@query("lrem", f"WITH {ROLES}, n AS (SELECT *, row_number() OVER (PARTITION BY key, value ORDER BY idx DESC) AS nth FROM i) SELECT key, row_number() OVER (PARTITION BY key ORDER BY idx) - 1 AS idx, value FROM n WHERE NOT (value = 'user' AND nth <= 1)")
def lrem(t):
    return L.remove(roles(t), -1, "user")


@query("lpos", f"WITH {ROLES}, n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY idx DESC) AS nth FROM i WHERE value = 'user') SELECT key, idx FROM n WHERE nth >= 2")
def lpos(t):
    return L.positions(roles(t), "user", rank=-2, count=0)


@query("lpush", f"WITH {I} SELECT key, size - 1 - idx AS idx, value FROM i")
def lpush(t):
    pushed = L.pushes(t.kv_list.select("key", F.col("pos").alias("seq"), F.lit("L").alias("side"), "value"))
    return L.indexed(pushed).select("key", "idx", "value")


@query("rpush", f"WITH {I} SELECT key, idx, value FROM i")
def rpush(t):
    return L.indexed(L.pushes(t.kv_list.select("key", F.col("pos").alias("seq"), F.lit("R").alias("side"), "value"))).select("key", "idx", "value")


for _name, _side in (("lpushx", "L"), ("rpushx", "R")):  # only lists that exist take the push

    @query(_name, f"WITH {I} SELECT key, {'idx + 1' if _side == 'L' else 'idx'} AS idx, value FROM i UNION ALL SELECT key, {'0' if _side == 'L' else 'max(size)'}, 'x' FROM i GROUP BY key")
    def _pushx(t, _side=_side):
        asked = t.kv_list.select("key").distinct().unionAll(t.region.select(F.concat(F.lit("none:"), "r_regionkey").alias("key")))
        new = asked.join(t.kv_list, "key", "left_semi").select("key", F.lit(-1_000_000 if _side == "L" else 1_000_000).alias("pos"), F.lit("x").alias("value"))
        return L.indexed(t.kv_list.unionAll(new)).select("key", "idx", "value")


@query("lpop", f"WITH {I} SELECT key, idx AS turn, value FROM i WHERE idx < 2")
def lpop(t):
    return L.pop(t.kv_list, 2)[0]


@query("rpop", f"WITH {I} SELECT key, size - 1 - idx AS turn, value FROM i WHERE size - 1 - idx < 2")
def rpop(t):
    return L.pop(t.kv_list, 2, right=True)[0]


for _name, _right in (("blpop", False), ("brpop", True)):

    @query(_name, f"WITH {I} SELECT key, 0::BIGINT AS turn, value FROM i WHERE key = 'conv:3' AND idx = {'size - 1' if _right else '0'}")
    def _bpop(t, _right=_right):
        return L.pop_first(t.kv_list, ["none", "conv:3", "conv:1"], 1, _right)


for _name in ("lmpop", "blmpop"):

    @query(_name, f"WITH {I} SELECT key, size - 1 - idx AS turn, value FROM i WHERE key = 'conv:5' AND size - 1 - idx < 3")
    def _lmpop(t):
        return L.pop_first(t.kv_list, ["none", "conv:5"], 3, right=True)


_MOVE = f"WITH {I}, m AS (SELECT CASE WHEN key = 'conv:1' AND idx = {{idx}} THEN 'conv:2' ELSE key END AS key, CASE WHEN key = 'conv:1' AND idx = {{idx}} THEN {{to}} ELSE idx END AS pos, value FROM i) SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos) - 1 AS idx, value FROM m"
for _name, _from, _to in (("lmove", False, True), ("blmove", False, False), ("rpoplpush", True, False), ("brpoplpush", True, False)):

    @query(_name, _MOVE.format(idx="size - 1" if _from else "0", to="1000000" if _to else "-1"))
    def _lmove(t, _from=_from, _to=_to):
        return L.move(t.kv_list, "conv:1", "conv:2", _from, _to)


@query("list_fold", "WITH RECURSIVE l AS (SELECT concat('conv:', conv_id) AS key, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n, role, text FROM conversations), f AS (SELECT key, n, CASE WHEN role = 'assistant' THEN []::VARCHAR[] ELSE [text] END AS v FROM l WHERE n = 1 UNION ALL SELECT f.key, l.n, CASE WHEN role = 'assistant' THEN v[2:] ELSE list_append(v, text) END FROM f JOIN l ON l.key = f.key AND l.n = f.n + 1), z AS (SELECT key, arg_max(v, n) AS v FROM f GROUP BY key) SELECT key, unnest(range(len(v)))::BIGINT AS idx, unnest(v) AS value FROM z")
def list_fold(t):
    """A log of pushes and pops: user turns are pushed, every assistant turn pops from the left."""
    op = F.when(F.col("role") == "assistant", "lpop").otherwise("rpush")
    return L.fold(t.conversations.select(F.concat(F.lit("conv:"), "conv_id").alias("key"), F.col("turn").cast("long").alias("seq"), op.alias("op"), F.col("text").alias("value")))
