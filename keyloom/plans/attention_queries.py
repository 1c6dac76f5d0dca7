"""Attention, cache, tensor store, script, transaction and pub/sub queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import attention as A
from keyloom.operators import vectors as V
from keyloom.plans.registry import EVERY, NOW_MS, query, search

#: Stored tokens: keys are the vectors, values their first eight numbers.
DOT = "list_inner_product(q.embedding::DOUBLE[], k.embedding::DOUBLE[])"


def stored(t, low=0, high=None):
    rows = t.vset.select(F.col("vec_id").alias("token"), F.col("embedding").alias("k"), F.slice("embedding", 1, 8).alias("v"))
    return rows.filter((F.col("token") >= low) & (F.lit(True) if high is None else F.col("token") < high))


def asked(t, which):
    return t.vset.filter(which).select(F.col("element").alias("query"), F.col("embedding").alias("q"))


def softmax(where="true", extra=""):
    first = ", ".join(f"sum(exp(z - m) * k.embedding[{i}]::DOUBLE) / sum(exp(z - m))" for i in (1, 2))
    return f"SELECT query, round(sum(exp(z - m) * v1) / sum(exp(z - m)), 6) AS o1, round(sum(exp(z - m) * v8) / sum(exp(z - m)), 6) AS o8, round(ln(sum(exp(z - m))) + any_value(m), 6) AS lse FROM (SELECT *, max(z) OVER (PARTITION BY query) AS m FROM (SELECT q.element AS query, {DOT} / 8.0 AS z, k.embedding[1]::DOUBLE AS v1, k.embedding[8]::DOUBLE AS v8 FROM vset q JOIN vset k ON q.vec_id < 4 WHERE {where})) GROUP BY query" if not extra else first


def shown(df):
    return df.select("query", F.round(F.get("out", F.lit(0)), 6).alias("o1"), F.round(F.get("out", F.lit(7)), 6).alias("o8"), F.round("lse", 6).alias("lse"))


@search("attend_prefix_query", softmax(), "vec_id < 4")
def attend_prefix_query(t, which):
    return shown(A.attend(stored(t), asked(t, which)))


@search("attend_prefix_window", softmax("k.vec_id >= 300"), "vec_id < 4")
def attend_prefix_window(t, which):
    return shown(A.attend(stored(t, 300), asked(t, which)))


@search("attend_prefix_query_fused", softmax(), "vec_id < 4")
def attend_prefix_query_fused(t, which):
    return shown(A.attend_fused(stored(t, 0, 400), stored(t, 400), asked(t, which)))


@search("attend_prefix_query_sparse", softmax("k.vec_id % 7 = 0"), "vec_id < 4")
def attend_prefix_query_sparse(t, which):
    wanted = t.vset.filter("vec_id % 7 = 0").select(F.col("vec_id").alias("token"))
    return shown(A.attend(stored(t).join(wanted, "token", "left_semi"), asked(t, which)))


_BLOCKS = "SELECT block, round(sum(w * mean), 6) AS score FROM (SELECT block, dim, avg(x) AS mean, any_value(w) AS w FROM (SELECT k.vec_id // 32 AS block, unnest(range(1, 65)) AS dim, unnest(k.embedding)::DOUBLE AS x, unnest(q.embedding)::DOUBLE AS w FROM vset k JOIN vset q ON q.vec_id = 2) GROUP BY block, dim) GROUP BY block"
_QUEST = _BLOCKS.replace("sum(w * mean)", "sum(greatest(w * low, w * high))").replace("avg(x) AS mean", "min(x) AS low, max(x) AS high")


def blocks(t, selector):
    q = t.vset.filter("vec_id = 2").first()["embedding"]
    return A.select_blocks(stored(t), list(q), 32, 5, selector)


@query("attend_select_blocks", f"SELECT * FROM ({_BLOCKS}) ORDER BY score DESC, block LIMIT 5")
def attend_select_blocks(t):
    return blocks(t, 0).withColumn("score", F.round("score", 6))


@query("attend_select_quest", f"SELECT * FROM ({_QUEST}) ORDER BY score DESC, block LIMIT 5")
def attend_select_quest(t):
    return blocks(t, 1).withColumn("score", F.round("score", 6))


@search("attend_prefix_query_sparse_auto", softmax(f"k.vec_id // 32 IN (SELECT block FROM (SELECT * FROM ({_BLOCKS}) ORDER BY score DESC, block LIMIT 5))"), "vec_id < 4")
def attend_prefix_query_sparse_auto(t, which):
    rows = stored(t).withColumn("block", F.floor(F.col("token") / 32)).join(blocks(t, 0), "block", "left_semi")
    return shown(A.attend(rows, asked(t, which)))


@search("attend_prefix_query_sparse_auto_fused", softmax(f"k.vec_id >= 480 OR k.vec_id // 32 IN (SELECT block FROM (SELECT * FROM ({_BLOCKS.replace('q.vec_id = 2', 'q.vec_id = 2 WHERE k.vec_id < 480')}) ORDER BY score DESC, block LIMIT 5))"), "vec_id < 4")
def attend_prefix_query_sparse_auto_fused(t, which):
    q = t.vset.filter("vec_id = 2").first()["embedding"]
    prefix = stored(t, 0, 480)
    chosen = A.select_blocks(prefix, list(q), 32, 5)
    rows = prefix.withColumn("block", F.floor(F.col("token") / 32)).join(chosen, "block", "left_semi")
    return shown(A.attend_fused(rows, stored(t, 480), asked(t, which)))


@search("attend_query", "SELECT query, element, round(v1, 6) AS v1 FROM (SELECT q.element AS query, k.element, k.embedding[1]::DOUBLE AS v1, row_number() OVER (PARTITION BY q.element ORDER BY round(pow(list_distance(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 2), 12), k.element) AS n FROM vset q JOIN vset k ON q.vec_id < 4) WHERE n <= 6", "vec_id < 4")
def attend_query(t, which):
    found = V.nearest(t.vset, t.vset.filter(which).select(F.col("element").alias("query"), "embedding"), 6, "l2")
    return found.join(t.vset, "element").select("query", "element", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("v1"))


_CACHED = "SELECT query, element, score FROM (SELECT q.element AS query, k.element, round(list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.element ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 12), k.element) AS n FROM vset q JOIN vset k ON q.vec_id % 50 = 0 AND k.vec_id % 2 = 1) WHERE n = 1 AND score >= 0.2"


@query("semantic_cache_get", _CACHED)
def semantic_cache_get(t):
    return cached(t, "vec_id % 50 = 0", "vec_id % 2 = 1")


@query("semantic_cache_get_every20", _CACHED.replace("q.vec_id % 50 = 0 AND k.vec_id % 2 = 1", f"q.{EVERY}"))
def semantic_cache_get_every20(t):
    return cached(t, EVERY, "true")


def cached(t, which, entries):
    queries = t.vset.filter(which).select(F.col("element").alias("query"), "embedding")
    return A.nearest_cached(t.vset.filter(entries), queries, 0.2).withColumn("score", F.round("score", 6))


@search("kv_fetch", f"SELECT query, element FROM (SELECT q.element AS query, k.element, list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS c, k.vec_id, row_number() OVER (PARTITION BY q.element ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 12), k.element) AS n FROM vset q JOIN vset k ON q.vec_id < 10) WHERE n <= 8 AND c >= 0.1 AND (vec_id % 3) * 2000000 > {NOW_MS} QUALIFY row_number() OVER (PARTITION BY query ORDER BY n) = 1", "vec_id < 10")
def kv_fetch(t, which):
    from pyspark.sql import Window

    near = V.nearest(t.vset, t.vset.filter(which).select(F.col("element").alias("query"), "embedding"), 8, "cos_dist")
    live = near.join(t.vset.select("element", "vec_id"), "element").filter((1 - F.col("score") >= 0.1) & (F.col("vec_id") % 3 * 2_000_000 > NOW_MS))
    return live.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy("rank"))).filter("n = 1").select("query", "element")


@query("ai_memory_context", "SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn) AS context FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 3 GROUP BY conv_id")
def ai_memory_context(t):
    from pyspark.sql import Window

    last = t.conversations.withColumn("n", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.col("turn").desc()))).filter("n <= 3")
    lines = F.array_sort(F.collect_list(F.struct("turn", F.concat("role", F.lit(": "), "text").alias("line"))))
    return last.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("context"))


@query("ai_memory_add", "SELECT concat('conv:', conv_id) AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos, role, text FROM conversations")
def ai_memory_add(t):
    return A.remember(t.conversations.select(F.concat(F.lit("conv:"), "conv_id").alias("session"), F.col("turn").alias("seq"), "role", "text"))


@query("ai_memory_recall", f"SELECT query, element, score FROM (SELECT q.element AS query, k.element, round(list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.element ORDER BY round(list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 12) DESC, k.element) AS n FROM vset q JOIN vset k ON q.label = k.label AND q.{EVERY}) WHERE n <= 5")
def ai_memory_recall(t):
    """Every 20th vector asks among the memories of its own label."""
    memories = t.vset.select(F.col("label").alias("session"), "element", "embedding")
    queries = t.vset.filter(EVERY).select(F.col("label").alias("session"), F.col("element").alias("query"), "embedding")
    return A.recall(memories, queries, 5).select("query", "element", F.round("score", 6).alias("score"))


@query("semantic_cache_set", "SELECT query, response FROM (SELECT concat('q', vec_id % 60) AS query, max(vec_id) AS seq, arg_max(element, vec_id) AS response FROM vset GROUP BY 1) ORDER BY seq DESC, query LIMIT 45")
def semantic_cache_set(t):
    log = t.vset.select(F.concat(F.lit("q"), F.col("vec_id") % 60).alias("query"), F.col("vec_id").alias("seq"), "embedding", F.col("element").alias("response"))
    return A.cache_set(log, 45).select("query", "response")


@query("semantic_cache_explain", f"SELECT query, element, score, score >= 0.3 AS hit FROM (SELECT q.element AS query, k.element, round(list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.element ORDER BY round(1 - list_cosine_similarity(q.embedding::DOUBLE[], k.embedding::DOUBLE[]), 12), k.element) AS n FROM vset q JOIN vset k ON q.{EVERY} AND k.{EVERY.replace('=', '<>')}) WHERE n = 1")
def semantic_cache_explain(t):
    """Every 20th vector against the others."""
    queries = t.vset.filter(EVERY).select(F.col("element").alias("query"), "embedding")
    return A.explained(t.vset.filter(EVERY.replace("=", "<>")), queries, 0.3).withColumn("score", F.round("score", 6))


@query("v_fetch", "SELECT vec_id AS token, round(embedding[1]::DOUBLE, 6) AS v1 FROM vset WHERE vec_id BETWEEN 10 AND 19")
def v_fetch(t):
    return stored(t, 10, 20).select("token", F.round(F.get("v", F.lit(0)).cast("double"), 6).alias("v1"))


#: In SQL, int8 over the mean and 8 standard deviations on either side.
INT8 = "m AS (SELECT element, vec_id, embedding::DOUBLE[] AS x, list_avg(embedding::DOUBLE[]) AS mean FROM vset), d AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: (v - mean) * (v - mean))) / len(x)) AS dev FROM m), q AS (SELECT element, vec_id, list_transform(x, lambda v: CASE WHEN dev > 0 THEN greatest(-127.0::DOUBLE, least(127.0::DOUBLE, round((v - (mean - 8 * dev)) / (16 * dev) * 254 - 127))) ELSE 0.0 END)::TINYINT[] AS q FROM d)"


@query("v_storebatch", f"WITH {INT8} SELECT vec_id AS token, array_to_string(q, ',') AS payload FROM q")
def v_storebatch(t):
    return t.vset.select(F.col("vec_id").alias("token"), F.array_join(V.quantise_int8("embedding").cast("array<string>"), ",").alias("payload"))


@query("v_snapshot", "SELECT label AS layer, count(*) AS length FROM vset GROUP BY label")
def v_snapshot(t):
    return t.vset.groupBy(F.col("label").alias("layer")).agg(F.count(F.lit(1)).alias("length"))


@query("v_restore", "WITH r AS (SELECT label AS layer, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS token, count(*) OVER (PARTITION BY label) AS length FROM vset) SELECT layer, vec_id, token FROM r WHERE token < length // 2")
def v_restore(t):
    from pyspark.sql import Window

    rows = t.vset.select(F.col("label").alias("layer"), "vec_id", (F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).alias("token"))
    lengths = v_snapshot(t).select("layer", F.floor(F.col("length") / 2).alias("kept"))
    return rows.join(lengths, "layer").filter("token < kept").select("layer", "vec_id", "token")


@query("kv_prefix_membership", "SELECT o_orderkey AS hash, CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 3) THEN 1 ELSE 0 END AS cached FROM orders")
def kv_prefix_membership(t):
    cached = t.lineitem.filter("l_linenumber >= 3").select(F.col("l_orderkey").alias("hash")).distinct().withColumn("cached", F.lit(1))
    return t.orders.select(F.col("o_orderkey").alias("hash")).join(cached, "hash", "left").select("hash", F.coalesce("cached", F.lit(0)).alias("cached"))


_LONGEST = "SELECT a.c_custkey AS id, max(length(b.p))::INTEGER AS matched FROM customer a JOIN (SELECT DISTINCT substr(c_name, 1, CAST(n AS INTEGER)) AS p FROM customer, range(8, 19) AS r(n) WHERE c_custkey % 10 = 0) b ON starts_with(a.c_name, b.p) GROUP BY 1"


@query("kv_prefix_longest", _LONGEST)
def kv_prefix_longest(t):
    return longest(t, "c_custkey % 10 = 0")


@query("kv_prefix_longest_all", _LONGEST.replace(" WHERE c_custkey % 10 = 0", ""))
def kv_prefix_longest_all(t):
    return longest(t, "true")


def longest(t, which):
    """Longest stored prefix of every name: prefixes of both sides meet in an equi-join."""
    cut = lambda df: df.withColumn("n", F.explode(F.sequence(F.lit(8), F.lit(18)))).withColumn("p", F.substring("c_name", F.lit(1), F.col("n")))
    have = cut(t.customer.filter(which)).select("p").distinct()
    return cut(t.customer).join(have, "p").groupBy(F.col("c_custkey").alias("id")).agg(F.max(F.length("p")).alias("matched"))


@query("state_ring", "SELECT 'r' || r_regionkey AS key, 'YZcdefWX' AS whole FROM region")
def state_ring(t):
    """Two writes into a ring of 8 bytes, the second across its end."""
    r = t.region.selectExpr("concat('r', r_regionkey) AS key")
    writes = r.selectExpr("key", "1 AS seq", "0L AS offset", "CAST('abcdefgh' AS BINARY) AS data").unionAll(r.selectExpr("key", "2", "6L", "CAST('WXYZ' AS BINARY)"))
    return A.ring_write(8, writes).select("key", F.col("data").cast("string").alias("whole"))
