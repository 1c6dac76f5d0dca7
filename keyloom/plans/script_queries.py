"""Script, library, transaction and channel queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.functions.ranges import matches
from keyloom.functions.scripts import Function, Libraries, Scripts, register
from keyloom.operators import pubsub as P
from keyloom.operators import transactions as T
from keyloom.plans.registry import query

TWICE = Function("keyloom_twice", "x STRING", "BIGINT", "length(x) * 2 + 1", True)
SHOUT = Function("keyloom_shout", "x STRING, n INT", "STRING", "concat(upper(x), repeat('!', n))")


def libraries(t):
    held = Libraries(t.spark)
    held.load("text", [TWICE, SHOUT], replace=True)
    return held


@query("fcall", "SELECT key, upper(value) || repeat('!', 1 + length(value) % 3) AS result FROM kv_string")
def fcall(t):
    return t.kv_string.select("key", libraries(t).call("keyloom_shout", "value", F.expr("1 + length(value) % 3")).alias("result"))


@query("fcall_ro", "SELECT key, length(value) * 2 + 1 AS result FROM kv_string")
def fcall_ro(t):
    return t.kv_string.select("key", libraries(t).call("keyloom_twice", "value", reads_only=True).alias("result"))


@query("function_list", "SELECT * FROM (VALUES ('text', 'keyloom_twice', true), ('text', 'keyloom_shout', false)) AS v(library, name, reads_only)")
def function_list(t):
    """After a dump has been flushed and restored."""
    held = libraries(t)
    held.restore(held.dump(), "flush")
    return held.list("t*t").select("library", "name", "reads_only")


@query("function_delete", "SELECT * FROM (VALUES ('other', 'keyloom_one')) AS v(library, name)")
def function_delete(t):
    held = libraries(t)
    held.load("other", [Function("keyloom_one", "", "INT", "1")], replace=True)
    held.delete("text")
    return held.list().select("library", "name")


for _name in ("eval", "eval_ro"):

    @query(_name, "SELECT key, length(value) * 2 + 1 AS result FROM kv_string")
    def _eval(t):
        return t.kv_string.select("key", Scripts().eval("length(value) * 2 + 1").alias("result"))


for _name in ("evalsha", "evalsha_ro"):

    @query(_name, "SELECT key, reverse(value) AS result FROM kv_string")
    def _evalsha(t):
        held = Scripts()
        return t.kv_string.select("key", held.evalsha(held.load("reverse(value)").upper()).alias("result"))


@query("script_exists", "SELECT * FROM (VALUES ('loaded', 1), ('never', 0)) AS v(script, found)")
def script_exists(t):
    held = Scripts()
    found = held.exists(held.load("1"), "0" * 40)
    return t.spark.createDataFrame(list(zip(["loaded", "never"], found, strict=True)), "script string, found int")


@query("script_call", "SELECT key, upper(value) AS result FROM kv_string")
def script_call(t):
    """A script that is a function over batches."""
    register(t.spark, "keyloom_upper", lambda s: s.str.upper(), "string")
    return t.kv_string.select("key", F.expr("keyloom_upper(value)").alias("result"))


#: Batches of about seven commands on customers; one command in 97 is refused when it is queued.
COMMANDS = "o_orderkey div 7 AS batch, o_orderkey AS seq, o_custkey AS key, o_orderkey % 97 <> 0 AS ok"
_COMMANDS = "c AS (SELECT o_orderkey // 7 AS batch, o_orderkey AS seq, o_custkey AS key, o_orderkey % 97 <> 0 AS ok FROM orders), bad AS (SELECT DISTINCT batch FROM c WHERE NOT ok)"
#: Each batch watches its keys in the version that they have had since orders before 0; every third key has moved on.
_WATCHES = "wt AS (SELECT DISTINCT batch, key, (key % 5)::INTEGER AS seen FROM c WHERE batch % 2 = 0), vs AS (SELECT c_custkey AS key, (c_custkey % 5 + CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END)::INTEGER AS version FROM customer), mv AS (SELECT DISTINCT batch FROM wt LEFT JOIN vs USING (key) WHERE coalesce(version, 0) <> seen)"


def commands(t):
    return t.orders.selectExpr(*COMMANDS.split(", "))


def watched(t):
    watches = commands(t).filter("batch % 2 = 0").selectExpr("batch", "key", "CAST(key % 5 AS INT) AS seen").distinct()
    versions = t.customer.selectExpr("c_custkey AS key", "CAST(c_custkey % 5 + CASE WHEN c_custkey % 13 = 0 THEN 1 ELSE 0 END AS INT) AS version")
    return watches, versions


@query("multi_exec", f"WITH {_COMMANDS} SELECT key, max(seq) AS last FROM c WHERE batch NOT IN (SELECT batch FROM bad) GROUP BY key")
def multi_exec(t):
    """The last command of every key that took effect: a batch with a refused command is dropped as a whole."""
    return T.executed(commands(t)).groupBy("key").agg(F.max("seq").alias("last"))


@query("exec_watch", f"WITH {_COMMANDS}, {_WATCHES} SELECT batch, seq, key FROM c WHERE batch NOT IN (SELECT batch FROM bad) AND batch NOT IN (SELECT batch FROM mv)")
def exec_watch(t):
    return T.executed(commands(t), *watched(t)).select("batch", "seq", "key")


@query("exec_aborted", f"WITH {_COMMANDS}, {_WATCHES} SELECT batch, CASE WHEN batch IN (SELECT batch FROM bad) THEN 'execabort' ELSE 'nil' END AS reason FROM (SELECT batch FROM bad UNION SELECT batch FROM mv)")
def exec_aborted(t):
    return T.aborted(commands(t), *watched(t))


@query("discard", f"WITH {_COMMANDS} SELECT batch, count(*) AS n FROM c WHERE batch NOT IN (SELECT batch FROM bad) AND batch % 4 <> 1 GROUP BY batch")
def discard(t):
    c = commands(t)
    return T.executed(c, discarded=c.filter("batch % 4 = 1").select("batch").distinct()).groupBy("batch").agg(F.count(F.lit(1)).alias("n"))


#: Subscriptions: every customer takes a channel, a pattern or a shard channel; some leave one, some leave all of a kind.
SUBS = (
    "SELECT c_custkey AS client, 1 AS seq, CASE WHEN c_custkey % 3 = 0 THEN 'channel' WHEN c_custkey % 3 = 1 THEN 'pattern' ELSE 'shard' END AS kind, "
    "CASE WHEN c_custkey % 3 = 1 THEN CASE WHEN c_custkey % 2 = 0 THEN 'c*k' ELSE '?iew' END ELSE CASE c_custkey % 5 WHEN 0 THEN 'click' WHEN 1 THEN 'view' WHEN 2 THEN 'error' ELSE 'signup' END END AS name, true AS on FROM customer "
    "UNION ALL SELECT c_custkey, 2, 'channel', 'click', false FROM customer WHERE c_custkey % 7 = 0 "
    "UNION ALL SELECT c_custkey, 3, CASE WHEN c_custkey % 2 = 0 THEN 'channel' ELSE 'pattern' END, CAST(NULL AS STRING), false FROM customer WHERE c_custkey % 11 = 0"
)
_SUBS = (
    "sl AS (" + SUBS.replace("AS STRING", "AS VARCHAR").replace(" AS on ", ' AS "on" ') + "), so AS (SELECT client, kind, max(seq) AS off FROM sl WHERE name IS NULL GROUP BY client, kind), "
    'sb AS (SELECT l.client, l.kind, l.name FROM (SELECT client, kind, name, max(seq) AS seq, arg_max("on", seq) AS is_on FROM sl WHERE name IS NOT NULL GROUP BY client, kind, name) l LEFT JOIN so ON so.client = l.client AND so.kind = l.kind WHERE is_on AND (off IS NULL OR seq > off))'
)


def subscriptions(t):
    return P.subscribed(t.spark.sql(SUBS.replace("FROM customer", "FROM {customer}"), customer=t.customer))


for _name, _kind in (("subscribe", "channel"), ("ssubscribe", "shard"), ("unsubscribe", "channel"), ("sunsubscribe", "shard"), ("punsubscribe", "pattern")):

    @query(_name, f"WITH {_SUBS} SELECT client, name FROM sb WHERE kind = '{_kind}'")
    def _subscribed(t, _kind=_kind):
        return subscriptions(t).filter(F.col("kind") == _kind).select("client", "name")


@query("psubscribe", "SELECT event_id, event_type AS channel FROM events WHERE event_type LIKE 'c%k' OR event_type LIKE '_iew'")
def psubscribe(t):
    channel = F.col("event_type")
    return t.events.filter(matches(channel, "c*k") | matches(channel, "?iew")).select("event_id", channel.alias("channel"))


@query("publish", f"WITH {_SUBS} SELECT c.channel, (SELECT count(*) FROM sb WHERE kind = 'channel' AND name = c.channel) + (SELECT count(*) FROM sb WHERE kind = 'pattern' AND (name = 'c*k' AND c.channel LIKE 'c%k' OR name = '?iew' AND c.channel LIKE '_iew')) AS receivers FROM (SELECT DISTINCT event_type AS channel FROM events) c")
def publish(t):
    return P.receivers(t.events.select(F.col("event_type").alias("channel")).distinct(), subscriptions(t), ["c*k", "?iew"])


@query("spublish", f"WITH {_SUBS} SELECT c.channel, count(sb.client) AS subscribers FROM (SELECT DISTINCT event_type AS channel FROM events) c LEFT JOIN sb ON kind = 'shard' AND name = c.channel GROUP BY c.channel")
def spublish(t):
    return P.numsub(subscriptions(t), t.events.select(F.col("event_type").alias("channel")).distinct(), "shard")


@query("pubsub_numsub", f"WITH {_SUBS} SELECT c AS channel, (SELECT count(*) FROM sb WHERE kind = 'channel' AND name = c) AS subscribers FROM (VALUES ('click'), ('view'), ('nobody')) AS v(c)")
def pubsub_numsub(t):
    return P.numsub(subscriptions(t), t.spark.createDataFrame([("click",), ("view",), ("nobody",)], "channel string"))


@query("pubsub_channels", f"WITH {_SUBS} SELECT DISTINCT name AS channel FROM sb WHERE kind = 'channel' AND name LIKE '%i%'")
def pubsub_channels(t):
    return P.active(subscriptions(t), "*i*")


@query("pubsub_numpat", f"WITH {_SUBS} SELECT count(DISTINCT name) AS n FROM sb WHERE kind = 'pattern'")
def pubsub_numpat(t):
    return P.numpat(subscriptions(t))
