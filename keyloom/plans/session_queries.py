"""Queries over sessions: registries, token rows, caches, slots and buffers."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import sessions as S
from keyloom.operators import stores
from keyloom.plans.registry import NOW_MS, query

#: Creations: every part asks for a session, forty sessions in all; the smallest parts ask for no dimension at all.
CREATE = "concat('s', p_partkey % 40) AS session, p_partkey AS seq, p_size * 8 - 8 AS value_dim, CASE p_partkey % 5 WHEN 0 THEN 'int8' WHEN 1 THEN 'turbo4' WHEN 2 THEN 'fp16' WHEN 3 THEN 'turbo2' ELSE 'mlx4g32' END AS fmt"
_VALID = f"value_dim BETWEEN 1 AND {S.MOST_DIM}"
_FORMAT = "CASE WHEN {0} IN ('turbo4', 'turbo3', 'turbo2', 'fp8', 'mlx4g32') AND value_dim % 32 <> 0 THEN 'int8' ELSE {0} END"
_V = f"l AS (SELECT {CREATE} FROM part), f AS (SELECT session, arg_min(value_dim, seq) AS value_dim, arg_min(fmt, seq) AS fmt FROM l WHERE {_VALID} GROUP BY session), v AS (SELECT session, value_dim, {_FORMAT.format('fmt')} AS fmt FROM f)"


@query("v_create", f"WITH {_V} SELECT session, value_dim, fmt FROM v")
def v_create(t):
    return S.v_create(t.part.selectExpr(*_split(CREATE)))


def _split(select: str) -> list[str]:
    """The items of a select list; commas within parentheses and CASE don't divide."""
    out, depth, start = [], 0, 0
    for i, c in enumerate(select):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(select[start:i])
            start = i + 1
    return [*out, select[start:]]


ATTEND = "concat('a', p_partkey % 30) AS session, p_partkey AS seq, 64 AS key_dim, p_size * 8 AS value_dim, 'fp16' AS kquant, CASE WHEN p_partkey % 2 = 0 THEN 'turbo4' ELSE 'fp16' END AS vquant"


@query("attend_create", f"WITH l AS (SELECT {ATTEND} FROM part), f AS (SELECT session, arg_min(key_dim, seq) AS key_dim, arg_min(value_dim, seq) AS value_dim, arg_min(vquant, seq) AS vq FROM l WHERE {_VALID} GROUP BY session) SELECT session, key_dim, value_dim, 'int8' AS kquant, {_FORMAT.format('vq')} AS vquant FROM f")
def attend_create(t):
    return S.attend_create(t.part.selectExpr(*_split(ATTEND)))


#: Registrations: every order registers a prefix, thirty in all, with the parts of its lines as block hashes.
_HASHES = "h AS (SELECT l_orderkey, list(l_partkey ORDER BY l_linenumber, l_partkey) AS hashes FROM lineitem GROUP BY l_orderkey), rl AS (SELECT concat('p', o_custkey % 30) AS session, o_orderkey AS seq, 64 AS value_dim, CASE WHEN o_custkey % 2 = 0 THEN 'turbo4' ELSE 'int8' END AS fmt, hashes FROM orders JOIN h ON l_orderkey = o_orderkey), r AS (SELECT session, any_value(value_dim) AS value_dim, arg_min(fmt, seq) AS fmt, arg_max(hashes, seq) AS hashes FROM rl GROUP BY session)"


def registrations(t):
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey")))
    hashes = t.lineitem.groupBy("l_orderkey").agg(F.transform(lines, lambda x: x["l_partkey"]).alias("hashes"))
    both = t.orders.join(hashes, F.col("l_orderkey") == F.col("o_orderkey"))
    return both.selectExpr("concat('p', o_custkey % 30) AS session", "o_orderkey AS seq", "64 AS value_dim", "CASE WHEN o_custkey % 2 = 0 THEN 'turbo4' ELSE 'int8' END AS fmt", "hashes")


@query("kv_prefix_register", f"WITH {_HASHES} SELECT session, 'K' AS kind, value_dim, fmt, len(hashes)::INTEGER AS n_hashes, hashes[1] AS first_hash FROM r UNION ALL SELECT session, 'V', value_dim, fmt, NULL, NULL FROM r")
def kv_prefix_register(t):
    r = S.prefix_register(registrations(t))
    return r.select("session", "kind", "value_dim", "fmt", F.when(F.col("hashes").isNotNull(), F.size("hashes")).alias("n_hashes"), F.get("hashes", F.lit(0)).alias("first_hash"))


#: Token rows: vectors by label and parity, in the order of their ids.
_TOKENS = "tk AS (SELECT concat('s', label) AS session, (vec_id % 2)::INTEGER AS layer, vec_id, embedding, row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id) - 1 AS token FROM vset)"


def tokens(t):
    rows = t.vset.selectExpr("concat('s', label) AS session", "CAST(vec_id % 2 AS INT) AS layer", "vec_id AS seq", "vec_id", "embedding AS k", "slice(embedding, 1, 8) AS v")
    return S.append_tokens(rows)


@query("attend_store", f"WITH {_TOKENS} SELECT session, layer, token, vec_id, round(embedding[64]::DOUBLE, 6) AS k_last, round(embedding[8]::DOUBLE, 6) AS v_last FROM tk")
def attend_store(t):
    return tokens(t).select("session", "layer", "token", "vec_id", F.round(F.get("k", F.lit(63)).cast("double"), 6).alias("k_last"), F.round(F.get("v", F.lit(7)).cast("double"), 6).alias("v_last"))


@query("attend_info", f"WITH {_TOKENS} SELECT session, count(DISTINCT layer) AS layers, count(*) AS tokens FROM tk GROUP BY session")
def attend_info(t):
    return S.token_info(tokens(t))


@query("v_info", f"WITH {_TOKENS}, {_V} SELECT session, value_dim, fmt, layers, tokens FROM v JOIN (SELECT session, count(DISTINCT layer) AS layers, count(*) AS tokens FROM tk GROUP BY session) USING (session)")
def v_info(t):
    return v_create(t).join(S.token_info(tokens(t)), "session").select("session", "value_dim", "fmt", "layers", "tokens")


#: Stores of whole layers: a vector's label is the number of the store, so the last store of a layer replaces the others.
_HEADS = "st AS (SELECT concat('s', vec_id % 7) AS session, (vec_id % 3)::INTEGER AS layer, label AS store, vec_id AS pos, embedding FROM vset), nw AS (SELECT * FROM st QUALIFY store = max(store) OVER (PARTITION BY session, layer))"


@query("attend_prefix_store", f"WITH {_HEADS} SELECT session, layer, head::INTEGER AS head, pos, round(embedding[head * 16 + 1]::DOUBLE, 6) AS k_first, round(embedding[head * 16 + 16]::DOUBLE, 6) AS v_last FROM nw, range(4) AS r(head)")
def attend_prefix_store(t):
    rows = t.vset.selectExpr("concat('s', vec_id % 7) AS session", "CAST(vec_id % 3 AS INT) AS layer", "label AS store", "vec_id AS pos", "embedding AS k", "embedding AS v")
    return S.store_heads(rows, 4, 16).select("session", "layer", "head", "pos", F.round(F.get("k", F.lit(0)).cast("double"), 6).alias("k_first"), F.round(F.get("v", F.lit(15)).cast("double"), 6).alias("v_last"))


#: Cache entries: forty ids, stored again and again, with lifetimes of 0 (none), 1000 and 2000 seconds from 1,000,000 ms on.
_CACHE = "cl AS (SELECT concat('k', vec_id % 40) AS id, vec_id AS seq, embedding, element AS blob, concat('m', label % 2) AS model, (vec_id % 3) * 1000 AS ttl_s FROM vset), ca AS (SELECT id, arg_max(embedding, seq) AS embedding, arg_max(blob, seq) AS blob, arg_max(model, seq) AS model, arg_max(ttl_s, seq) AS ttl_s FROM cl GROUP BY id), ch AS (SELECT id, embedding, blob, model, CASE WHEN ttl_s > 0 THEN 1000000 + ttl_s * 1000 END::BIGINT AS expire_ms FROM ca)"


def cache(t):
    return S.cache_store(t.vset.selectExpr("concat('k', vec_id % 40) AS id", "vec_id AS seq", "embedding", "element AS blob", "concat('m', label % 2) AS model", "vec_id % 3 * 1000 AS ttl_s", "1000000L AS at_ms"))


@query("kv_store", f"WITH {_CACHE} SELECT id, round(embedding[1]::DOUBLE, 6) AS first, blob, model, expire_ms FROM ch")
def kv_store(t):
    return cache(t).select("id", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"), "blob", "model", "expire_ms")


@query("kv_info", f"WITH {_CACHE} SELECT model, count(*) AS entries, count(*) FILTER (expire_ms IS NULL OR expire_ms > {NOW_MS - 500_000}) AS live, sum(strlen(blob))::BIGINT AS bytes FROM ch GROUP BY model")
def kv_info(t):
    return S.cache_info(cache(t), NOW_MS - 500_000)


#: Opaque blobs: every order stores its priority for its customer's session and a layer.
_BLOBS = "bl AS (SELECT concat('s', o_custkey % 100) AS session, (o_orderkey % 4)::INTEGER AS layer, o_orderkey AS seq, o_orderpriority AS blob FROM orders), sb AS (SELECT session, layer, arg_max(blob, seq) AS blob FROM bl GROUP BY session, layer)"


def blobs(t):
    log = t.orders.selectExpr("concat('s', o_custkey % 100) AS session", "CAST(o_orderkey % 4 AS INT) AS layer", "o_orderkey AS seq", "CAST(o_orderpriority AS BINARY) AS blob")
    return stores.store(log, ["session", "layer"])


@query("ssm_prefix_store", f"WITH {_BLOBS} SELECT session, layer, blob FROM sb")
def ssm_prefix_store(t):
    return blobs(t).select("session", "layer", F.col("blob").cast("string").alias("blob"))


@query("ssm_prefix_fetch", f"WITH {_BLOBS} SELECT blob FROM sb WHERE session = 's7' AND layer = 2")
def ssm_prefix_fetch(t):
    return blobs(t).filter("session = 's7' AND layer = 2").select(F.col("blob").cast("string").alias("blob"))


@query("ssm_prefix_drop", f"WITH {_BLOBS} SELECT session, layer, blob FROM sb WHERE session NOT LIKE 's1%' AND NOT (session LIKE 's2%' AND layer = 1)")
def ssm_prefix_drop(t):
    """Whole sessions like s1*, and layer 1 of those like s2*."""
    b = blobs(t)
    gone = b.filter("session LIKE 's1%'").selectExpr("session", "CAST(NULL AS INT) AS layer").unionAll(b.filter("session LIKE 's2%'").selectExpr("session", "1 AS layer")).distinct()
    return S.drop_layers(b, gone).select("session", "layer", F.col("blob").cast("string").alias("blob"))


_PREFIXES = _HASHES + ", px AS (SELECT session, len(hashes) * 16 AS tokens FROM r)"
_ASKED = "ak AS (SELECT c_custkey AS id, concat('p', c_custkey % 45) AS session, CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 50 END AS restored FROM customer)"


def prefixes(t):
    return S.prefix_register(registrations(t)).filter("kind = 'K'").select("session", (F.size("hashes") * 16).alias("tokens"))


def lookups(t):
    asked = t.customer.selectExpr("c_custkey AS id", "concat('p', c_custkey % 45) AS session", "CASE WHEN c_custkey % 4 = 0 THEN c_custkey % 50 END AS restored")
    return S.prefix_lookup(prefixes(t), asked)


_LOOKUP = f"WITH {_PREFIXES}, {_ASKED}, lk AS (SELECT id, session, restored, CASE WHEN tokens IS NULL THEN 'MISS' ELSE 'HIT' END AS state, CASE WHEN tokens IS NULL THEN 0 ELSE coalesce(restored, tokens) END::BIGINT AS credited FROM ak LEFT JOIN px USING (session))"


@query("kv_prefix_lookup", _LOOKUP + " SELECT id, session, state, credited FROM lk")
def kv_prefix_lookup(t):
    return lookups(t).select("id", "session", "state", "credited")


@query("kv_prefix_info", _LOOKUP + " SELECT (SELECT count(*) FROM px) AS prefixes, (SELECT sum(tokens)::BIGINT FROM px) AS tokens, count(*) FILTER (state = 'HIT') AS hits, count(*) FILTER (state = 'MISS') AS misses, sum(credited)::BIGINT AS credited FROM lk")
def kv_prefix_info(t):
    held = prefixes(t).agg(F.struct(F.count(F.lit(1)).alias("prefixes"), F.sum(F.col("tokens").cast("long")).alias("tokens"))).scalar()
    found = lookups(t).agg(F.count_if(F.col("state") == "HIT").alias("hits"), F.count_if(F.col("state") == "MISS").alias("misses"), F.sum("credited").alias("credited"))
    return found.withColumn("held", held).select("held.prefixes", "held.tokens", "hits", "misses", "credited")


@query("kv_prefix_drop", f"WITH {_PREFIXES} SELECT session, tokens FROM px WHERE session NOT LIKE 'p1%'")
def kv_prefix_drop(t):
    p = prefixes(t)
    return stores.drop(p, p.filter("session LIKE 'p1%'").select("session"), "session")


#: Slots of a warm tier: every event uses one.
_SLOTS = "sl AS (SELECT concat('u', user_id % 20) AS session, (event_id % 3)::INTEGER AS layer, max(event_id) AS used FROM events GROUP BY 1, 2)"
_STATES = "sx AS (SELECT session, layer, used, CASE WHEN row_number() OVER (ORDER BY used DESC, session, layer) <= 24 THEN 'WARM' ELSE 'COLD' END AS state FROM {})"


def slots(t):
    rows = t.events.selectExpr("concat('u', user_id % 20) AS session", "CAST(event_id % 3 AS INT) AS layer", "event_id")
    return rows.groupBy("session", "layer").agg(F.max("event_id").alias("used"))


@query("attend_prefix_lookup", f"WITH {_SLOTS}, {_STATES.format('sl')}, ak AS (SELECT concat('u', a) AS session, b::INTEGER AS layer FROM range(25) AS x(a), range(4) AS y(b)) SELECT session, layer, CASE state WHEN 'WARM' THEN 'HIT' WHEN 'COLD' THEN 'COLD' ELSE 'MISS' END AS state FROM ak LEFT JOIN sx USING (session, layer)")
def attend_prefix_lookup(t):
    asked = t.spark.range(100).selectExpr("concat('u', id div 4) AS session", "CAST(id % 4 AS INT) AS layer")
    return S.slot_lookup(S.slot_states(slots(t), 24), asked)


@query("kv_prefix_warm", f"WITH {_SLOTS}, sw AS (SELECT session, layer, CASE WHEN session = 'u3' THEN 1000000000 ELSE used END AS used FROM sl), {_STATES.format('sw')} SELECT session, layer, state FROM sx")
def kv_prefix_warm(t):
    return S.slot_warm(slots(t), "u3", 1_000_000_000, 24).select("session", "layer", "state")


#: Commands on buffers, and writes into them.
BUFFER = "concat('b', o_custkey % 25) AS session, o_orderkey AS seq, CASE WHEN o_orderkey % 5 = 0 THEN 'free' ELSE 'alloc' END AS op, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 16 + o_orderkey % 3 * 8 END AS size, CASE WHEN o_orderkey % 2 = 0 THEN 'ring' ELSE 'fixed' END AS mode"
_BUFFER = f"c AS (SELECT {BUFFER} FROM orders), fr AS (SELECT session, max(seq) AS freed FROM c WHERE op = 'free' GROUP BY session), ok AS (SELECT c.session, seq, size, mode FROM c LEFT JOIN fr ON c.session = fr.session WHERE op = 'alloc' AND size > 0 AND (freed IS NULL OR seq > freed)), bu AS (SELECT session, arg_min(size, seq) AS size, arg_min(mode, seq) AS mode FROM ok GROUP BY session)"
_WRITES = "w AS (SELECT concat('b', c_custkey % 30) AS session, c_custkey AS seq, c_custkey % 29 - 2 AS off, (c_custkey + 100000)::VARCHAR AS data FROM customer)"
_ACCEPTED = "off >= 0 AND (mode = 'ring' OR off + 6 <= size)"


def buffers(t):
    return S.buffers(t.orders.selectExpr(*_split(BUFFER)))


def writes(t):
    return t.customer.selectExpr("concat('b', c_custkey % 30) AS session", "c_custkey AS seq", "c_custkey % 29 - 2 AS offset", "CAST(CAST(c_custkey + 100000 AS STRING) AS BINARY) AS data")


@query("state_alloc", f"WITH {_BUFFER} SELECT session, size, mode FROM bu")
def state_alloc(t):
    return buffers(t)


_REPLIES = f"WITH c AS (SELECT {BUFFER} FROM orders), b AS (SELECT *, coalesce(last_value(CASE WHEN op = 'free' THEN 0 WHEN size > 0 THEN 1 END IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS there FROM c)"


@query("state_free", _REPLIES + " SELECT session, seq, CASE WHEN op = 'free' THEN CASE WHEN there = 1 THEN '1' ELSE '0' END WHEN size <= 0 THEN 'size' WHEN there = 1 THEN 'exists' ELSE 'OK' END AS reply FROM b")
def state_free(t):
    """What every ALLOC and FREE answers."""
    return S.buffer_replies(t.orders.selectExpr(*_split(BUFFER))).select("session", "seq", "reply")


@query("state_write", f"WITH {_BUFFER}, {_WRITES} SELECT w.session, seq, CASE WHEN size IS NOT NULL AND {_ACCEPTED} THEN 6 ELSE -1 END AS reply FROM w LEFT JOIN bu ON w.session = bu.session")
def state_write(t):
    return S.write_replies(buffers(t), writes(t))


_FILLED = f"WITH {_BUFFER}, {_WRITES}, eb AS (SELECT w.session, size, seq, i, (off + i) % size AS pp, substr(data, i + 1, 1) AS ch FROM w JOIN bu ON w.session = bu.session, range(6) AS r(i) WHERE {_ACCEPTED}), lb AS (SELECT session, pp, arg_max(ch, seq * 10 + i) AS ch FROM eb GROUP BY session, pp), fl AS (SELECT bu.session, size, mode, string_agg(coalesce(hex(ch), '00'), '' ORDER BY p) AS data FROM bu, LATERAL (SELECT unnest(range(size)) AS p) LEFT JOIN lb ON lb.session = bu.session AND lb.pp = p GROUP BY ALL)"


@query("state_contents", _FILLED + " SELECT session, size, mode, data FROM fl")
def state_contents(t):
    return S.contents(buffers(t), writes(t))


@query("state_read", _FILLED + ", rd AS (SELECT session, size, mode, data, o AS \"offset\", 10 AS length FROM fl, (VALUES (0), (12), (20)) AS v(o)) SELECT session, \"offset\", length, CASE WHEN mode = 'ring' OR \"offset\" + length <= size THEN substr(repeat(data, 4), (\"offset\" % size) * 2 + 1, length * 2) END AS data FROM rd")
def state_read(t):
    own = buffers(t)
    reads = own.select("session", F.explode(F.array(F.lit(0), F.lit(12), F.lit(20))).alias("offset"), F.lit(10).alias("length"))
    return S.read_bytes(S.contents(own, writes(t)), reads)


@query("state_info", f"WITH {_BUFFER} SELECT mode, count(*) AS buffers, sum(size)::BIGINT AS bytes FROM bu GROUP BY mode")
def state_info(t):
    return S.buffer_info(buffers(t))
