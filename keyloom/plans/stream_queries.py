"""Stream and consumer group queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import streams as X
from keyloom.plans.registry import query

E = "e AS (SELECT event_type AS key, (epoch_us(ts) // 1000)::DECIMAL(20,0) AS ms, (row_number() OVER (PARTITION BY event_type, (epoch_us(ts) // 1000) ORDER BY event_id) - 1)::DECIMAL(20,0) AS seq, event_id, user_id, value FROM events)"
N = E + ", n AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS n, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS r, count(*) OVER (PARTITION BY key) AS size FROM e)"
#: Reads of every group: consumer 0, 1, 2 in turn take 20, 30 and 40 entries; every read is 1000 ms after the one before.
READS = "rd AS (SELECT k AS key, turn, 'c' || (turn % 3) AS consumer, (20 + 10 * (turn % 3)) AS cnt, (turn * 1000)::BIGINT AS time_ms FROM (SELECT DISTINCT event_type AS k FROM events), range(6) AS v(turn)), rt AS (SELECT *, sum(cnt) OVER (PARTITION BY key ORDER BY turn) AS upto FROM rd)"
P = N + ", " + READS + ", p AS (SELECT n.key, ms, seq, consumer, time_ms, 1 AS deliveries FROM n JOIN rt ON n.key = rt.key AND n.n > upto - cnt AND n.n <= upto)"


def entries(t):
    raw = t.events.select(F.col("event_type").alias("key"), "event_id", "user_id", "value", F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)").alias("ms"))
    return X.assign_ids(raw, F.col("ms"), F.col("event_id"))


def pending(t):
    keys = t.events.select(F.col("event_type").alias("key")).distinct()
    turn = F.explode(F.sequence(F.lit(0), F.lit(5)))
    reads = keys.select("key", turn.alias("turn")).selectExpr("key", "turn", "concat('c', turn % 3) AS consumer", "CAST(20 + 10 * (turn % 3) AS BIGINT) AS count", "CAST(turn * 1000 AS BIGINT) AS time_ms")
    return X.deliver(entries(t), reads)


_ALL = "key, ms, seq, event_id"


@query("xadd", f"WITH {E} SELECT {_ALL} FROM e")
def xadd(t):
    return entries(t).select("key", "ms", "seq", "event_id")


@query("xlen", "SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def xlen(t):
    return entries(t).groupBy("key").agg(F.count(F.lit(1)).alias("n"))


START, END = "1704067200000", "1719792000000"


@query("xrange", f"WITH {E}, x AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS i FROM e WHERE ms >= {START} AND ms <= {END}) SELECT {_ALL} FROM x WHERE i <= 40")
def xrange(t):
    return X.between(entries(t), START, END, 40).select("key", "ms", "seq", "event_id")


@query("xrevrange", f"WITH {N} SELECT {_ALL} FROM n WHERE r <= 25")
def xrevrange(t):
    return X.between(entries(t), count=25, rev=True).select("key", "ms", "seq", "event_id")


@query("xread", f"WITH {N}, l AS (SELECT key, ms AS lms, seq AS lseq FROM n WHERE n = 10), x AS (SELECT e.*, row_number() OVER (PARTITION BY e.key ORDER BY ms, seq) AS i FROM e JOIN l ON e.key = l.key AND (ms > lms OR ms = lms AND seq > lseq)) SELECT {_ALL} FROM x WHERE i <= 15")
def xread(t):
    e = entries(t)
    tenth = F.get(F.array_sort(F.collect_list(F.struct("ms", "seq"))), 9)
    last = X.between(e, count=10).groupBy("key").agg(tenth.alias("l")).select("key", F.col("l.ms").alias("last_ms"), F.col("l.seq").alias("last_seq"))
    return X.read_after(e, last, 15).select("key", "ms", "seq", "event_id")


@query("xdel", f"WITH {E} SELECT {_ALL} FROM e WHERE user_id % 5 <> 0")
def xdel(t):
    e = entries(t)
    return X.delete(e, e.filter("user_id % 5 = 0").select("key", "ms", "seq")).select("key", "ms", "seq", "event_id")


@query("xtrim", f"WITH {N} SELECT {_ALL} FROM n WHERE r <= 100")
def xtrim(t):
    return X.trim_length(entries(t), 100).select("key", "ms", "seq", "event_id")


@query("xtrim_minid", f"WITH {E} SELECT {_ALL} FROM e WHERE ms >= {START}")
def xtrim_minid(t):
    return X.trim_id(entries(t), START).select("key", "ms", "seq", "event_id")


_INFO = "SELECT key, count(*) AS length, min(ms) AS first_ms, arg_min(seq, (ms, seq)) AS first_seq, max(ms) AS last_ms, arg_max(seq, (ms, seq)) AS last_seq FROM e GROUP BY key"


@query("xinfo", f"WITH {E} {_INFO}")
def xinfo(t):
    return X.info(entries(t))


@query("xsetid", f"WITH {E}, x AS ({_INFO}) SELECT key, {START} > last_ms OR {START} = last_ms AND 7 >= last_seq AS ok, CASE WHEN {START} > last_ms OR {START} = last_ms AND 7 >= last_seq THEN {START} ELSE last_ms END::DECIMAL(20,0) AS last_ms, CASE WHEN {START} > last_ms OR {START} = last_ms AND 7 >= last_seq THEN 7 ELSE last_seq END::DECIMAL(20,0) AS last_seq FROM x")
def xsetid(t):
    return X.set_id(entries(t), int(START), 7)


@query("xsetid_later", f"WITH {E} SELECT DISTINCT key, true AS ok, 1900000000000::DECIMAL(20,0) AS last_ms, 0::DECIMAL(20,0) AS last_seq FROM e")
def xsetid_later(t):
    return X.set_id(entries(t), 1_900_000_000_000, 0)


#: Offered ids go back and forth; an id that is not larger than all before it is refused.
_OFFERED = "o AS (SELECT event_type AS key, event_id AS n, (event_id * 10 - (event_id % 7) * 15 + 100)::DECIMAL(20,0) AS ms, (event_id % 3)::DECIMAL(20,0) AS seq FROM events), oa AS (SELECT *, max(ms * 10 + seq) OVER (PARTITION BY key ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM o)"


def offered(t):
    return t.events.selectExpr("event_type AS key", "event_id AS n", "CAST(event_id * 10 - (event_id % 7) * 15 + 100 AS DECIMAL(20,0)) AS ms", "CAST(event_id % 3 AS DECIMAL(20,0)) AS seq")


@query("xadd_explicit", f"WITH {_OFFERED} SELECT key, ms, seq, n FROM oa WHERE top IS NULL OR ms * 10 + seq > top")
def xadd_explicit(t):
    return X.accept(offered(t)).select("key", "ms", "seq", "n")


@query("xadd_nomkstream", f"WITH {_OFFERED} SELECT key, ms, seq, n FROM oa WHERE (top IS NULL OR ms * 10 + seq > top) AND key IN ('click', 'view')")
def xadd_nomkstream(t):
    return X.only_existing(X.accept(offered(t)), entries(t).filter("key IN ('click', 'view')")).select("key", "ms", "seq", "n")


_PEL = "key, ms, seq, consumer, time_ms, deliveries"


@query("xreadgroup", f"WITH {P} SELECT {_PEL} FROM p")
def xreadgroup(t):
    return pending(t)


@query("xreadgroup_noack", f"WITH {P}, d AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms DESC, seq DESC) AS i FROM p) SELECT key, ms AS last_ms, seq AS last_seq FROM d WHERE i = 1")
def xreadgroup_noack(t):
    """With NOACK a read leaves only how far the group has come."""
    return X.last_delivered(pending(t))


@query("xreadgroup_history", f"WITH {P}, h AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS i FROM p WHERE consumer = 'c1' AND ms > 1704067200000), g AS (SELECT h.*, e.event_id IS NOT NULL AS found FROM h LEFT JOIN e ON h.key = e.key AND h.ms = e.ms AND h.seq = e.seq AND user_id % 3 <> 0 WHERE i <= 25) SELECT key, ms, seq, found, CASE WHEN found THEN 9500 ELSE time_ms END::BIGINT AS time_ms, CASE WHEN found THEN deliveries + 1 ELSE deliveries END AS deliveries FROM g")
def xreadgroup_history(t):
    """A consumer's own entries once more, some of them deleted meanwhile."""
    return X.history(entries(t).filter("user_id % 3 <> 0"), pending(t), "c1", 9500, "1704067200000-18446744073709551615", 25)


#: Group commands: g1 from the beginning, g2 from the end, g3 made and destroyed, g4 made at an id and moved.
GROUPS = [("g1", 1, "create", "0-0"), ("g2", 1, "create", "$"), ("g3", 1, "create", "0-0"), ("g3", 2, "destroy", None), ("g4", 1, "create", "5-1"), ("g4", 2, "create", "9-9"), ("g4", 3, "setid", "1704067200000-3"), ("g5", 1, "setid", "7-7")]
_GROUPS = f"x AS ({_INFO}), gr AS (SELECT key, 'g1' AS \"group\", 0::DECIMAL(20,0) AS last_ms, 0::DECIMAL(20,0) AS last_seq FROM x UNION ALL SELECT key, 'g2', last_ms, last_seq FROM x UNION ALL SELECT key, 'g4', 1704067200000, 3 FROM x)"


def groups(t):
    e = entries(t)
    log = t.spark.createDataFrame(GROUPS, "group string, seq_no long, op string, id string")
    return X.groups_after(e.select("key").distinct().crossJoin(log), e)  # eight commands for each stream


@query("xgroup", f"WITH {E}, {_GROUPS} SELECT key, \"group\", last_ms, last_seq FROM gr")
def xgroup(t):
    return groups(t)


@query("xgroup_delconsumer", f"WITH {P} SELECT key, count(*) AS dropped FROM p WHERE consumer = 'c2' GROUP BY key")
def xgroup_delconsumer(t):
    return X.without_consumer(pending(t), "c2")[1]


@query("xgroup_delconsumer_left", f"WITH {P} SELECT {_PEL} FROM p WHERE consumer <> 'c2'")
def xgroup_delconsumer_left(t):
    return X.without_consumer(pending(t), "c2")[0].select("key", "ms", "seq", "consumer", "time_ms", "deliveries")


#: The group that has read (r) and one that has only begun (b), each with pending entries.
_REFS = "rg AS (SELECT key, 'r' AS \"group\", max(ms * 100000 + seq) AS top FROM p GROUP BY key UNION ALL SELECT key, 'b', max(ms * 100000 + seq) FROM p WHERE consumer = 'c0' GROUP BY key), pe AS (SELECT key, 'r' AS \"group\", ms, seq, consumer, time_ms FROM p WHERE consumer <> 'c1' UNION ALL SELECT key, 'b', ms, seq, consumer, time_ms FROM p WHERE consumer = 'c0' AND ms::BIGINT % 2 = 0), rf AS (SELECT e.*, ms * 100000 + seq > least_top OR (e.key, ms, seq) IN (SELECT (key, ms, seq) FROM pe) AS ref, row_number() OVER (PARTITION BY e.key ORDER BY ms, seq) AS n, count(*) OVER (PARTITION BY e.key) AS size FROM e JOIN (SELECT key, min(top) AS least_top FROM rg GROUP BY key) q ON q.key = e.key)"


def references(t):
    p = pending(t)
    at = lambda rows, name: X.last_delivered(rows).withColumn("group", F.lit(name))
    held = p.filter("consumer <> 'c1'").withColumn("group", F.lit("r")).unionByName(p.filter("consumer = 'c0' AND CAST(ms AS BIGINT) % 2 = 0").withColumn("group", F.lit("b")))
    return at(p, "r").unionByName(at(p.filter("consumer = 'c0'"), "b")), held


def asked(t):
    """Entries of every fifth user, and one id that is not there."""
    e = entries(t).filter("user_id % 5 = 0").select("key", "ms", "seq")
    return e.unionAll(e.select("key").distinct().selectExpr("key", "CAST(77 AS DECIMAL(20,0))", "CAST(7 AS DECIMAL(20,0))"))


_ASKED = "ak AS (SELECT key, ms, seq FROM e WHERE user_id % 5 = 0 UNION ALL SELECT DISTINCT key, 77::DECIMAL(20,0), 7::DECIMAL(20,0) FROM e)"


@query("xdelex", f"WITH {P}, {_REFS}, {_ASKED} SELECT ak.key, ak.ms, ak.seq, CASE WHEN rf.key IS NULL THEN -1 WHEN ref THEN 2 ELSE 1 END AS reply FROM ak LEFT JOIN rf ON rf.key = ak.key AND rf.ms = ak.ms AND rf.seq = ak.seq")
def xdelex(t):
    """ACKED: what a group still references stays."""
    return X.delete_replies(entries(t), asked(t), "ACKED", *references(t))


@query("xdelex_keepref", f"WITH {E}, {_ASKED} SELECT ak.key, ak.ms, ak.seq, CASE WHEN e.key IS NULL THEN -1 ELSE 1 END AS reply FROM ak LEFT JOIN e ON e.key = ak.key AND e.ms = ak.ms AND e.seq = ak.seq")
def xdelex_keepref(t):
    return X.delete_replies(entries(t), asked(t))


@query("xackdel", f"WITH {P}, {_REFS}, {_ASKED}, nr AS (SELECT key, ms, seq FROM pe WHERE \"group\" <> 'r') SELECT ak.key, ak.ms, ak.seq, CASE WHEN (ak.key, ak.ms, ak.seq) NOT IN (SELECT (key, ms, seq) FROM pe WHERE \"group\" = 'r') THEN -1 WHEN ak.ms * 100000 + ak.seq > least_top OR (ak.key, ak.ms, ak.seq) IN (SELECT (key, ms, seq) FROM nr) THEN 2 ELSE 1 END AS reply FROM ak JOIN (SELECT key, min(top) AS least_top FROM rg GROUP BY key) q ON q.key = ak.key")
def xackdel(t):
    """Acknowledged in r, and deleted unless b still references it."""
    g, p = references(t)
    return X.ack_delete_replies(entries(t), g, p, "r", asked(t), "ACKED")


@query("xtrim_limit", f"WITH {N} SELECT {_ALL} FROM n WHERE n > least(size - 50, 30)")
def xtrim_limit(t):
    return X.trimmed(entries(t), maxlen=50, approximate=True, limit=30)[0].select("key", "ms", "seq", "event_id")


@query("xtrim_acked", f"WITH {P}, {_REFS}, c AS (SELECT *, sum(CASE WHEN ref THEN 0 ELSE 1 END) OVER (PARTITION BY key ORDER BY ms, seq) AS nth FROM rf) SELECT {_ALL} FROM c WHERE ref OR nth > size - 20")
def xtrim_acked(t):
    return X.trimmed(entries(t), maxlen=20, strategy="ACKED", groups=references(t)[0], pending=references(t)[1])[0].select("key", "ms", "seq", "event_id")


@query("xtrim_delref", f"WITH {P} SELECT {_PEL} FROM p WHERE ms >= 1704300000000")
def xtrim_delref(t):
    """The pending list after entries before an id have gone with their references."""
    return X.trimmed(entries(t), minid="1704300000000", strategy="DELREF", pending=pending(t))[1].select("key", "ms", "seq", "consumer", "time_ms", "deliveries")


@query("xinfo_groups", f"WITH {P}, {_REFS}, s AS (SELECT key, \"group\", count(DISTINCT consumer) AS consumers, count(*) AS pending FROM pe GROUP BY ALL) SELECT rg.key, rg.\"group\", coalesce(consumers, 0) AS consumers, coalesce(pending, 0) AS pending, (top // 100000)::DECIMAL(20,0) AS last_ms, (top % 100000)::DECIMAL(20,0) AS last_seq, (SELECT count(*) FROM e WHERE e.key = rg.key AND e.ms * 100000 + e.seq > top) AS lag FROM rg LEFT JOIN s ON s.key = rg.key AND s.\"group\" = rg.\"group\"")
def xinfo_groups(t):
    g, p = references(t)
    return X.group_info(entries(t), g, p)


@query("xinfo_consumers", f"WITH {P}, {_REFS} SELECT key, \"group\", consumer, count(*) AS pending, 9000 - max(time_ms) AS idle_ms FROM pe GROUP BY ALL")
def xinfo_consumers(t):
    return X.consumer_info(references(t)[1], 9000)


@query("xack", f"WITH {P} SELECT {_PEL} FROM p WHERE (key, ms, seq) NOT IN (SELECT (key, ms, seq) FROM e WHERE user_id % 2 = 0)")
def xack(t):
    return X.ack(pending(t), entries(t).filter("user_id % 2 = 0").select("key", "ms", "seq"))


@query("xpending", f"WITH {P} SELECT key, consumer, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM p GROUP BY key, consumer")
def xpending(t):
    return X.pending_summary(pending(t))


@query("xpending_extended", f"WITH {P} SELECT {_PEL} FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY ms, seq) AS i FROM p WHERE consumer = 'c2' AND 9000 - time_ms >= 5000) WHERE i <= 10")
def xpending_extended(t):
    return X.between(pending(t).filter("consumer = 'c2' AND 9000 - time_ms >= 5000"), count=10)


_CLAIMED = "SELECT key, ms, seq, CASE WHEN {0} THEN 'late' ELSE consumer END AS consumer, CASE WHEN {0} THEN 9000 ELSE time_ms END::BIGINT AS time_ms, deliveries + CASE WHEN {0} THEN 1 ELSE 0 END AS deliveries FROM {1}"


@query("xclaim", f"WITH {P} " + _CLAIMED.format("9000 - time_ms >= 6000", "p"))
def xclaim(t):
    return X.claim(pending(t), "late", 6000, 9000)


@query("xautoclaim", f"WITH {P}, q AS (SELECT *, CASE WHEN 9000 - time_ms >= 6000 THEN row_number() OVER (PARTITION BY key, 9000 - time_ms >= 6000 ORDER BY ms, seq) END AS i FROM p) " + _CLAIMED.format("coalesce(i <= 12, false)", "q"))
def xautoclaim(t):
    return X.autoclaim(pending(t), "late", 6000, 9000, "-", 12)
