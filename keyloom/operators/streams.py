"""Streams: rows (key, ms, seq, fields...) in the order of (ms, seq), ids as two unsigned 64-bit parts (DECIMAL(20,0))."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ID = ("ms", "seq")
_ID_TYPE = "decimal(20,0)"


def parse_id(text: str, default_seq: int) -> tuple[int, int]:
    ms, _, seq = text.partition("-")
    return int(ms), int(seq) if seq else default_seq


def assign_ids(entries: DataFrame, ms: Column, order: Column) -> DataFrame:
    """XADD with ``ms-*``: seq counts the entries of a key within a millisecond."""
    w = Window.partitionBy("key", "ms").orderBy(order)
    return entries.withColumn("ms", ms.cast(_ID_TYPE)).withColumn("seq", (F.row_number().over(w) - 1).cast(_ID_TYPE))


def _compare(at: tuple[int, int]) -> tuple[Column, Column]:
    ms, seq = (F.lit(str(x)).cast(_ID_TYPE) for x in at)
    after = (F.col("ms") > ms) | ((F.col("ms") == ms) & (F.col("seq") > seq))
    same = (F.col("ms") == ms) & (F.col("seq") == seq)
    return after, same


def _ordered(desc: bool = False) -> list[Column]:
    return [F.col(c).desc() if desc else F.col(c).asc() for c in ID]


def between(entries: DataFrame, start: str = "-", end: str = "+", count: int | None = None, rev: bool = False) -> DataFrame:
    """XRANGE (XREVRANGE) of every key: ``-``, ``+``, ids, ``(`` in front to exclude; at most ``count`` entries a key."""
    out = entries
    for bound, is_start in ((start, True), (end, False)):
        if bound in "-+":
            continue
        exclusive = bound.startswith("(")
        after, same = _compare(parse_id(bound.lstrip("("), 0 if is_start else (1 << 64) - 1))
        keep = after if is_start else ~after & ~same
        out = out.filter(keep if exclusive else keep | same)
    if count is None:
        return out
    if count <= 0:
        return out.limit(0)
    nth = F.row_number().over(Window.partitionBy("key").orderBy(*_ordered(rev)))
    return out.withColumn("__nth", nth).filter(F.col("__nth") <= count).drop("__nth")


def read_after(entries: DataFrame, last: DataFrame, count: int | None = None) -> DataFrame:
    """XREAD: entries of each stream after the id given in ``last`` (key, last_ms, last_seq)."""
    joined = entries.join(last, "key")
    new = joined.filter((F.col("ms") > F.col("last_ms")) | ((F.col("ms") == F.col("last_ms")) & (F.col("seq") > F.col("last_seq")))).drop("last_ms", "last_seq")
    return between(new, count=count)


def delete(entries: DataFrame, ids: DataFrame) -> DataFrame:
    return entries.join(ids, ["key", *ID], "left_anti")


def trim_length(entries: DataFrame, maxlen: int) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy("key").orderBy(*_ordered(True)))
    return entries.withColumn("__nth", nth).filter(F.col("__nth") <= maxlen).drop("__nth")


def trim_id(entries: DataFrame, minid: str) -> DataFrame:
    return between(entries, minid)


def info(entries: DataFrame) -> DataFrame:
    """Length, first and last id of every stream."""
    at = F.struct(*ID)
    own = entries.groupBy("key").agg(F.count(F.lit(1)).alias("length"), F.min(at).alias("a"), F.max(at).alias("b"))
    return own.select("key", "length", F.col("a.ms").alias("first_ms"), F.col("a.seq").alias("first_seq"), F.col("b.ms").alias("last_ms"), F.col("b.seq").alias("last_seq"))


def deliver(entries: DataFrame, readers: DataFrame) -> DataFrame:
    """XREADGROUP ``>`` for a whole schedule of reads at once: the pending list that it leaves.

    ``readers`` are rows (key, turn, consumer, count, time_ms): in turn order each read takes the next ``count`` entries
    of its stream. Reads and entries are laid out by the entry number they begin at; each entry belongs to the last read
    that begins before it, if that read reaches it. So the work grows with entries plus reads, not with what is asked for.
    """
    w = Window.partitionBy("key").orderBy("turn")
    taken = readers.filter("count > 0").withColumn("upto", F.sum("count").over(w))
    reads = taken.select("key", (F.col("upto") - F.col("count") + 1).cast("long").alias("n"), F.lit(0).alias("kind"), F.struct("consumer", "time_ms", "upto").alias("read"))
    numbered = entries.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy(*_ordered())).cast("long"))
    both = reads.unionByName(numbered.select("key", *ID, "n", F.lit(1).alias("kind")), allowMissingColumns=True)
    line = Window.partitionBy("key").orderBy("n", "kind").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("read", F.last("read", ignorenulls=True).over(line)).filter((F.col("kind") == 1) & (F.col("n") <= F.col("read.upto")))
    return found.select("key", *ID, "read.consumer", "read.time_ms", F.lit(1).alias("deliveries"))


def last_delivered(delivered: DataFrame) -> DataFrame:
    """key, last_ms, last_seq: how far a group has read; with NOACK this is all that a read leaves."""
    return delivered.groupBy("key").agg(F.max(F.struct(*ID)).alias("l")).select("key", F.col("l.ms").alias("last_ms"), F.col("l.seq").alias("last_seq"))


def history(entries: DataFrame, pending: DataFrame, consumer: str, now_ms: int, after: str = "0", count: int | None = None) -> DataFrame:
    """XREADGROUP with an id: the consumer's own pending entries after it, delivered again where they still exist.

    found is false for an entry that was deleted meanwhile ([id, nil]): its time and count stay.
    """
    own = between(pending.filter(F.col("consumer") == consumer), "(" + after, count=count)
    there = entries.select("key", *ID, F.lit(True).alias("found"))
    both = own.join(there, ["key", *ID], "left").withColumn("found", F.coalesce("found", F.lit(False)))
    again = lambda new, old: F.when(F.col("found"), new).otherwise(old)
    return both.select("key", *ID, "found", again(F.lit(now_ms).cast("long"), F.col("time_ms")).alias("time_ms"), again(F.col("deliveries") + 1, F.col("deliveries")).alias("deliveries"))


def accept(log: DataFrame) -> DataFrame:
    """XADD with explicit ids of rows (key, n, ms, seq, ...), in order of n: an id must be larger than all before it.

    A refused id is never larger than the accepted ones, so the largest id offered so far is the largest accepted.
    """
    before = F.max(F.struct(*ID)).over(Window.partitionBy("key").orderBy("n").rowsBetween(Window.unboundedPreceding, -1))
    return log.withColumn("before", before).filter((F.col("before").isNull() | (F.struct(*ID) > F.col("before"))) & ((F.col("ms") > 0) | (F.col("seq") > 0))).drop("before")


def only_existing(new: DataFrame, entries: DataFrame) -> DataFrame:
    """NOMKSTREAM: entries for streams that are there."""
    return new.join(entries.select("key").distinct(), "key", "left_semi")


def referenced(entries: DataFrame, groups: DataFrame, pending: DataFrame) -> DataFrame:
    """``entries`` with is_referenced: a group (key, group, last_ms, last_seq) has yet to read it or holds it pending."""
    least = groups.groupBy("key").agg(F.min(F.struct(F.col("last_ms").alias("ms"), F.col("last_seq").alias("seq"))).alias("least"))
    held = pending.select("key", *ID).distinct().withColumn("held", F.lit(True))
    both = entries.join(least, "key", "left").join(held, ["key", *ID], "left")
    unread = F.coalesce(F.struct(*ID) > F.col("least"), F.lit(False))
    return both.withColumn("is_referenced", unread | F.coalesce("held", F.lit(False))).drop("least", "held")


#: ``~`` without a LIMIT removes at most so many entries of a stream. Fixed value.
APPROXIMATE_LIMIT = 10_000


def trimmed(entries: DataFrame, maxlen: int | None = None, minid: str | None = None, approximate: bool = False, limit: int | None = None, strategy: str = "KEEPREF", groups: DataFrame | None = None, pending: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """XTRIM with all its options: the entries and the pending lists that it leaves.

    The oldest entries go, beyond MAXLEN or before MINID, at most LIMIT of them (only with ``~``, which is exact here).
    ACKED passes over what a group still references and goes on; DELREF takes entries out of pending lists too.
    """
    if (maxlen is None) == (minid is None) or limit is not None and not approximate:
        raise ValueError("either MAXLEN or MINID; LIMIT only with ~")
    most = (APPROXIMATE_LIMIT if limit is None else limit) if approximate else 0
    rows = referenced(entries, groups, pending) if strategy == "ACKED" else entries.withColumn("is_referenced", F.lit(False))
    if minid is not None:
        after, same = _compare(parse_id(minid, 0))
        old, allowed = ~after & ~same, F.lit(None)
    else:
        old, allowed = F.lit(True), F.count(F.lit(1)).over(Window.partitionBy("key")) - maxlen
    candidate = old & ~F.col("is_referenced")
    nth = F.sum(candidate.cast("int")).over(Window.partitionBy("key").orderBy(*_ordered()).rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("candidate", candidate).withColumn("nth", nth).withColumn("allowed", allowed.cast("long"))
    goes = F.col("candidate") & (F.col("allowed").isNull() | (F.col("nth") <= F.col("allowed"))) & (F.lit(most <= 0) | (F.col("nth") <= most))
    marked = placed.withColumn("goes", goes)
    left = marked.filter(~F.col("goes")).select(*entries.columns)
    if strategy == "DELREF" and pending is not None:
        pending = ack(pending, marked.filter("goes").select("key", *ID))
    return left, pending


def delete_replies(entries: DataFrame, ids: DataFrame, strategy: str = "KEEPREF", groups: DataFrame | None = None, pending: DataFrame | None = None) -> DataFrame:
    """XDELEX: for each id 1 (deleted), -1 (no such entry) or, with ACKED, 2 (a group still references it)."""
    rows = referenced(entries, groups, pending) if strategy == "ACKED" else entries.withColumn("is_referenced", F.lit(False))
    both = ids.join(rows.select("key", *ID, "is_referenced"), ["key", *ID], "left")
    return both.select("key", *ID, F.when(F.col("is_referenced").isNull(), -1).when(F.col("is_referenced"), 2).otherwise(1).alias("reply"))


def ack_delete_replies(entries: DataFrame, groups: DataFrame, pending: DataFrame, group: str, ids: DataFrame, strategy: str = "KEEPREF") -> DataFrame:
    """XACKDEL: for each id -1 (not pending in the group), else it is acknowledged there, and 1 (deleted) or, with ACKED, 2
    (another group still references it). ``pending`` has the column group."""
    own = pending.filter(F.col("group") == group).join(ids, ["key", *ID], "left_semi").select("key", *ID).distinct()
    rest = pending.join(own.withColumn("group", F.lit(group)), ["key", *ID, "group"], "left_anti")
    done = delete_replies(entries, own, strategy, groups, rest)
    gone = F.when(F.col("reply").isNull(), -1).when(F.col("reply") == -1, 1).otherwise(F.col("reply"))
    return ids.join(done, ["key", *ID], "left").select("key", *ID, gone.alias("reply"))


def group_info(entries: DataFrame, groups: DataFrame, pending: DataFrame) -> DataFrame:
    """XINFO GROUPS: consumers with pending entries, pending entries, how far each group has read, and its lag."""
    held = pending.groupBy("key", "group").agg(F.count_distinct("consumer").alias("consumers"), F.count(F.lit(1)).alias("pending"))
    unread = entries.join(groups, "key").filter(F.struct(*ID) > F.struct(F.col("last_ms").alias("ms"), F.col("last_seq").alias("seq"))).groupBy("key", "group").agg(F.count(F.lit(1)).alias("lag"))
    both = groups.join(held, ["key", "group"], "left").join(unread, ["key", "group"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("key", "group", zero("consumers"), zero("pending"), "last_ms", "last_seq", zero("lag"))


def consumer_info(pending: DataFrame, now_ms: int) -> DataFrame:
    """XINFO CONSUMERS: pending entries of each consumer, and the time since its last delivery."""
    return pending.groupBy("key", "group", "consumer").agg(F.count(F.lit(1)).alias("pending"), (F.lit(now_ms) - F.max("time_ms")).alias("idle_ms"))


def groups_after(log: DataFrame, entries: DataFrame) -> DataFrame:
    """XGROUP CREATE, SETID and DESTROY of rows (key, group, seq_no, op, id): the groups that are left, and where they stand.

    ``id`` is '$' (the stream's last entry) or ms-seq. CREATE of a group that is there, and SETID of one that is not,
    change nothing; after a DESTROY a group begins anew.
    """
    ended = log.filter("op = 'destroy'").groupBy("key", "group").agg(F.max("seq_no").alias("ended"))
    since = log.filter("op <> 'destroy'").join(ended, ["key", "group"], "left").filter(F.col("ended").isNull() | (F.col("seq_no") > F.col("ended")))
    made = since.filter("op = 'create'").groupBy("key", "group").agg(F.min("seq_no").alias("made"))
    valid = since.join(made, ["key", "group"]).filter((F.col("seq_no") == F.col("made")) | ((F.col("op") == "setid") & (F.col("seq_no") > F.col("made"))))
    stands = valid.groupBy("key", "group").agg(F.max_by("id", "seq_no").alias("id")).join(info(entries).select("key", "last_ms", "last_seq"), "key", "left")
    part = lambda k: F.try_element_at(F.split("id", "-"), F.lit(k)).cast(_ID_TYPE)
    top = lambda c: F.coalesce(c, F.lit(0).cast(_ID_TYPE))
    last = F.col("id") == "$"
    return stands.select("key", "group", F.when(last, top(F.col("last_ms"))).otherwise(part(1)).alias("last_ms"), F.when(last, top(F.col("last_seq"))).otherwise(F.coalesce(part(2), F.lit(0).cast(_ID_TYPE))).alias("last_seq"))


def without_consumer(pending: DataFrame, consumer: str) -> tuple[DataFrame, DataFrame]:
    """XGROUP DELCONSUMER: what is left pending, and how many entries each stream's consumer had (the answer)."""
    gone = pending.filter(F.col("consumer") == consumer).groupBy("key").agg(F.count(F.lit(1)).alias("dropped"))
    return pending.filter(F.col("consumer") != consumer), gone


def set_id(entries: DataFrame, ms: int, seq: int) -> DataFrame:
    """XSETID: ok is false, and the last id stays, where it would be smaller than a stream's newest entry."""
    new = F.struct(*[F.lit(str(x)).cast(_ID_TYPE).alias(c) for c, x in zip(ID, (ms, seq), strict=True)])
    top = F.struct(F.col("last_ms").alias("ms"), F.col("last_seq").alias("seq"))
    own = info(entries).withColumn("ok", new >= top).withColumn("now", F.when(F.col("ok"), new).otherwise(top))
    return own.select("key", "ok", F.col("now.ms").alias("last_ms"), F.col("now.seq").alias("last_seq"))


def ack(pending: DataFrame, ids: DataFrame) -> DataFrame:
    return pending.join(ids, ["key", *ID], "left_anti")


def pending_summary(pending: DataFrame) -> DataFrame:
    at = F.struct(*ID)
    own = pending.groupBy("key", "consumer").agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    return own.select("key", "consumer", "n", F.col("a.ms").alias("first_ms"), F.col("b.ms").alias("last_ms"))


def claim(pending: DataFrame, consumer: str, min_idle_ms: int, now_ms: int, ids: DataFrame | None = None, just_id: bool = False) -> DataFrame:
    """XCLAIM: pending entries idle long enough go to ``consumer``; their count rises unless JUSTID."""
    hit = F.lit(now_ms) - F.col("time_ms") >= min_idle_ms
    rows = pending
    if ids is not None:
        rows = rows.join(ids.select("key", *ID, F.lit(True).alias("__asked")), ["key", *ID], "left")
        hit = hit & F.coalesce(F.col("__asked"), F.lit(False))
    return rows.select(
        "key", *ID, F.when(hit, F.lit(consumer)).otherwise(F.col("consumer")).alias("consumer"), F.when(hit, F.lit(now_ms).cast("long")).otherwise(F.col("time_ms")).alias("time_ms"),
        (F.col("deliveries") + F.when(hit & F.lit(not just_id), 1).otherwise(0)).alias("deliveries"),
    )


def autoclaim(pending: DataFrame, consumer: str, min_idle_ms: int, now_ms: int, start: str, count: int) -> DataFrame:
    """XAUTOCLAIM: of every stream the first ``count`` entries from ``start`` on that are idle long enough."""
    idle = between(pending, start).filter(F.lit(now_ms) - F.col("time_ms") >= min_idle_ms)
    return claim(pending, consumer, min_idle_ms, now_ms, between(idle, count=count).select("key", *ID))
