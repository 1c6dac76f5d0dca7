"""Sessions of tensors and buffers: registries, token rows, caches and byte buffers as tables and logs of commands.

A registry is what a log of creations leaves; token rows are numbered in the order they were stored; a buffer is the last
write of each of its bytes. Everything is an aggregation or a join by session, so all sessions are handled at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The largest vector and buffer, and the formats that pack numbers by 32.
MOST_DIM, MOST_BYTES = 8192, 4 << 20
BLOCK_FORMATS = ("turbo4", "turbo3", "turbo2", "fp8", "mlx4g32")


def settled_format(fmt: Column, dim: Column) -> Column:
    """The format that a session gets: a block format needs whole blocks of 32 numbers, else it is int8."""
    return F.when(fmt.isin(*BLOCK_FORMATS) & (dim % 32 != 0), F.lit("int8")).otherwise(fmt)


def created(log: DataFrame, dims: tuple[str, ...] = ("value_dim",)) -> DataFrame:
    """What a log of creations (session, seq, dims, further columns) leaves: creating a session again changes nothing.

    Dimensions outside 1 to MOST_DIM are refused.
    """
    ok = F.lit(True)
    for d in dims:
        ok = ok & F.col(d).between(1, MOST_DIM)
    rest = [c for c in log.columns if c != "session"]
    first = log.filter(ok).groupBy("session").agg(F.min_by(F.struct(*rest), "seq").alias("first"))
    return first.select("session", "first.*").drop("seq")


def v_create(log: DataFrame) -> DataFrame:
    """V.CREATE: session, value_dim, fmt."""
    return created(log).withColumn("fmt", settled_format(F.col("fmt"), F.col("value_dim")))


def attend_create(log: DataFrame) -> DataFrame:
    """ATTEND.CREATE: keys are always int8; values get their format."""
    own = created(log, ("key_dim", "value_dim"))
    return own.withColumn("kquant", F.lit("int8")).withColumn("vquant", settled_format(F.col("vquant"), F.col("value_dim")))


def prefix_register(log: DataFrame) -> DataFrame:
    """KV.PREFIX.REGISTER of rows (session, seq, value_dim, fmt, hashes): a K and a V session for every namespace.

    Sessions are created once; the table of block hashes, kept beside K, is the last one given.
    """
    sessions = v_create(log.select("session", "seq", "value_dim", "fmt"))
    tables = log.groupBy("session").agg(F.max_by("hashes", "seq").alias("hashes"))
    kind = F.explode(F.array(F.lit("K"), F.lit("V"))).alias("kind")
    both = sessions.join(tables, "session").select("session", kind, "value_dim", "fmt", "hashes")
    return both.withColumn("hashes", F.when(F.col("kind") == "K", F.col("hashes")))


def append_tokens(rows: DataFrame, order: str = "seq") -> DataFrame:
    """ATTEND.STORE: rows get the token numbers after those that their session and layer already have."""
    w = Window.partitionBy("session", "layer").orderBy(order)
    return rows.withColumn("token", (F.row_number().over(w) - 1).cast("long")).drop(order)


def store_heads(rows: DataFrame, heads: int, dim: int) -> DataFrame:
    """ATTEND.PREFIX.STORE of rows (session, layer, store, pos, k, v): the last store of a session's layer replaces all of it.

    One row per head and position, with that head's part of the key and of the value.
    """
    last = Window.partitionBy("session", "layer")
    kept = rows.withColumn("newest", F.max("store").over(last)).filter("store = newest")
    per = kept.select("session", "layer", "pos", "k", "v", F.explode(F.sequence(F.lit(0), F.lit(heads - 1))).alias("head"))
    part = lambda c: F.slice(c, F.col("head") * dim + 1, F.lit(dim))
    return per.select("session", "layer", "head", "pos", part("k").alias("k"), part("v").alias("v"))


def cache_store(log: DataFrame) -> DataFrame:
    """KV.STORE of rows (id, seq, embedding, blob, model, ttl_s, at_ms): the last store of an id, with its lifetime."""
    rest = [c for c in log.columns if c != "id"]
    last = log.groupBy("id").agg(F.max_by(F.struct(*rest), "seq").alias("l")).select("id", "l.*")
    until = F.when(F.col("ttl_s") > 0, F.col("at_ms") + F.col("ttl_s") * 1000)
    return last.withColumn("expire_ms", until.cast("long")).drop("seq", "ttl_s", "at_ms")


def cache_info(cache: DataFrame, now_ms: int) -> DataFrame:
    """KV.INFO: entries by model, those that are live, and bytes of their blobs."""
    live = F.col("expire_ms").isNull() | (F.col("expire_ms") > now_ms)
    return cache.groupBy("model").agg(F.count(F.lit(1)).alias("entries"), F.count_if(live).alias("live"), F.sum(F.octet_length("blob").cast("long")).alias("bytes"))


def token_info(tokens: DataFrame) -> DataFrame:
    """V.INFO, ATTEND.INFO: layers and tokens of every session."""
    return tokens.groupBy("session").agg(F.count_distinct("layer").alias("layers"), F.count(F.lit(1)).alias("tokens"))


def drop_layers(entries: DataFrame, gone: DataFrame) -> DataFrame:
    """SSM.PREFIX.DROP of rows (session, layer): the whole session where no layer is named."""
    whole = gone.filter("layer IS NULL").select("session").distinct()
    return entries.join(whole, "session", "left_anti").join(gone.filter("layer IS NOT NULL"), ["session", "layer"], "left_anti")


def prefix_lookup(prefixes: DataFrame, asked: DataFrame) -> DataFrame:
    """KV.PREFIX.LOOKUP of rows (session, restored): HIT or MISS, and the tokens a hit is credited with.

    ``prefixes`` has (session, tokens); ``restored`` is what the caller says it restored, null to take the prefix's own.
    """
    both = asked.join(prefixes.select("session", "tokens"), "session", "left")
    hit = F.col("tokens").isNotNull()
    credit = F.when(hit, F.coalesce("restored", "tokens")).otherwise(0).cast("long")
    return both.select(*asked.columns, F.when(hit, "HIT").otherwise("MISS").alias("state"), credit.alias("credited"))


def slot_states(slots: DataFrame, warm: int) -> DataFrame:
    """session, layer, state: the ``warm`` slots used last are WARM, the others COLD (slots: session, layer, used)."""
    newest = slots.orderBy(F.col("used").desc(), "session", "layer").limit(warm).select("session", "layer", F.lit("WARM").alias("state"))
    return slots.join(newest, ["session", "layer"], "left").select("session", "layer", "used", F.coalesce("state", F.lit("COLD")).alias("state"))


def slot_lookup(states: DataFrame, asked: DataFrame) -> DataFrame:
    """ATTEND.PREFIX.LOOKUP: HIT, COLD (to be warmed first) or MISS."""
    state = F.when(F.col("state") == "WARM", "HIT").when(F.col("state") == "COLD", "COLD").otherwise("MISS")
    return asked.join(states.select("session", "layer", "state"), ["session", "layer"], "left").select("session", "layer", state.alias("state"))


def slot_warm(slots: DataFrame, session: str, now: int, warm: int) -> DataFrame:
    """KV.PREFIX.WARM: the session's slots are used now, so they are warm and the oldest others are not."""
    used = F.when(F.col("session") == session, F.lit(now)).otherwise(F.col("used"))
    return slot_states(slots.select("session", "layer", used.alias("used")), warm)


def _exists_before() -> Column:
    """Whether a buffer is there before each command of its log: as the last valid ALLOC or FREE before it left it."""
    left = F.when(F.col("op") == "free", F.lit(0)).when(valid_size(F.col("size")), F.lit(1))
    w = Window.partitionBy("session").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.last(left, ignorenulls=True).over(w), F.lit(0))


def valid_size(size: Column) -> Column:
    return size.between(1, MOST_BYTES)


def buffer_replies(log: DataFrame) -> DataFrame:
    """STATE.ALLOC and STATE.FREE of rows (session, seq, op, size, mode): what each command answers.

    ALLOC is 'OK', 'exists' while the session has a buffer, or 'size'; FREE is '1' if it released one, else '0'.
    """
    before = log.withColumn("there", _exists_before())
    free = F.when(F.col("there") == 1, "1").otherwise("0")
    alloc = F.when(~valid_size(F.col("size")), "size").when(F.col("there") == 1, "exists").otherwise("OK")
    return before.withColumn("reply", F.when(F.col("op") == "free", free).otherwise(alloc)).drop("there")


def buffers(log: DataFrame) -> DataFrame:
    """session, size, mode of every buffer that the log leaves: the first valid ALLOC after the last FREE."""
    freed = log.filter("op = 'free'").groupBy("session").agg(F.max("seq").alias("freed"))
    since = log.join(freed, "session", "left").filter((F.col("op") == "alloc") & valid_size(F.col("size")) & (F.col("freed").isNull() | (F.col("seq") > F.col("freed"))))
    return since.groupBy("session").agg(F.min_by(F.struct("size", "mode"), "seq").alias("b")).select("session", "b.size", "b.mode")


def _accepted(size: Column, mode: Column, offset: Column, length: Column) -> Column:
    return (length > 0) & (offset >= 0) & ((mode == "ring") | (offset + length <= size))


def write_replies(own: DataFrame, writes: DataFrame) -> DataFrame:
    """STATE.WRITE of rows (session, seq, offset, data): bytes written, or -1: no buffer, nothing to write, or beyond the
    end of a fixed one. A ring goes round."""
    both = writes.join(own, "session", "left")
    length = F.octet_length("data")
    ok = F.col("size").isNotNull() & _accepted(F.col("size"), F.col("mode"), F.col("offset"), length)
    return both.select("session", "seq", F.when(ok, length).otherwise(-1).cast("int").alias("reply"))


def contents(own: DataFrame, writes: DataFrame) -> DataFrame:
    """session, data (hexadecimal) of every buffer after ordered writes: the last write of each byte, else zero."""
    both = writes.join(own, "session").filter(_accepted(F.col("size"), F.col("mode"), F.col("offset"), F.octet_length("data")))
    each = both.select("session", "size", "seq", "offset", F.explode(F.sequence(F.lit(0), F.octet_length("data") - 1)).alias("i"), F.hex("data").alias("h"))
    byte = F.substring(F.col("h"), F.col("i") * 2 + 1, F.lit(2))
    last = each.groupBy("session", ((F.col("offset") + F.col("i")) % F.col("size")).cast("int").alias("at")).agg(F.max_by(byte, F.struct("seq", "i")).alias("byte"))
    known = last.groupBy("session").agg(F.map_from_entries(F.collect_list(F.struct("at", "byte"))).alias("m"))
    empty = F.map_from_arrays(F.array().cast("array<int>"), F.array().cast("array<string>"))
    every = F.transform(F.sequence(F.lit(0), F.col("size").cast("int") - 1), lambda i: F.coalesce(F.element_at(F.coalesce("m", empty), i), F.lit("00")))
    return own.join(known, "session", "left").select("session", "size", "mode", F.array_join(every, "").alias("data"))


def read_bytes(filled: DataFrame, reads: DataFrame) -> DataFrame:
    """STATE.READ of rows (session, offset, length): the bytes (hexadecimal); null where a fixed buffer ends before."""
    both = reads.join(filled, "session")
    ok = _accepted(F.col("size"), F.col("mode"), F.col("offset"), F.col("length"))
    start = F.col("offset") % F.col("size")
    rounds = F.ceil((start + F.col("length")) / F.col("size")).cast("int")
    part = F.substring(F.repeat("data", rounds), (start * 2 + 1).cast("int"), (F.col("length") * 2).cast("int"))
    return both.select("session", "offset", "length", F.when(ok, part).alias("data"))


def buffer_info(own: DataFrame) -> DataFrame:
    """STATE.INFO: buffers and their bytes by mode."""
    return own.groupBy("mode").agg(F.count(F.lit(1)).alias("buffers"), F.sum(F.col("size").cast("long")).alias("bytes"))
