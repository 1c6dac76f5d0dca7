"""Edge cases that the tables don't have."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.functions import scripts
from keyloom.functions.ranges import glob_regex, lex_between
from keyloom.operators import attention, bitmaps, geo, hashes, keys, lists, search, streams, strings, transactions, vectors, zsets
from keyloom.sources import tables
from keyloom.streaming import groups


def test_zadd_refuses_nan_and_keeps_missing_members(spark):
    z = spark.createDataFrame([("k", "a", 1.0)], "key string, member string, score double")
    new = spark.createDataFrame([("k", "a", 0.5), ("k", "b", 0.1)], "key string, member string, score double")
    out = {r.member: (r.score, r.added, r.changed) for r in zsets.add(z, new, greater=True).collect()}
    assert out == {"a": (1.0, 0, 0), "b": (0.1, 1, 1)}
    with pytest.raises(Exception, match="not a number"):
        zsets.add(z, new.withColumn("score", F.lit(math.nan))).collect()


def test_zunion_turns_nan_to_zero(spark):
    z = spark.createDataFrame([("a", "m", math.inf), ("b", "m", -math.inf)], "key string, member string, score double")
    assert zsets.union(z, ["a", "b"]).first().score == 0.0


def test_rank_ties_go_by_member_bytes(spark):
    z = spark.createDataFrame([("k", m, 1.0) for m in ("b", "a", "ä", "Z")], "key string, member string, score double")
    assert [r.member for r in zsets.range_by_rank(z, 0, -1).orderBy("rank").collect()] == ["Z", "a", "b", "ä"]


def test_lex_bounds(spark):
    df = spark.createDataFrame([(x,) for x in ("a", "aa", "b", "c")], "m string")
    pick = lambda a, b: sorted(r.m for r in df.filter(lex_between(F.col("m"), a, b)).collect())
    assert pick("-", "+") == ["a", "aa", "b", "c"]
    assert pick("(a", "[b") == ["aa", "b"]
    assert pick("+", "-") == []


@pytest.mark.parametrize(("glob", "hit", "miss"), [("h?llo", "hello", "hllo"), ("h[a-c]x", "hbx", "hdx"), ("h[^e]x", "hax", "hex"), ("a\\*b", "a*b", "axb"), ("*", "any\nthing", None)])
def test_glob(spark, glob, hit, miss):
    rows = [(hit,)] + ([(miss,)] if miss else [])
    df = spark.createDataFrame(rows, "v string").filter(F.col("v").rlike(glob_regex(glob)))
    assert [r.v for r in df.collect()] == [hit]


@pytest.mark.parametrize(("start", "end", "clamped", "plain"), [(0, -1, b"This is", b"This is"), (0, 3, b"This", b"This"), (-2, -1, b"is", b"is"), (5, 2, b"", b""), (-100, -99, b"T", b""), (3, 100, b"s is", b"s is")])
def test_byte_slices(spark, start, end, clamped, plain):
    df = spark.createDataFrame([("This is",)], "v string")
    for clamp, wanted in ((True, clamped), (False, plain)):
        assert bytes(df.select(strings.byte_slice(F.col("v"), start, end, clamp).alias("x")).first().x) == wanted


def test_counters_restart_at_set_and_vanish_at_del(spark):
    log = spark.createDataFrame([("a", 1, "incr", 5), ("a", 2, "set", 10), ("a", 3, "incr", -3), ("b", 1, "set", 1), ("b", 2, "del", 0), ("c", 1, "del", 0), ("c", 2, "incr", 4)], "key string, seq long, op string, amount long")
    assert {r.key: r.value for r in strings.counters(log).collect()} == {"a": 7, "c": 4}


def test_lcs():
    assert strings.lcs_length("ohmytext", "mynewtext") == 6
    assert strings.lcs_length("", "x") == 0


def test_expire_conditions(spark):
    df = spark.createDataFrame([(None,), (100,)], "e long")
    got = {c: [r.x for r in df.select(keys.set_deadline(F.col("e"), F.lit(200), c).alias("x")).collect()] for c in ("NX", "XX", "GT", "LT")}
    assert got == {"NX": [200, 100], "XX": [None, 200], "GT": [None, 200], "LT": [200, 100]}


def test_ttl_rounds_to_nearest_second(spark):
    df = spark.createDataFrame([(1499,), (1500,), (None,)], "e long")
    assert [r.x for r in df.select(keys.seconds_left(F.col("e"), 0).alias("x")).collect()] == [1, 2, -1]


def test_list_remove_and_positions(spark):
    rows = spark.createDataFrame([("k", i, v) for i, v in enumerate("abcabca")], "key string, pos long, value string")
    values = lambda df: "".join(r.value for r in df.orderBy("idx").collect())
    assert values(lists.remove(rows, 2, "a")) == "bcbca"
    assert values(lists.remove(rows, -1, "a")) == "abcabc"
    assert values(lists.remove(rows, 0, "a")) == "bcbc"
    assert [r.idx for r in lists.positions(rows, "a", rank=2).collect()] == [3]
    assert sorted(r.idx for r in lists.positions(rows, "a", rank=-1, count=0, maxlen=4).collect()) == [3, 6]


def test_list_fold(spark):
    log = spark.createDataFrame([("k", 1, "rpush", "a"), ("k", 2, "lpush", "b"), ("k", 3, "rpop", None), ("k", 4, "rpush", "c"), ("k", 5, "lpop", None)], "key string, seq long, op string, value string")
    assert [(r.idx, r.value) for r in lists.fold(log).collect()] == [(0, "c")]


def test_first_clear_bit(spark):
    bits = spark.createDataFrame([("ones", i) for i in range(8)] + [("gap", 0), ("gap", 2), ("late", 5)], "key string, pos long")
    assert {r.key: r.pos for r in bitmaps.first_clear(bits).collect()} == {"ones": 8, "gap": 1, "late": 0}


def test_geo_round_trip_and_known_distance(spark):
    points = spark.createDataFrame([("s", "Palermo", 13.361389, 38.115556), ("s", "Catania", 15.087269, 37.502669)], "key string, member string, lon double, lat double")
    p = geo.stored(points).withColumn("hash", geo.geohash(F.col("lon"), F.col("lat"))).collect()
    assert abs(p[0].lon - 13.361389) < 1e-5 and p[0].cell == 3479099956230698 and p[0].hash == "sqc8b49rny0"
    a, b = p
    d = spark.range(1).select(geo.distance(F.lit(a.lon), F.lit(a.lat), F.lit(b.lon), F.lit(b.lat)).alias("d")).first().d
    assert abs(d - 166274.1516) < 0.01


def test_stream_ranges(spark):
    e = streams.assign_ids(spark.createDataFrame([("s", 5, i) for i in range(3)] + [("s", 7, 3)], "key string, ms long, n long"), F.col("ms"), F.col("n"))
    ids = lambda df: sorted((int(r.ms), int(r.seq)) for r in df.collect())
    assert ids(streams.between(e, "(5-0", "5")) == [(5, 1), (5, 2)]
    assert ids(streams.between(e, count=1, rev=True)) == [(7, 0)]
    assert ids(streams.between(e, count=0)) == []


def test_filter_clauses(spark):
    df = spark.createDataFrame([(1, "red, Blue", "5"), (2, "green", "x"), (3, "blue", None)], "doc_id int, color string, price string")
    assert [r.doc_id for r in df.filter(search.filter_clause("@color:{BLUE|red} @price:[(4 +inf]", {"color"})).collect()] == [1]
    for bad in ("-@color:{red}", "@color:{red} | @price:[1 2]"):
        with pytest.raises(ValueError):
            search.filter_clause(bad, {"color"})


def test_bm25_tokens(spark):
    df = spark.createDataFrame([("--fa-window, (sliding-window.) It's ---",)], "text string")
    assert df.select(search.tokens(F.col("text")).alias("t")).first().t == ["fa-window", "sliding-window", "it", "s"]


def test_attention_matches_numpy(spark):
    rng = np.random.default_rng(0)
    k, v, q = rng.normal(size=(50, 8)), rng.normal(size=(50, 3)), rng.normal(size=(2, 8))
    rows = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(k, v, strict=True)], "k array<double>, v array<double>").repartition(3)
    asked = spark.createDataFrame([(f"q{i}", x.tolist()) for i, x in enumerate(q)], "query string, q array<double>")
    z = q @ k.T / np.sqrt(8)
    w = np.exp(z - z.max(1, keepdims=True))
    wanted = (w / w.sum(1, keepdims=True)) @ v
    for r in attention.attend(rows, asked).collect():
        i = int(r.query[1:])
        assert np.allclose(r.out, wanted[i]) and abs(r.lse - (np.log(w[i].sum()) + z[i].max())) < 1e-9


def test_snapshot_round_trip_and_compaction(spark, tmp_path):
    z = spark.createDataFrame([("k", "a", 1.0)], "key string, member string, score double")
    tables.save({"kv_zset": z}, str(tmp_path / "snap"), buckets=4)
    assert tables.restore(spark, str(tmp_path / "snap"), ["kv_zset"])["kv_zset"].collect() == z.collect()
    log = spark.createDataFrame([(1, "SET", "a"), (2, "APPEND", "a"), (3, "SET", "a"), (4, "APPEND", "a"), (5, "SET", "b"), (6, "DEL", "b"), (7, "APPEND", "c")], "seq long, cmd string, key string").withColumn("args", F.array(F.lit(b"x")))
    assert sorted(r.seq for r in tables.compact(log).collect()) == [3, 4, 7]


def test_consumer_group_stream_hands_out_every_entry_once(spark, tmp_path):
    rows = spark.createDataFrame([("s", 1, i) for i in range(5)] + [("t", 2, 0)], "key string, ms long, seq long")
    rows.write.parquet(str(tmp_path / "in"))
    read = groups.follow(spark, str(tmp_path / "in"), "key string, ms long, seq long")
    run = groups.consumers(read, ["c0", "c1"]).writeStream.format("memory").queryName("pending").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    run.processAllAvailable()
    run.stop()
    got = {(r.key, r.seq): r.consumer for r in spark.table("pending").collect()}
    assert got == {("s", 0): "c0", ("s", 1): "c1", ("s", 2): "c0", ("s", 3): "c1", ("s", 4): "c0", ("t", 0): "c0"}


def test_searches_go_on_past_one_block_of_queries(spark, monkeypatch):
    from pyspark.sql import functions as F

    from keyloom.operators import attention as A
    from keyloom.operators import vectors as V

    rows = spark.createDataFrame([(f"v{k}", [float(k), float(k * k % 7)]) for k in range(12)], "element string, embedding array<float>").repartition(2)
    queries = rows.select(F.col("element").alias("query"), "embedding")
    found = lambda: sorted((r.query, r.element, r.rank) for r in V.nearest(rows, queries, 3, "l2").collect())
    read = lambda: sorted((r.query, round(r.lse, 9)) for r in A.attend(rows.select(F.col("embedding").alias("k"), F.col("embedding").alias("v")), queries.select("query", F.col("embedding").alias("q"))).collect())
    whole = found(), read()
    assert len(whole[0]) == 36 and len(whole[1]) == 12
    monkeypatch.setattr(V, "QUERY_BYTES", 80)
    assert (found(), read()) == whole
    assert V.nearest(rows, queries.limit(0), 3).count() == 0


def test_catalog_lists_nothing_that_is_registered():
    from keyloom import plans
    from keyloom.plans import catalog, registry

    plans.load()
    names = {n.strip().lower().replace(".", "_") for k in catalog.NOT_BUILT for n in k.split(",")}
    assert not names & registry.QUERIES.keys()


def test_nx_passes_over_a_nan_for_a_member_that_is_there(spark):
    z = spark.createDataFrame([("k", "a", 1.0)], "key string, member string, score double")
    nan = spark.createDataFrame([("k", "a", math.nan)], "key string, member string, score double")
    assert [(r.score, r.changed) for r in zsets.add(z, nan, only_new=True).collect()] == [(1.0, 0)]
    other = nan.withColumn("member", F.lit("b"))
    assert [(r.member, r.score) for r in zsets.add(z, other, only_old=True).collect()] == [("a", 1.0)]
    with pytest.raises(Exception, match="not a number"):
        zsets.add(z, nan, only_old=True).collect()
    with pytest.raises(Exception, match="not a number"):
        zsets.add(z, other, only_new=True).collect()


def test_expired_fields_show_nowhere(spark):
    rows = [("k", "gone", "1", 10), ("k", "now", "2", 20), ("k", "later", "3", 30), ("k", "always", "4", None), ("x", "gone", "5", 1)]
    h = hashes.live(spark.createDataFrame(rows, "key string, field string, value string, field_expire_ms long"), 20)
    assert {r.key: r.fields for r in hashes.as_map(h).collect()} == {"k": {"always": "4", "later": "3"}}
    by = spark.createDataFrame([("k", "gone", 7), ("k", "later", 7)], "key string, field string, delta long")
    assert {(r.field, r.value) for r in hashes.increase(h, by).collect()} == {("gone", 7), ("later", 10)}
    new = spark.createDataFrame([("k", "gone", 1, "n"), ("k", "later", 1, "n")], "key string, field string, seq long, value string")
    got = {r.field: (r.value, r.added) for r in hashes.upsert(h, new, only_new=True).collect()}
    assert got == {"gone": ("n", 1), "later": ("3", 0), "always": ("4", 0)}
    assert {r.gone for r in hashes.mget(h, ["gone"]).collect()} == {None}


def test_geo_plans_stay_small(spark):
    raw = spark.range(50).selectExpr("'k' AS key", "concat('m', id) AS member", "id - 28.0 AS lon", "id * 3.0 - 75 AS lat")
    p = geo.stored(raw)
    for df in (geo.within(p, 10.0, 40.0, 3000.0, "KM"), geo.within_box(p, 10.0, 40.0, 5000.0, 3000.0, "KM"), geo.around_members(p, p.select("key", "member"), 900.0, "KM")):
        assert len(df._jdf.queryExecution().optimizedPlan().toString()) < 50_000 and df.count() > 0
    lon, lat = geo.decode(F.col("cell"))
    assert all(abs(r.a - r.lon) < 1e-9 and abs(r.b - r.lat) < 1e-9 for r in p.select("lon", "lat", lon.alias("a"), lat.alias("b")).collect())


def test_geohash_of_a_known_place(spark):
    hash_ = geo.geohash(F.lit(13.361389), F.lit(38.115556)).alias("h")
    assert spark.range(1).select(hash_).first().h == "sqc8b49rny0"


@pytest.mark.parametrize("policy", ["allkeys-lru", "allkeys-lfu", "volatile-lru", "volatile-ttl", "allkeys-random"])
@pytest.mark.parametrize("keep", [0, 1, 70, 133, 400])
def test_evict_is_exact(spark, policy, keep):
    rows = [(f"k{i}", None if i % 3 == 0 else i * 7 % 50, i * 31 % 97, i % 5) for i in range(200)]
    got = {r.key for r in keys.evict(spark.createDataFrame(rows, "key string, expire_ms long, accessed long, hits long"), keep, policy).collect()}
    md5 = lambda k: hashlib.md5(k.encode()).hexdigest()
    worth = {"lru": lambda r: (-r[2], r[0]), "lfu": lambda r: (-r[3], r[0]), "ttl": lambda r: (r[1] is not None, -(r[1] or 0), r[0]), "random": lambda r: (md5(r[0]),)}[policy.split("-")[1]]
    order = sorted(rows, key=lambda r: ((r[1] is not None) if policy.startswith("volatile") else 0, worth(r)))
    assert got == {r[0] for r in order[:keep]}


def test_bitop_not_of_a_long_string(spark, monkeypatch):
    monkeypatch.setattr(bitmaps, "BLOCK", 16)
    bits = spark.createDataFrame([("k", p) for p in (0, 15, 16, 77)], "key string, pos long")
    assert {r.pos for r in bitmaps.invert(bits, "k").collect()} == set(range(80)) - {0, 15, 16, 77}


def test_nearest_keeps_a_running_top(spark, monkeypatch):
    monkeypatch.setattr(vectors, "CHUNK", 7)
    rng = np.random.default_rng(4)
    x = rng.integers(0, 3, (90, 2)).astype(float)  # many ties
    rows = spark.createDataFrame([(f"e{i:02d}", v.tolist()) for i, v in enumerate(x)], "element string, embedding array<double>").coalesce(1)
    queries = rows.limit(3).withColumnRenamed("element", "query")
    for k in (1, 5, 200):
        got = {}
        for r in vectors.nearest(rows, queries, k, "l2").orderBy("rank").collect():
            got.setdefault(r.query, []).append(r.element)
        for q in range(3):
            d = ((x - x[q]) ** 2).sum(1)
            assert got[f"e{q:02d}"] == [f"e{i:02d}" for i in sorted(range(90), key=lambda i: (d[i], i))[:k]]


def test_inverted_file_of_grouped_vectors_needs_few_cells(spark):
    rng = np.random.default_rng(5)
    centers = rng.normal(0, 10, (20, 8))
    x = centers[rng.integers(0, 20, 600)] + rng.normal(0, 0.3, (600, 8))
    rows = spark.createDataFrame([(f"e{i}", v.tolist()) for i, v in enumerate(x)], "element string, embedding array<double>")
    index = vectors.InvertedFile.fit(rows)
    assert index.probes < len(index.centroids) / 2
    queries = rows.limit(30).withColumnRenamed("element", "query")
    pairs = lambda df: {(r.query, r.element) for r in df.collect()}
    exact = pairs(vectors.nearest(rows, queries, 10, "l2"))
    assert len(exact & pairs(index.search(rows, queries, 10))) >= 0.95 * len(exact)


def test_libraries_of_functions(spark):
    held = scripts.Libraries(spark)
    held.load("a", [scripts.Function("kl_plus", "x INT", "INT", "x + 1", True), scripts.Function("kl_minus", "x INT", "INT", "x - 1")])
    df = spark.range(1).selectExpr("CAST(5 AS INT) AS x")
    assert df.select(held.call("kl_plus", "x", reads_only=True).alias("v")).first().v == 6
    assert df.select(held.call("kl_minus", "x").alias("v")).first().v == 4
    with pytest.raises(ValueError, match="may write"):
        held.call("kl_minus", "x", reads_only=True)
    with pytest.raises(ValueError, match="already"):
        held.load("a", [])
    with pytest.raises(ValueError, match="already"):
        held.load("b", [scripts.Function("kl_plus", "x INT", "INT", "x")])
    dumped = held.dump()
    with pytest.raises(ValueError, match="already"):
        held.restore(dumped)
    held.load("a", [scripts.Function("kl_plus", "x INT", "INT", "x + 100")], replace=True)
    assert df.select(held.call("kl_plus", "x").alias("v")).first().v == 105
    held.restore(dumped, "flush")
    assert df.select(held.call("kl_plus", "x").alias("v")).first().v == 6
    held.delete("a")
    with pytest.raises(KeyError):
        held.call("kl_plus", "x")
    cache = scripts.Scripts()
    with pytest.raises(KeyError, match="NOSCRIPT"):
        cache.evalsha("0" * 40)
    assert df.select(cache.evalsha(cache.load("x * 2")).alias("v")).first().v == 10


def test_index_catalog(spark):
    held = search.Catalog()
    index = held.create(search.Index("i", ("a:",), {"n": "NUMERIC", "v": "VECTOR"}))
    h = spark.createDataFrame([("a:1", "n", "2.5"), ("a:1", "v", "[1, 2]"), ("a:2", "n", "x"), ("b:1", "n", "1")], "key string, field string, value string")
    assert {r.key: (r.n, r.v) for r in index.rows(h).collect()} == {"a:1": (2.5, [1.0, 2.0]), "a:2": (None, None)}
    with pytest.raises(ValueError, match="exists"):
        held.create(index)
    with pytest.raises(ValueError, match="types"):
        search.Index("j", (), {"n": "GEO"})
    assert {r.key for r in held.drop("i", h, documents=True).collect()} == {"b:1"} and held.list() == []
    with pytest.raises(KeyError):
        held.drop("i", h)


def test_a_version_counts_from_its_marker_on(spark, tmp_path):
    path = str(tmp_path / "store")
    table = spark.createDataFrame([("k", bytearray(b"1"), None)], tables.SCHEMAS["kv_string"])
    assert tables.versions(spark, path) == [] and tables.last_save(spark, path) == 0
    with pytest.raises(FileNotFoundError):
        tables.current(spark, path, ["kv_string"])
    first = tables.commit({"kv_string": table}, path)
    tables.save({"kv_string": table.limit(0)}, f"{path}/v99999999999999999999-dead")  # a writer that died
    assert tables.versions(spark, path) == [first]
    second = tables.commit({"kv_string": table.unionAll(table)}, path, buckets=2)
    assert tables.current(spark, path, ["kv_string"])["kv_string"].count() == 2 and tables.last_save(spark, path) > 0
    tables.discard_old(spark, path)
    assert tables.versions(spark, path) == [second]


def test_aborted_batches(spark):
    c = spark.createDataFrame([(1, 1, True), (2, 2, False), (2, 3, True), (3, 4, True), (4, 5, True)], "batch long, seq long, ok boolean")
    watches = spark.createDataFrame([(1, "a", 1), (3, "a", 2), (2, "a", 2), (4, "new", 0)], "batch long, key string, seen int")
    versions = spark.createDataFrame([("a", 1)], "key string, version int")
    assert {(r.batch, r.reason) for r in transactions.aborted(c, watches, versions).collect()} == {(2, "execabort"), (3, "nil")}
    assert {r.seq for r in transactions.executed(c, watches, versions).collect()} == {1, 5}
    assert {r.seq for r in transactions.executed(c).collect()} == {1, 4, 5}


def test_reads_of_groups_hand_out_every_entry_once(spark):
    entries = spark.createDataFrame([("s", k, 0) for k in range(1, 21)], "key string, ms long, seq long")
    reads = spark.createDataFrame([("s", 1, "a", 5, 10), ("s", 2, "b", 0, 20), ("s", 3, "c", 1_000_000_000, 30)], "key string, turn long, consumer string, count long, time_ms long")
    got = {r.ms: (r.consumer, r.time_ms) for r in streams.deliver(entries, reads).collect()}
    assert got == {k: ("a", 10) if k <= 5 else ("c", 30) for k in range(1, 21)}


def test_trim_options(spark):
    ids = lambda df, *names: df.withColumns({c: F.col(c).cast("decimal(20,0)") for c in names})
    entries = ids(spark.createDataFrame([("s", k, 0) for k in range(1, 11)], "key string, ms long, seq long"), "ms", "seq")
    groups_ = ids(spark.createDataFrame([("s", "g", 6, 0)], "key string, `group` string, last_ms long, last_seq long"), "last_ms", "last_seq")
    pending = ids(spark.createDataFrame([("s", "g", k, 0, "c", 0, 1) for k in (2, 5)], "key string, `group` string, ms long, seq long, consumer string, time_ms long, deliveries long"), "ms", "seq")
    left = lambda **kw: [int(r.ms) for r in streams.trimmed(entries, **kw)[0].orderBy("ms").collect()]
    assert left(maxlen=3) == [8, 9, 10] and left(maxlen=0) == [] and left(maxlen=99) == list(range(1, 11))
    assert left(maxlen=3, approximate=True, limit=2) == list(range(3, 11))
    assert left(maxlen=3, strategy="ACKED", groups=groups_, pending=pending) == [2, 5, 7, 8, 9, 10]
    assert left(minid="5", strategy="ACKED", groups=groups_, pending=pending) == [2, 5, 6, 7, 8, 9, 10]
    assert [int(r.ms) for r in streams.trimmed(entries, minid="4", strategy="DELREF", pending=pending)[1].collect()] == [5]
    with pytest.raises(ValueError, match="LIMIT"):
        streams.trimmed(entries, maxlen=3, limit=2)
