"""Every registered query that has SQL, against DuckDB on the smallest tables; the others must run."""

from __future__ import annotations

import math
import os

import duckdb
import pytest

from keyloom import plans
from keyloom.plans import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
plans.load()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{DATA}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.8g}")
    if type(v).__name__ == "Decimal":
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(map(norm, v))
    return v


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.bound()[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(norm(r[c]) for c in columns)) for r in df.collect())
    if name not in registry.ORACLES:
        return
    got = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    wanted = sorted(repr(tuple(norm(dict(zip(names, r, strict=True))[c]) for c in columns)) for r in got.fetchall())
    assert rows == wanted


EVERY20 = sorted(n for n in registry.QUERIES if n.endswith("_every20"))


def test_searches_have_their_whole_query_set():
    """Every search that asks for a few rows is there over every 20th row as well, against all rows."""
    few = ["vsim", "vsim_epsilon", "knn_l2", "knn_cosine", "attend_query", "kv_fetch", "semantic_cache_get", "georadiusbymember", "georadiusbymember_ro"]
    few += ["attend_prefix_query", "attend_prefix_window", "attend_prefix_query_fused", "attend_prefix_query_sparse", "attend_prefix_query_sparse_auto", "attend_prefix_query_sparse_auto_fused"]
    assert EVERY20 == sorted(f"{n}_every20" for n in few)


@pytest.mark.parametrize("name", [n for n in EVERY20 if n.startswith(("vsim_every", "knn", "attend_prefix"))])
def test_every_20th_vector_is_asked(spark, name):
    asked = {f"v{r.vec_id}" for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect() if r.vec_id % 20 == 0}
    assert {r.query for r in registry.bound()[name](spark, DATA).select("query").collect()} == asked


@pytest.mark.parametrize("name", ["zrank_all", "zrevrank_all", "getbit_all", "kv_prefix_longest_all"])
def test_lookups_ask_for_the_whole_table(spark, name):
    n = spark.read.parquet(f"{DATA}/customer.parquet").count()
    keys = spark.read.parquet(f"{DATA}/events.parquet").select("event_type").distinct().count() if name == "getbit_all" else 1
    assert registry.bound()[name](spark, DATA).count() == n * keys
