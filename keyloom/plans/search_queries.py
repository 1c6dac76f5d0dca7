"""Search index queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import hashes as H
from keyloom.operators import search as S
from keyloom.operators import vectors as V
from keyloom.plans.registry import NOW_MS, query

TERMS = "thened wh reing"
TOK = r"""tk AS (SELECT doc_id, list_filter(list_transform(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x20"''`()\[\]{}<>|\\,;:!?]+'), lambda x: regexp_replace(x, '^[-._+=*/&%@#~$^]+|[-._+=*/&%@#~$^]+$', '', 'g')), lambda x: x <> '') AS t FROM docs)"""
BM = (
    TOK
    + ", c AS (SELECT doc_id, len(t) AS dl, "
    + ", ".join(f"len(list_filter(t, lambda x: x = '{w}')) AS tf{i}" for i, w in enumerate(TERMS.split()))
    + " FROM tk), s AS (SELECT count(*) AS n, avg(dl::DOUBLE) AS avgdl, "
    + ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END)::BIGINT AS df{i}" for i in range(3))
    + " FROM c), b AS (SELECT doc_id, "
    + " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * (1.2::DOUBLE + 1) / (tf{i} + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * greatest(dl, 1) / avgdl)) ELSE 0.0 END" for i in range(3))
    + " AS score FROM c, s WHERE tf0 > 0 OR tf1 > 0 OR tf2 > 0)"
)
BEST = "(SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) - 1 AS rank FROM b)"


def shown(df):
    return df.select("doc_id", F.round("score", 6).alias("score"))


@query("ft_search_bm25", f"WITH {BM} SELECT doc_id, round(score, 6) AS score FROM {BEST} WHERE rank < 20")
def ft_search_bm25(t):
    return shown(S.top(S.bm25(t.docs, TERMS), 20))


@query("ft_searchtext", f"WITH {BM} SELECT doc_id, round(score, 6) AS score FROM b")
def ft_searchtext(t):
    return shown(S.bm25(t.docs, TERMS))


_VEC = "q AS (SELECT embedding AS e FROM vset WHERE vec_id = 0), v AS (SELECT vec_id AS doc_id, row_number() OVER (ORDER BY round(pow(list_distance(embedding::DOUBLE[], e::DOUBLE[]), 2), 12), vec_id) - 1 AS rank FROM vset, q)"


def vector_leg(t, k):
    q = t.vset.filter("vec_id = 0").select(F.lit("q").alias("query"), "embedding")
    return V.nearest(t.vset, q, k, "l2", element="vec_id").select(F.col("element").cast("long").alias("doc_id"), "rank")


def hybrid(alpha):
    a = f"{alpha}::DOUBLE"
    return f"WITH {BM}, {_VEC}, tl AS (SELECT doc_id, rank AS rt FROM {BEST} WHERE rank < 40), vl AS (SELECT doc_id, rank AS rv FROM v WHERE rank < 40), f AS (SELECT doc_id, coalesce((1 - {a}) / (60.0::DOUBLE + rv), 0.0) + coalesce({a} / (60.0::DOUBLE + rt), 0.0) AS score FROM vl FULL JOIN tl USING (doc_id)) SELECT doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (ORDER BY round(score, 12) DESC, doc_id) AS n FROM f) WHERE n <= 10"


@query("ft_hybrid", hybrid(0.7))
def ft_hybrid(t):
    return shown(S.fuse(vector_leg(t, 10 * S.LEGS), S.top(S.bm25(t.docs, TERMS), 10 * S.LEGS), 10, 0.7))


@query("ft_search_hybrid", hybrid(0.5))
def ft_search_hybrid(t):
    return shown(S.fuse(vector_leg(t, 10 * S.LEGS), S.top(S.bm25(t.docs, TERMS), 10 * S.LEGS), 10))


_KNN = "SELECT vec_id, round(pow(list_distance(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM vset WHERE vec_id = 0)), 2), 6) AS dist FROM vset WHERE label IN (1, 2) AND vec_id >= 50 AND vec_id < 400"


@query("ft_search_knn", f"SELECT * FROM ({_KNN}) ORDER BY dist, vec_id LIMIT 10")
def ft_search_knn(t):
    rows = t.vset.filter(S.filter_clause("@label:{1|2} @vec_id:[50 (400]", {"label"}))
    q = t.vset.filter("vec_id = 0").select(F.lit("q").alias("query"), "embedding")
    return V.nearest(rows, q, 10, "l2", element="vec_id").select(F.col("element").cast("long").alias("vec_id"), F.round("score", 6).alias("dist"))


@query("ft_search_sortby", "SELECT doc_id, price FROM (SELECT c_custkey AS doc_id, CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS price FROM customer) ORDER BY price IS NULL, price DESC, doc_id DESC LIMIT 25")
def ft_search_sortby(t):
    rows = t.customer.selectExpr("c_custkey AS doc_id", "CASE WHEN c_custkey % 4 = 0 THEN NULL ELSE c_nationkey END AS price")
    return S.sort_by(rows, "price", descending=True).limit(25)


@query("ft_search_tags", "SELECT c_custkey AS doc_id FROM customer WHERE lower(c_mktsegment) IN ('building', 'machinery')")
def ft_search_tags(t):
    tags = F.concat(F.lit(" x ; "), "c_mktsegment", F.lit(" "))
    return t.customer.filter(S.tag_match(tags, ["Building", "machinery"], ";")).select(F.col("c_custkey").alias("doc_id"))


CUSTOMERS = S.Index("customers", ("cust:1", "cust:2"), {"name": "TEXT", "segment": "TAG", "nation": "NUMERIC", "missing": "NUMERIC"})
_INDEX = f"i AS (SELECT key, max(CASE WHEN field = 'name' THEN value END) AS name, max(CASE WHEN field = 'segment' THEN value END) AS segment, max(CASE WHEN field = 'nation' THEN value END)::DOUBLE AS nation FROM kv_hash WHERE (key LIKE 'cust:1%' OR key LIKE 'cust:2%') AND (field_expire_ms IS NULL OR field_expire_ms > {NOW_MS}) GROUP BY key)"


def hashes(t):
    return H.live(t.kv_hash, NOW_MS)


@query("ft_create", f"WITH {_INDEX} SELECT key, name, segment, nation, NULL::DOUBLE AS missing FROM i")
def ft_create(t):
    """The rows of a new index over what is stored already."""
    return S.Catalog().create(CUSTOMERS).rows(hashes(t))


@query("ft_index_info", f"WITH {_INDEX} SELECT count(*) AS docs, count(name) AS name, count(segment) AS segment, count(nation) AS nation, 0 AS missing FROM i")
def ft_index_info(t):
    return CUSTOMERS.info(hashes(t))


@query("ft_dropindex", f"SELECT key, field, value FROM kv_hash WHERE field_expire_ms IS NULL OR field_expire_ms > {NOW_MS}")
def ft_dropindex(t):
    held = S.Catalog()
    held.create(CUSTOMERS)
    return held.drop("customers", hashes(t)).select("key", "field", "value")


@query("ft_dropindex_dd", f"SELECT key, field, value FROM kv_hash WHERE (field_expire_ms IS NULL OR field_expire_ms > {NOW_MS}) AND key NOT LIKE 'cust:1%' AND key NOT LIKE 'cust:2%'")
def ft_dropindex_dd(t):
    held = S.Catalog()
    held.create(CUSTOMERS)
    return held.drop("customers", hashes(t), documents=True).select("key", "field", "value")


@query("ft_list", "SELECT * FROM (VALUES ('a'), ('customers')) AS v(name)")
def ft_list(t):
    held = S.Catalog()
    for index in (CUSTOMERS, S.Index("b", (), {"x": "TAG"}), S.Index("a", (), {"x": "TAG"})):
        held.create(index)
    held.drop("b", hashes(t))
    return t.spark.createDataFrame([(n,) for n in held.list()], "name string")


_PAGE = f"WITH {_INDEX} SELECT {{}} FROM i WHERE segment = 'BUILDING' AND nation BETWEEN 3 AND 20 ORDER BY nation DESC, key LIMIT 12 OFFSET 4"


def page(t, fields):
    rows = CUSTOMERS.rows(hashes(t)).filter(S.filter_clause("@segment:{building} @nation:[3 20]", {"segment"}))
    return S.page(rows, [F.col("nation").desc()], 4, 12, fields)


@query("ft_search_return", _PAGE.format("key, name, nation"))
def ft_search_return(t):
    return page(t, ["name", "nation"])


@query("ft_search_nocontent", _PAGE.format("key"))
def ft_search_nocontent(t):
    return page(t, [])


@query("ft_optimize", f"WITH {TOK} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS n FROM (SELECT doc_id, unnest(t) AS term FROM tk) GROUP BY term")
def ft_optimize(t):
    return S.postings(t.docs).groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("n"))


@query("ft_addtext", f"WITH {TOK} SELECT doc_id, len(t)::INTEGER AS dl FROM tk")
def ft_addtext(t):
    return t.docs.select("doc_id", F.size(S.tokens(F.col("text"))).alias("dl"))


@query("ft_info", f"WITH {TOK} SELECT count(*) AS docs, round(avg(len(t)), 6) AS avgdl FROM tk")
def ft_info(t):
    return t.docs.select(F.size(S.tokens(F.col("text"))).alias("dl")).agg(F.count(F.lit(1)).alias("docs"), F.round(F.avg("dl"), 6).alias("avgdl"))
