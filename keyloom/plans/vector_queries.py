"""Vector set and nearest neighbour queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from keyloom.operators import vectors as V
from keyloom.plans.registry import EVERY, query, search

DOT = "list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
L2 = "pow(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 2)"
PAIRS = "vset a JOIN vset b ON a.vec_id < 5"


def asked(t, which):
    return t.vset.filter(which).select(F.col("element").alias("query"), "embedding")


def top(sql, order, k):
    return f"SELECT query, element, score FROM (SELECT a.element AS query, b.element AS element, round({sql}, 6) AS score, row_number() OVER (PARTITION BY a.element ORDER BY round({sql}, 12) {order}, b.element) AS n FROM {PAIRS}) WHERE n <= {k}"


def shown(df):
    return df.select("query", "element", F.round("score", 6).alias("score"))


@search("vsim", top(f"(1 + {COS}) / 2", "DESC", 10), "vec_id < 5")
def vsim(t, which):
    return shown(V.nearest(t.vset, asked(t, which), 10))


@search("vsim_epsilon", f"SELECT * FROM ({top(f'(1 + {COS}) / 2', 'DESC', 20)}) WHERE 1 - score <= 0.35", "vec_id < 5")
def vsim_epsilon(t, which):
    return shown(V.nearest(t.vset, asked(t, which), 20)).filter("1 - score <= 0.35")


@search("knn_l2", top(L2, "", 8), "vec_id < 5")
def knn_l2(t, which):
    return shown(V.nearest(t.vset, asked(t, which), 8, "l2"))


@search("knn_cosine", top(f"1 - {COS}", "", 8), "vec_id < 5")
def knn_cosine(t, which):
    return shown(V.nearest(t.vset, asked(t, which), 8, "cos_dist"))


@query("vcard", "SELECT count(*) AS n FROM vset")
def vcard(t):
    return t.vset.agg(F.count(F.lit(1)).alias("n"))


@query("vdim", "SELECT max(len(embedding))::INTEGER AS dim FROM vset")
def vdim(t):
    return t.vset.agg(F.max(F.size("embedding")).alias("dim"))


@query("vinfo", "SELECT count(*) AS size, min(len(embedding))::INTEGER AS dim, count(DISTINCT label) AS labels FROM vset")
def vinfo(t):
    return t.vset.agg(F.count(F.lit(1)).alias("size"), F.min(F.size("embedding")).alias("dim"), F.count_distinct("label").alias("labels"))


@query("vadd", "SELECT element, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM vset")
def vadd(t):
    return V.unit_rows(t.vset).select("element", F.round("norm", 6).alias("norm"), F.round(F.get("unit", F.lit(0)), 6).alias("first"))


@query("vemb", "SELECT element, round(embedding[3]::DOUBLE, 5) AS third FROM vset")
def vemb(t):
    return V.restored(V.unit_rows(t.vset)).select("element", F.round(F.get("vector", F.lit(2)), 5).alias("third"))


@query("vismember", "SELECT element FROM vset WHERE element IN ('v1', 'v2', 'nope')")
def vismember(t):
    return t.vset.filter(F.col("element").isin("v1", "v2", "nope")).select("element")


@query("vrem", "SELECT element FROM vset WHERE label <> 3")
def vrem(t):
    return t.vset.join(t.vset.filter("label = 3").select("element"), "element", "left_anti").select("element")


@query("vsetattr", "SELECT element, '{\"label\":' || label || '}' AS attr FROM vset")
def vsetattr(t):
    return t.vset.select("element", F.to_json(F.struct("label")).alias("attr"))


@query("vgetattr", "SELECT element, label::VARCHAR AS label FROM vset")
def vgetattr(t):
    return vsetattr(t).select("element", F.get_json_object("attr", "$.label").alias("label"))


@query("vrandmember", "SELECT element FROM vset ORDER BY md5(element), element LIMIT 12")
def vrandmember(t):
    return t.vset.select("element").orderBy(F.md5(F.col("element").cast("binary")), "element").limit(12)


@query("vrange", "SELECT element FROM vset WHERE element >= 'v1' AND element < 'v3' ORDER BY element LIMIT 30")
def vrange(t):
    return t.vset.filter("element >= 'v1' AND element < 'v3'").select("element").orderBy("element").limit(30)


#: In SQL, int8 over the mean and 8 standard deviations on either side.
_INT8 = "m AS (SELECT element, embedding::DOUBLE[] AS x, list_avg(embedding::DOUBLE[]) AS mean FROM vset), d AS (SELECT *, sqrt(list_sum(list_transform(x, lambda v: (v - mean) * (v - mean))) / len(x)) AS dev FROM m)"


@query("quantise_int8", f"WITH {_INT8} SELECT element, array_to_string(list_transform(x, lambda v: CASE WHEN dev > 0 THEN greatest(-127.0::DOUBLE, least(127.0::DOUBLE, round((v - (mean - 8 * dev)) / (16 * dev) * 254 - 127))) ELSE 0.0 END)::TINYINT[], ',') AS q FROM d")
def quantise_int8(t):
    return t.vset.select("element", F.array_join(V.quantise_int8("embedding").cast("array<string>"), ",").alias("q"))


def approximate(t):
    index = V.InvertedFile.fit(t.vset)
    return index, index.search(t.vset, t.vset.filter(EVERY).select(F.col("element").alias("query"), "embedding"), 10)


@query("ann_search")
def ann_search(t):
    """The ten nearest by an inverted file, for every 20th vector among all; ``ann_recall`` holds it against the exact answer."""
    return approximate(t)[1].select("query", "element", F.round("score", 6).alias("score"))


@query("ann_recall", "SELECT true AS enough")
def ann_recall(t):
    """Whether ``ann_search`` finds 95 % of the exact ten nearest or more."""
    found = approximate(t)[1].select("query", "element").withColumn("hit", F.lit(1))
    exact = V.nearest(t.vset, t.vset.filter(EVERY).select(F.col("element").alias("query"), "embedding"), 10, "l2").select("query", "element")
    hits = exact.join(found, ["query", "element"], "left")
    return hits.agg((F.count("hit") / F.count(F.lit(1)) >= V.RECALL).alias("enough"))
