"""Mixing sources to target weights with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import column, materialise, text_of, words_of

#: Weights of the sources in code point order, repeating; a source is repeated at most LIMIT times.
WEIGHTS, LIMIT = (5, 2, 1), 3
#: Sources up to this number are broadcast to the documents; more are joined by a shuffle.
BROADCAST_SOURCES = 20_000
SEED = "mix-1"


def doc_size() -> Column:
    return F.size(words_of(text_of())).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """source, source_size, target: targets by weight, at most LIMIT times the size, the excess reshared by weight.

    The reshare has a closed form: in the order of cap by weight, the sources whose cap stays below their share of
    what is left are the capped ones. ``sizes`` has a row per source (pre-aggregated), so one ordered window is enough.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.lit(float(WEIGHTS[-1]))
    for k in range(len(WEIGHTS) - 2, -1, -1):
        weight = F.when(F.col("k") == k, F.lit(float(WEIGHTS[k]))).otherwise(weight)
    cap = (F.col("source_size") * LIMIT).cast("double")
    named = sizes.withColumn("k", (F.row_number().over(by_name) - 1) % len(WEIGHTS)).withColumn("w", weight).withColumn("cap", cap)
    order = Window.orderBy((F.col("cap") / F.col("w")).asc(), F.col("source").asc_nulls_last())
    before, rest, every = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing), order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    placed = named.select(
        "source", "source_size", "w", "cap",
        F.sum("source_size").over(every).cast("double").alias("total"),
        F.coalesce(F.sum("cap").over(before), F.lit(0.0)).alias("capped_before"),
        F.sum("w").over(rest).alias("w_rest"),
    ).withColumn("full", F.col("cap") * F.col("w_rest") <= (F.col("total") - F.col("capped_before")) * F.col("w"))
    left = F.col("total") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0.0))
    w_left = F.sum(F.when(~F.col("full"), F.col("w"))).over(every)
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.col("cap"), left * F.col("w") / w_left))
    return placed.select("source", "source_size", target.alias("target"))


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` (with id and digest) and k: the number of each row among those with its id and digest, from 0.

    Rows are numbered within input partitions, and moved up by the rows that the partitions before have of their group:
    one count per group and partition, never a large group in one task. Where no row is repeated, which takes a count
    over ids and digests only, nothing is moved.
    """
    if not rows.groupBy("id", "digest").count().filter("count > 1").limit(1).count():
        return rows.withColumn("k", F.lit(0).cast("long"))
    placed = materialise(rows.withColumn("place", F.monotonically_increasing_id()).withColumn("part", F.shiftright("place", 33)))
    counts = placed.groupBy(F.col("id").alias("of_id"), F.col("digest").alias("of"), F.col("part").alias("of_part")).agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("of_id", "of").orderBy("of_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    within = placed.withColumn("within", F.row_number().over(Window.partitionBy("id", "digest", "part").orderBy("place")) - 1)
    joined = within.join(counts, (F.col("id") == F.col("of_id")) & (F.col("digest") == F.col("of")) & (F.col("part") == F.col("of_part")))
    return joined.select(*rows.columns, (F.col("within") + F.col("before")).alias("k"))


def with_copies(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs``), size, source_size, target and copies of every row of ``docs``.

    A document is taken floor(rate) times plus once more if a hash falls below the rate's fraction, so reruns agree. What
    is hashed is its id, the digest of its text and its number among the rows that have the same of both: rows without
    an id, and rows that repeat, are drawn one by one. Null texts have size 0; a null source is a source of its own, last
    in order; repeated rows are rows; an empty table gives none. Columns may have any names.
    """
    row, text = F.struct(*[column(c) for c in docs.columns]).alias("row"), text_of()
    sized = docs.select(row, doc_size().alias("size"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.md5(text.cast("binary")).alias("digest"))
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes).withColumnRenamed("source", "of_source")
    if docs.select("source").distinct().limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(LIMIT)), F.col("target") / F.col("source_size"))).otherwise(F.lit(0.0))
    key = F.concat_ws("/", F.lit(SEED), "id", "digest", F.col("k").cast("string"))
    drawn = F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)
    copies = F.floor(rate) + F.when(drawn < rate - F.floor(rate), 1).otherwise(0)
    joined = _numbered(sized).join(targets, F.col("source").eqNullSafe(F.col("of_source")), "left")
    return joined.select("row", "size", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, with the columns of ``docs`` and copy_no (from 0).

    A column of ``docs`` named copy_no is replaced.
    """
    taken = with_copies(docs).filter(F.col("copies") > 0)
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "copy_no"]
    return taken.select(*own, F.explode(F.sequence(F.lit(0), (F.col("copies") - 1).cast("int"))).alias("copy_no"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken (words, repeats counted) of every row."""
    c = with_copies(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source"))
    return c.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


ORACLE = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(text, '')) AS digest, row_number() OVER (PARTITION BY doc_id, md5(coalesce(text, ''))) - 1 AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, (CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END)::DOUBLE AS w, (3 * source_size)::DOUBLE AS cap FROM s),
p AS (SELECT *, (sum(source_size) OVER ())::DOUBLE AS total,
  coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) AS capped_before,
  sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_rest FROM r),
f AS (SELECT *, cap * w_rest <= (total - capped_before) * w AS is_full FROM p),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap ELSE least(cap,
  (total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0.0)) * w / (sum(CASE WHEN NOT is_full THEN w END) OVER ())) END AS target FROM f),
x AS (SELECT d.doc_id, d.size, t.source_size, t.target,
  CASE WHEN t.source_size > 0 THEN least(3.0::DOUBLE, t.target / t.source_size) ELSE 0.0 END AS rate,
  ('0x' || substr(md5(concat_ws('/', 'mix-1', coalesce(d.doc_id::VARCHAR, ''), d.digest, d.k::VARCHAR)), 1, 8))::UBIGINT::DOUBLE / 4294967296.0 AS drawn
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate) + CASE WHEN drawn < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM x
"""
