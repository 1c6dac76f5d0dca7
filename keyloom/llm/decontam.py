"""Benchmark decontamination: size-partitioned MinHash containment search, with DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.llm.common import fresh, materialise, text_of, words_of

SHINGLE, CONTAINED = 5, 0.8
#: Item shingles broadcast at a time (8 bytes each, and 24 for each of their sketch keys): larger benchmarks are searched
#: in blocks of this many, and one item more at most.
BROADCAST_SHINGLES = 1_000_000


def shingles(words: Column, n: int = SHINGLE) -> Column:
    """The distinct hashes of the runs of ``n`` words; a shorter text that has words is one shingle, an empty one none.

    The words are bound once, as the variable of an outer lambda, so no rewrite of the plan can split a text per word.
    """

    def runs(w: Column) -> Column:
        each = F.transform(F.slice(w, F.lit(1), F.size(w) - (n - 1)), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, n)]))
        one = F.array(F.xxhash64(F.array_join(w, " ")))
        return F.when(F.size(w) >= n, F.array_distinct(each)).when(F.size(w) > 0, one).otherwise(F.array().cast("array<bigint>"))

    return F.get(F.transform(F.array(words), runs), F.lit(0))


def plain_words(text: Column) -> Column:
    """The words in lower case, without punctuation at their edges; a word of punctuation alone is none."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{M}\p{N}](?:[^\x20\x09-\x0D]*[\p{L}\p{M}\p{N}])?"), F.lit(0))


def sketch(items: DataFrame, contained: float = CONTAINED, words: Callable[[Column], Column] = words_of) -> DataFrame:
    """item_id, item_n, size_class, item_shingles, keys: a MinHash sketch (the smallest hashes) of each item.

    Items are partitioned by size (powers of two), and all sketches of a partition have one width. A document that holds
    ``contained`` of an item's n shingles misses at most n - ceil(contained n) of them, so it holds one of any larger
    number: that many smallest hashes, counted for the largest item of the partition, miss no match. Documents are looked
    up with all their shingles: the smallest hashes of a long document need not be among a short item's.
    """
    own = items.select(F.col("item_id").cast("long").alias("item_id"), shingles(words(text_of())).alias("item_shingles"))
    own = own.filter(F.size("item_shingles") > 0).withColumn("item_n", F.size("item_shingles")).withColumn("size_class", F.floor(F.log2("item_n")).cast("int"))
    largest = F.pow(F.lit(2.0), F.col("size_class") + 1) - 1
    width = (largest - F.ceil(largest * contained) + 1).cast("int")
    return own.withColumn("keys", F.slice(F.array_sort("item_shingles"), F.lit(1), width))


def leaks(docs: DataFrame, items: DataFrame, contained: float = CONTAINED, words: Callable[[Column], Column] = words_of) -> DataFrame:
    """doc_id, item_id, n_shared, n_item, containment for every document that holds enough of an item's shingles.

    The whole documents are searched in one pass, without a shuffle of texts: each distinct shingle is looked up among
    the sketch keys (broadcast in blocks of bounded size), and a hit is verified at once against the document's own
    shingles. A repeated doc_id or item_id keeps its best row; null or empty texts on either side match nothing; an item
    under five words is matched only by a text of just these words. Words are compared as they are, or as ``words`` gives
    them.
    """
    return _search(shingles(words(text_of())), docs, sketch(items, contained, words), contained)


def short_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """As ``leaks`` over plain words, for items of one to four of them: every document that holds them one after the other."""
    own = items.select(F.col("item_id").cast("long").alias("item_id"), plain_words(text_of()).alias("w"))
    own = own.withColumn("n", F.size("w")).filter((F.col("n") > 0) & (F.col("n") < SHINGLE))
    found = None
    for (n,) in sorted(own.select("n").distinct().collect()):
        index = own.filter(F.col("n") == n).select("item_id", shingles(F.col("w"), n).alias("item_shingles"), F.lit(1).alias("item_n"))
        hits = _search(shingles(plain_words(text_of()), n), docs, index.withColumn("keys", F.col("item_shingles")), 1.0)
        found = hits if found is None else found.unionAll(hits)
    return leaks(docs.limit(0), items.limit(0)) if found is None else found


def _blocks(index: DataFrame) -> list[DataFrame]:
    """The index in parts: items of BROADCAST_SHINGLES shingles, and one item more at most."""
    sizes = index.groupBy("item_id").agg(F.sum("item_n").alias("n"))
    if (sizes.agg(F.sum("n")).first()[0] or 0) <= BROADCAST_SHINGLES:
        return [index]
    before = F.sum("n").over(Window.orderBy("item_id")) - F.col("n")  # two numbers per item of the benchmark
    placed = materialise(sizes.select(F.col("item_id").alias("of"), F.floor(before / BROADCAST_SHINGLES).alias("block")))
    names = [r[0] for r in placed.select("block").distinct().orderBy("block").collect()]
    return [index.join(placed.filter(F.col("block") == x).select("of"), F.col("item_id") == F.col("of"), "left_semi") for x in names]


def _search(of_text: Column, docs: DataFrame, index: DataFrame, contained: float) -> DataFrame:
    """The documents that hold enough of the items of an index (item_id, item_n, item_shingles, keys).

    What is broadcast is a row per sketch key with the key before it, and every item's shingles once. A hit on a key
    whose predecessor is in the document too is not the item's first one and goes; the others are verified.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), of_text.alias("s"))
    probes = read.select("doc_id", "s", F.explode_outer("s").alias("key"))  # outer: no filter on its size goes below
    found = None
    for block in _blocks(index):
        keyed = block.select("item_id", F.explode(F.transform("keys", lambda x, i: F.struct(x.alias("key"), F.get("keys", i - 1).alias("before")))).alias("k")).select("item_id", "k.key", "k.before")
        items = block.select("item_id", "item_n", "item_shingles")
        hits = probes.join(F.broadcast(keyed), "key").filter(F.col("before").isNull() | ~F.array_contains("s", F.col("before")))
        shared = F.size(F.array_intersect("s", "item_shingles"))
        verified = hits.join(F.broadcast(items), "item_id").select("doc_id", "item_id", "item_n", shared.alias("n_shared"))
        verified = verified.filter(F.col("n_shared") >= F.ceil(F.col("item_n") * F.lit(contained)))
        found = verified if found is None else found.unionAll(verified)
    best = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_shared", "item_n")).alias("m"))
    return best.select("doc_id", "item_id", F.col("m.n_shared").cast("long").alias("n_shared"), F.col("m.item_n").cast("long").alias("n_item"), (F.col("m.n_shared") / F.col("m.item_n")).alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """The rows of ``docs`` that hold no item, with its columns; rows with a null id are judged together.

    An item is held by the words as they are, by plain words (``plain_words``), or, if it has under five plain words, as
    a run of these anywhere in the text. Null and empty texts hold nothing and stay; an empty benchmark takes nothing
    away; columns may have any names.
    """
    found = leaks(docs, items, contained).unionAll(leaks(docs, items, contained, plain_words)).unionAll(short_leaks(docs, items))
    name = fresh(docs, "leaked")
    leaked = found.select(F.col("doc_id").alias(name)).distinct()
    return docs.join(leaked, F.col("doc_id").cast("long").eqNullSafe(F.col(name)), "left_anti")


ORACLE = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM benchmark),
d AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM dw),
i AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS s FROM iw),
n AS (SELECT item_id, count(*)::BIGINT AS n_item FROM i GROUP BY item_id),
m AS (SELECT doc_id, item_id, count(*)::BIGINT AS n_shared FROM d JOIN i USING (s) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item, n_shared / n_item AS containment FROM m JOIN n USING (item_id) WHERE n_shared >= ceil(n_item * 0.8::DOUBLE)
"""
