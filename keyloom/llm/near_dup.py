"""MinHash near-dedup: DartMinHash signatures, banded joining, exact verification, classes as connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import byte_slices, column, materialise, mix64, small_batches, span_hashes, text_of, utf8_buffer, word_spans
from keyloom.llm.components import components

SHINGLE, SIMILAR = 5, 0.8
#: Coordinates of a signature, and the bands of ROWS coordinates that are joined. A pair at 0.8 shares one of the 36
#: bands with probability 0.9998.
COORDINATES, BANDS, ROWS = 256, 36, 7
#: Pairs whose signatures agree in fewer coordinates than this share are not verified: at a similarity of 0.8 that is
#: 4.8 standard deviations away.
AGREE = 0.68
#: Documents whose darts are thrown together: each gets about 2000, however short it is.
TOGETHER = 128
#: Center elections before what is left is compared within its buckets. More follow, up to MOST_ELECTIONS, while the
#: largest bucket of several classes has more than BOUND members and the last election has halved it.
ELECTIONS, MOST_ELECTIONS, BOUND = 2, 8, 5000
_DART, _PLACE = np.uint64(0xA24BAED4963EE407), np.uint64(0x9FB21C651E98DF25)


def text_shingles(texts: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct runs of ``n`` words of every text, and the text of each, in order.

    A text with words but fewer than ``n`` has one shingle, all its words.
    """
    raw, offsets = utf8_buffer(texts)
    starts, ends, doc = word_spans(raw, offsets)
    words = span_hashes(raw.astype(np.uint64) + np.uint64(1), starts, ends)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    counts = np.diff(first)
    width = np.minimum(counts, n)
    many = np.where(counts == 0, 0, counts - width + 1)
    of = np.repeat(np.arange(len(texts)), many)
    start = np.repeat(first[:-1], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    hashes = span_hashes(words, start, start + width[of]) if len(of) else np.zeros(0, np.uint64)
    order = np.lexsort((hashes, of))
    hashes, of = hashes[order], of[order]
    fresh = np.ones(len(of), bool)
    fresh[1:] = (hashes[1:] != hashes[:-1]) | (of[1:] != of[:-1])
    return hashes[fresh], of[fresh]


def dart_signatures(elements: np.ndarray, weights: np.ndarray, sets: np.ndarray, n_sets: int, k: int = COORDINATES) -> np.ndarray:
    """DartMinHash: n_sets x k signatures of weighted sets; equal coordinates estimate the weighted Jaccard similarity.

    ``elements`` (hashes), ``weights`` (whole numbers) and ``sets`` (in order) are parallel. An element of weight w
    covers w unit cells; along each cell darts arrive as a Poisson process whose gaps are hashed from element, cell and
    count, so equal cells get equal darts in every set. A dart lands on a hashed coordinate, where the earliest stays.
    Darts are thrown up to a height that gives about k ln k + 2k per set, and twice as high, again and again, where a
    coordinate is still empty. An empty set has a signature of zeros.
    """
    cells = np.repeat(elements, weights)
    of = np.repeat(sets, weights)
    unit = np.arange(len(cells)) - np.repeat(np.cumsum(weights) - weights, weights)
    with np.errstate(over="ignore"):
        seeds = mix64(cells + unit.astype(np.uint64) * _DART)
        total = np.bincount(of, minlength=n_sets)
        height = (k * np.log(k) + 2 * k) / np.maximum(total, 1)
        out = np.zeros((n_sets, k), np.uint64)
        open_set = total > 0
        while open_set.any():
            live = np.flatnonzero(open_set[of])
            at, seed = np.zeros(len(live)), seeds[live]
            darts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            count = 0
            while len(live):
                count += 1
                h = mix64(seed ^ (np.uint64(count) * _PLACE))
                at = at - np.log(((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
                hit = at <= height[of[live]]
                live, seed, at, h = live[hit], seed[hit], at[hit], h[hit]
                darts.append((of[live], at, h))
            s, r, h = (np.concatenate(x) for x in zip(*darts, strict=True))
            name = mix64(h + _DART)
            slot = s * k + (name % np.uint64(k)).astype(np.int64)
            earliest = np.full(n_sets * k, np.inf)
            np.minimum.at(earliest, slot, r)
            stays = r == earliest[slot]
            flat = np.zeros(n_sets * k, np.uint64)
            flat[slot[stays]] = name[stays] | np.uint64(1)
            found = flat.reshape(n_sets, k)
            full = open_set & (found != 0).all(axis=1)
            out[full] = found[full]
            open_set &= ~full
            height = np.where(open_set, height * 2, height)
        return out


def _bands(signatures: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        out = np.zeros((len(signatures), BANDS), np.uint64)
        for b in range(BANDS):
            part = np.full(len(signatures), b + 1, np.uint64)
            for j in range(ROWS):
                part = mix64(part * np.uint64(0x9E3779B97F4A7C15) + signatures[:, b * ROWS + j])
            out[:, b] = part
        return out


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, bands (a hash per band) and sig (8 bits per coordinate, 8 to a long) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text", 1 << 20, TOGETHER):
                elements, sets = text_shingles(b.column("text"))
                sig = dart_signatures(elements, np.ones(len(elements), np.int64), sets, b.num_rows)
                bands = _bands(sig).view(np.int64)
                short = (mix64(sig) & np.uint64(255)).astype(np.uint8).view(np.int64).reshape(b.num_rows, -1)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1) * x.shape[1], pa.int32()), pa.array(x.ravel())) for x in (bands, short)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(np.bincount(sets, minlength=b.num_rows), pa.int64()), *lists], ["doc_id", "n_shingles", "bands", "sig"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_shingles long, bands array<long>, sig array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id, shingles (sorted distinct hashes, their upper 32 bits) of every row."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text"):
                hashes, of = text_shingles(b.column("text"))
                ends = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=b.num_rows))])
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array((hashes >> np.uint64(32)).astype(np.uint32).view(np.int32)))], ["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<int>")


def _agreement(a: str, b: str) -> Column:
    """An estimate of the share of equal coordinates of two packed signatures, in whole-stage code.

    Of the 8 bits of an unequal coordinate 4 differ on average, so the differing bits count the unequal coordinates.
    """
    differing = " + ".join(f"bit_count({a}[{j}] ^ {b}[{j}])" for j in range(COORDINATES // 8))
    return F.expr(f"1D - ({differing}) / {4.0 * COORDINATES}D")


def _likely(a: str, b: str, similar: float) -> Column:
    """Whether the sizes allow the similarity and the signatures agree well enough."""
    return (F.least(f"n_{a}", f"n_{b}") >= F.greatest(f"n_{a}", f"n_{b}") * similar) & (_agreement(f"sig_{a}", f"sig_{b}") >= AGREE)


def _first_shared(a: str, b: str) -> Column:
    """The first band whose hash two documents share."""
    out = F.lit(BANDS)
    for k in range(BANDS - 1, -1, -1):
        out = F.when(F.get(a, F.lit(k)) == F.get(b, F.lit(k)), k).otherwise(out)
    return out


def _verified(pairs: DataFrame, sets: DataFrame, similar: float) -> DataFrame:
    """Those of the distinct pairs (a, b) whose shingle sets have the Jaccard similarity asked for."""
    side = lambda n: sets.select(F.col("doc_id").alias(n), F.col("shingles").alias(f"set_{n}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").filter(_linked("set_a", "set_b", similar)).select("a", "b")


def _linked(a: str, b: str, similar: float) -> Column:
    """Whether the Jaccard similarity of two sets is at least ``similar``; their intersection is computed once."""
    return F.size(F.array_intersect(a, b)) * (1 + similar) >= (F.size(a) + F.size(b)) * similar - 1e-9


def classes(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """doc_id, class_id (the smallest doc_id of its class) and n_copies (rows with the very same text) of every row.

    Rows are in a class if a chain of links joins them; a link is a Jaccard similarity of at least ``similar`` between
    the sets of five-word shingles, or the same text. Exact copies are folded first, by a digest with map-side
    aggregation. Among different texts every band bucket elects a center by hash, and its members are compared with
    the center whose signature agrees best; this is done ELECTIONS times or, while buckets of several classes are large
    and elections halve them, up to MOST_ELECTIONS times, each time only for members that are not yet in their center's
    class. What then still shares a bucket without sharing a class is compared within one join, as far as sizes and
    signatures allow the similarity, in the first bucket that the two share; only links leave that join.

    Empty or null texts are copies of each other; texts under five words are one shingle. A repeated doc_id is one
    document, of the text with the smallest digest; a null doc_id is one document too, in no class (class_id null).
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    keyed = read.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    # both are written, so that the join below has shuffles of its own, whose large partitions can be split
    of_doc = materialise(keyed.groupBy("doc_id").agg(F.min("digest").alias("digest"), F.max("digest").alias("other"), F.count(F.lit(1)).alias("rows")))
    folded = materialise(of_doc.filter(F.col("doc_id").isNotNull()).groupBy("digest").agg(F.min("doc_id").alias("first"), F.sum("rows").alias("n_copies")))
    # the only text of each id that is signed, verified and folded
    several = materialise(of_doc.filter("doc_id IS NOT NULL AND digest <> other").select("doc_id", F.col("digest").alias("chosen")))
    read = keyed.filter(F.col("doc_id").isNotNull()).join(several, "doc_id", "left").filter("chosen IS NULL OR digest = chosen").select("doc_id", "text")
    members = materialise(of_doc.join(folded, "digest", "left").select("doc_id", "first", "n_copies", "rows"))
    firsts = members.select(F.col("first").alias("doc_id"), F.lit(True).alias("is_first")).filter("doc_id is not null").distinct()
    sigs = materialise(signatures(read).join(firsts, "doc_id", "left_semi").dropDuplicates(["doc_id"]))
    banded = sigs.filter("n_shingles > 0").select("doc_id", F.posexplode("bands").alias("band", "hash")).select("doc_id", "band", F.xxhash64("band", "hash").alias("bucket"))
    shared = banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("bucket")
    buckets = materialise(banded.join(shared, "bucket"))
    grouped = buckets.select("doc_id").distinct()
    sets = materialise(shingle_sets(read.join(grouped, "doc_id", "left_semi")).dropDuplicates(["doc_id"]))
    side = lambda n: sigs.select(F.col("doc_id").alias(n), F.col("sig").alias(f"sig_{n}"), F.col("n_shingles").alias(f"n_{n}"))
    links, known, tested = None, None, None
    placed, turn, largest, before = buckets.withColumn("component", F.col("doc_id")), 0, 0, 0
    while turn < ELECTIONS or (turn < MOST_ELECTIONS and largest > BOUND and 2 * largest <= before):
        center = F.struct(F.xxhash64("doc_id", F.lit(turn)).alias("h"), F.col("doc_id").alias("x"), F.col("component").alias("cx"))
        # written, so that the join has shuffles of its own, whose large partitions can be split
        elected = materialise(placed.groupBy("bucket").agg(F.min(center).alias("c")))
        met = placed.join(elected, "bucket").filter(F.col("component") != F.col("c.cx")).select(F.col("c.x").alias("x"), F.col("doc_id").alias("y")).distinct()
        near = met.join(side("x"), "x").join(side("y"), "y").filter(_likely("x", "y", similar)).select("x", "y", _agreement("sig_x", "sig_y").alias("agree"))
        met = near.groupBy("y").agg(F.max_by("x", F.struct("agree", "x")).alias("x"))
        pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = materialise(pairs)
        tested = pairs if tested is None else tested.union(pairs)
        found = materialise(_verified(pairs, sets, similar))
        links = found if links is None else links.union(found)
        known = components(links)
        placed = buckets.join(known.withColumnRenamed("node", "doc_id"), "doc_id", "left").select("bucket", "band", "doc_id", F.coalesce("component", "doc_id").alias("component"))
        several = placed.groupBy("bucket").agg(F.min("component").alias("p"), F.max("component").alias("q"), F.count(F.lit(1)).alias("members")).filter("p <> q")
        placed = materialise(placed.join(several.select("bucket", "members"), "bucket"))
        before, largest = largest, placed.agg(F.max("members")).first()[0] or 0
        placed, turn = placed.drop("members"), turn + 1
    # each pair is verified in the first bucket that it shares only
    whole = lambda n: sigs.select(F.col("doc_id").alias(n), F.col("sig").alias(f"sig_{n}"), F.col("n_shingles").alias(f"n_{n}"), F.col("bands").alias(f"bands_{n}")).join(sets.select(F.col("doc_id").alias(n), F.col("shingles").alias(f"set_{n}")), n)
    left = placed.select("bucket", "band", F.col("doc_id").alias("x"), F.col("component").alias("cx")).join(whole("x"), "x")
    right = placed.select(F.col("bucket").alias("bucket_y"), F.col("doc_id").alias("y"), F.col("component").alias("cy")).join(whole("y"), "y")
    rest = (F.col("cx") < F.col("cy")) & _likely("x", "y", similar) & (_first_shared("bands_x", "bands_y") == F.col("band")) & _linked("set_x", "set_y", similar)
    met = left.join(right, (F.col("bucket") == F.col("bucket_y")) & rest).select(F.col("x").alias("a"), F.col("y").alias("b"))
    known = components(links.union(materialise(met)))
    whole = members.join(known, members["first"] == known["node"], "left")
    of = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "first"))
    return whole.select("doc_id", of.alias("class_id"), F.coalesce("n_copies", "rows").alias("n_copies"))


def keep_one(docs: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """One row of each class of ``docs``: a row of its smallest doc_id.

    Of rows that share an id the one with the smallest text digest stays (then with the smallest hash over all columns),
    which is the text that ``classes`` compares. Rows with a null id are documents by their text, after all that have an
    id: of equal or near texts one row stays, and none if a row with an id has such a text. All empty texts are copies of
    each other; an empty table has no rows; columns may have any names.
    """
    digest = F.unhex(F.md5(text_of().cast("binary")))
    last, without = docs.agg(F.max(F.col("doc_id").cast("long")), F.count_if(F.col("doc_id").isNull())).first()
    own = docs.select(F.col("doc_id").cast("long").alias("id"), digest.alias("digest"), text_of().alias("text"), F.struct(*[column(c) for c in docs.columns]).alias("row"))
    if without:
        nameless = own.filter(F.col("id").isNull()).drop("id")
        numbered = materialise(nameless.select("digest").distinct().withColumn("id", F.monotonically_increasing_id() + F.lit(last or 0) + 1))
        own = own.filter(F.col("id").isNotNull()).unionByName(nameless.join(numbered, "digest"))
    classed = classes(own.select(F.col("id").alias("doc_id"), "text"), similar)
    later = classed.filter(F.col("class_id") < F.col("doc_id")).select(F.col("doc_id").alias("id"))
    one = own.groupBy("id").agg(F.min_by("row", F.struct("digest", F.xxhash64("row"))).alias("row"))
    return one.join(later, "id", "left_anti").select("row.*")
