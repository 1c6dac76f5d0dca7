"""Substring dedup: repeated-phrase automata that locate every occurrence of recurring passages.

1. Every text is cut at anchors: in each window of 35 words the run of ANCHOR words with the smallest hash is the
   window's anchor, so equal windows have equal anchors. The windows that share an anchor make a segment. Only segments
   whose anchor is found at two places or more can hold a recurring window.
2. Confirm: segments are counted by (anchor, segment) hash. A segment that is its anchor's only one recurs as a whole.
   The windows of all other segments are counted by 128-bit hashes, each segment's once, times its number of places.
3. Compile and stream: documents are dealt to blocks of bounded size by id. A block gets the confirmed passages that its
   documents hold, each once, as places in one of its documents; it compiles Aho-Corasick automata of them, of a bounded
   number of words each, and streams all its documents through these. What they locate is removed.

No step gathers the segments, windows or places of one anchor or passage: they are counted with map-side aggregation and
joined with written tables, whose large partitions Spark can split.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import byte_slices, materialise, mix64, small_batches, span_hashes, text_of, utf8_buffer, word_spans

WINDOW, ANCHOR = 35, 8
#: Bytes of text of a block of documents, on average, and words of all patterns of one automaton.
BLOCK_BYTES, AUTOMATON_WORDS = 2 << 20, 400_000


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The index of the smallest of each run of ``width`` values, the last one where equal."""
    n = len(values) - width + 1
    # doubling: minima of runs of 1, 2, 4, ... then two runs that overlap to the full width
    at, run, size = np.arange(len(values)), values.copy(), 1
    while size * 2 <= width:
        m = len(run) - size
        right = run[size : size + m] <= run[:m]
        run, at = np.where(right, run[size : size + m], run[:m]), np.where(right, at[size : size + m], at[:m])
        size *= 2
    shift = width - size
    right = run[shift : shift + n] <= run[:n]
    return np.where(right, at[shift : shift + n], at[:n])


def cut(texts: pa.Array, window: int = WINDOW, anchor: int = ANCHOR) -> dict[str, np.ndarray]:
    """Segments of all texts: doc (row), start (first word), words, offset (bytes from start to end), anchor, segment."""
    raw, offsets = utf8_buffer(texts)
    starts, ends, doc = word_spans(raw, offsets)
    empty = {k: np.zeros(0, np.int64) for k in ("doc", "start", "words")} | {k: np.zeros(0, np.uint64) for k in ("anchor", "segment")}
    if len(starts) < window:
        return empty
    words = span_hashes(raw.astype(np.uint64) + np.uint64(1), starts, ends)
    every = np.arange(len(words) - anchor + 1)
    grams = span_hashes(words, every, every + anchor)
    best = _window_minima(grams, window - anchor + 1)  # of the window that starts at each word
    inside = doc[: len(best)] == doc[window - 1 :]
    at = np.flatnonzero(inside)
    if not len(at):
        return empty
    fresh = np.ones(len(at), bool)
    fresh[1:] = (best[at[1:]] != best[at[:-1]]) | (doc[at[1:]] != doc[at[:-1]])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(at)) - 1
    begin, end = at[first], at[last] + window
    base = np.searchsorted(doc, doc[begin])
    with np.errstate(over="ignore"):
        place = mix64((best[begin] - begin).astype(np.uint64) + np.uint64(7))
        return {"doc": doc[begin], "start": begin - base, "words": end - begin, "anchor": grams[best[begin]], "segment": span_hashes(words, begin, end) ^ place}


def segments(docs: DataFrame) -> DataFrame:
    """doc_id, start, words, anchor, segment of every segment of every text."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text", 2 << 20):
                c = cut(b.column("text"))
                ids = b.column("doc_id").take(pa.array(c["doc"]))
                yield pa.RecordBatch.from_arrays([ids, pa.array(c["start"], pa.int32()), pa.array(c["words"], pa.int32()), pa.array(c["anchor"].view(np.int64)), pa.array(c["segment"].view(np.int64))], ["doc_id", "start", "words", "anchor", "segment"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, start int, words int, anchor long, segment long")


def segment_windows(located: DataFrame) -> DataFrame:
    """anchor, segment, n, h1, h2 (128-bit hashes of the segment's windows in order) of rows with text and wanted segments."""
    small_batches(located.sparkSession, 200)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text"):
                raw, offsets = utf8_buffer(b.column("text"))
                starts, ends, doc = word_spans(raw, offsets)
                first = np.searchsorted(doc, np.arange(b.num_rows))
                wanted = b.column("wanted")
                of, w = wanted.value_parent_indices().to_numpy(), wanted.flatten()
                begin = first[of] + w.field("start").to_numpy()
                n = w.field("words").to_numpy().astype(np.int64) - (WINDOW - 1)
                at = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
                ends_at = pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32())
                words = span_hashes(raw.astype(np.uint64) + np.uint64(1), starts, ends)
                both = (span_hashes(x, at, at + WINDOW).view(np.int64) for x in (words, mix64(words)))
                lists = [pa.ListArray.from_arrays(ends_at, pa.array(x)) for x in both]
                yield pa.RecordBatch.from_arrays([w.field("anchor"), w.field("segment"), w.field("n"), *lists], ["anchor", "segment", "n", "h1", "h2"])

    return located.mapInArrow(run, "anchor long, segment long, n long, h1 array<long>, h2 array<long>")


def confirmed(docs: DataFrame, recurring: DataFrame) -> DataFrame:
    """anchor, segment, whole, starts: the segments that hold recurring windows.

    ``recurring`` has the places (doc_id, start, words) of all segments whose anchor is found twice. whole: the anchor has
    no other segment, so all windows recur, and starts is null; otherwise starts has the positions of those that do.
    """
    place = F.struct("doc_id", "start", "words")
    counted = materialise(recurring.groupBy("anchor", "segment").agg(F.count(F.lit(1)).alias("n"), F.min(place).alias("at")))
    several = materialise(counted.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).filter("kinds > 1").select("anchor"))
    alone = counted.join(several, "anchor", "left_anti").select("anchor", "segment", F.lit(True).alias("whole"), F.lit(None).cast("array<int>").alias("starts"))
    mixed = counted.join(several, "anchor", "left_semi").select("anchor", "segment", "n", "at.*")
    wanted = mixed.groupBy("doc_id").agg(F.collect_list(F.struct("anchor", "segment", "n", "start", "words")).alias("wanted"))
    each = materialise(segment_windows(docs.join(wanted, "doc_id").select("text", "wanted")))
    windows = each.select("anchor", "segment", "n", F.posexplode(F.arrays_zip("h1", "h2")).alias("at", "h")).select("anchor", "segment", "n", "at", "h.h1", "h.h2")
    again = materialise(windows.groupBy("h1", "h2").agg(F.sum("n").alias("places")).filter("places > 1").select("h1", "h2"))
    some = windows.drop("n").join(again, ["h1", "h2"], "left_semi").groupBy("anchor", "segment").agg(F.lit(False).alias("whole"), F.array_sort(F.collect_list("at")).alias("starts"))
    return materialise(alone.unionByName(some))


def locate(patterns: list[tuple[int, ...]], texts: list[tuple[int, ...]]) -> list[np.ndarray]:
    """For each text (of word numbers), which of its words an occurrence of a pattern covers; automata of bounded size, one by one."""
    import ahocorasick

    edges = [np.zeros(len(t) + 1, np.int64) for t in texts]
    k = 0
    while k < len(patterns):
        automaton, size = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE), 0
        while k < len(patterns) and (not size or size + len(patterns[k]) <= AUTOMATON_WORDS):
            automaton.add_word(patterns[k], len(patterns[k]))
            size += len(patterns[k])
            k += 1
        automaton.make_automaton()
        for words, edge in zip(texts, edges, strict=True):
            found = list(automaton.iter(words))
            if found:
                hits = np.array(found, np.int64)
                np.add.at(edge, hits[:, 0] - hits[:, 1] + 1, 1)
                np.add.at(edge, hits[:, 0] + 1, -1)
    return [np.cumsum(e[:-1]) > 0 for e in edges]


def split_words(text: str) -> list[str]:
    words = text.replace("\n", " ").replace("\t", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    return [w for w in words if w]


def runs(starts: list[int] | None, n: int) -> list[tuple[int, int]]:
    """The stretches (first word, end) of a segment of ``n`` words that its recurring windows cover without a gap between
    their starts; all of it where all windows recur."""
    if starts is None:
        return [(0, n)]
    out, first = [], starts[0]
    for a, b in zip(starts, [*starts[1:], -1], strict=True):
        if b != a + 1:
            out.append((first, a + WINDOW))
            first = b
    return out


def clean_block(texts: list[str], passages: list[tuple[int, int, int, list[int] | None]]) -> list[tuple[int, int, str]]:
    """n_words, n_removed and the kept words of every text of a block.

    A passage is a place: a text, its first word, its number of words, and the starts of its recurring windows (all of it
    recurs where there are none). Every segment of the block that holds recurring windows is among the passages, by one of
    its places at least, so its unbroken runs of such windows are patterns enough: each is found wherever it stands.
    """
    words = [split_words(t) for t in texts]
    if not passages:
        return [(len(w), 0, " ".join(w)) for w in words]
    number: defaultdict[str, int] = defaultdict(itertools.count().__next__)
    ids = [tuple(map(number.__getitem__, w)) for w in words]
    patterns = {ids[of][start + a : start + b]: None for of, start, n, starts in passages for a, b in runs(starts, n)}
    out = []
    for w, gone in zip(words, locate(list(patterns), ids), strict=True):
        kept = [x for x, g in zip(w, gone.tolist(), strict=True) if not g] if gone.any() else w
        out.append((len(w), len(w) - len(kept), " ".join(kept)))
    return out


def _block(docs: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
    places = {d: k for k, d in enumerate(docs["doc_id"])}
    known = [(places[d], s, n, None if w else list(x)) for d, s, n, w, x in zip(passages["doc_id"], passages["start"], passages["words"], passages["whole"], passages["starts"], strict=True)]
    rows = clean_block(docs["text"].tolist(), known)
    n, gone, text = zip(*rows, strict=True) if rows else ((), (), ())
    return pd.DataFrame({"doc_id": docs["own_id"].astype("Int64"), "text": list(text), "n_words": list(n), "n_removed": list(gone)})


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, text (kept words joined by one space), n_words, n_removed of every row of ``docs``.

    Each word that a window of 35 words covers goes if the window's words also start at any other place of any text.
    Null texts have no words; an empty table gives no rows; only doc_id and text are read. Rows that share an id, or have
    none, are texts of their own: they are told apart by a number given to the rows, so repeated rows remove each other's
    words.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("own_id"), text_of().alias("text"))
    small_batches(docs.sparkSession)
    if read.groupBy("own_id").agg(F.count(F.lit(1)).alias("c")).filter("c > 1 or own_id is null").limit(1).count():
        read = materialise(read.withColumn("doc_id", F.monotonically_increasing_id()))
    else:
        read = read.withColumn("doc_id", F.col("own_id"))
    every = materialise(segments(read))
    anchors = materialise(every.groupBy("anchor").agg(F.count(F.lit(1)).alias("places")).filter("places > 1").select("anchor"))
    recurring = materialise(every.join(anchors, "anchor", "left_semi"))
    blocks = max(1, math.ceil((read.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) / BLOCK_BYTES))
    block = F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int").alias("block")
    held = materialise(recurring.groupBy(block, "anchor", "segment").agg(F.min(F.struct("doc_id", "start", "words")).alias("at")))
    passages = held.join(confirmed(read, recurring), ["anchor", "segment"]).select("block", "at.*", "whole", "starts")
    return read.withColumn("block", block).groupBy("block").cogroup(passages.groupBy("block")).applyInPandas(_block, "doc_id long, text string, n_words long, n_removed long")


ORACLE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS p, unnest(list_transform(range(1, len(w) - 33), lambda i: md5(array_to_string(w[i:i + 34], ' ')))) AS h FROM w),
again AS (SELECT h FROM win GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 35)) AS i FROM win JOIN again USING (h)),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS i, unnest(w) AS x FROM w),
kept AS (SELECT doc_id, count(*) AS n, string_agg(x, ' ' ORDER BY i) AS t FROM word LEFT JOIN gone USING (doc_id, i) WHERE gone.i IS NULL GROUP BY doc_id)
SELECT w.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (doc_id)
"""
