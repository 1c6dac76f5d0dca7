"""Line dedup: a sharded minimal perfect hash over line hashes, probed by the documents."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from keyloom.llm.common import ASCII_LOWER, ASCII_UPPER, SPACES, byte_slices, column, materialise, mix64, small_batches, text_of

MIN_CHARS, MIN_DOCS = 20, 3
#: Line hashes of one shard of the index, and probes that one task answers.
SHARD_KEYS, TASK_PROBES = 200_000, 400_000
#: Shards with several copies: a task answers more probes rather than that there are more of these.
MANY = 200_000
#: The keeper of a line that only rows without an id hold.
NOBODY = -(1 << 63)
_LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def key_of(line: str) -> str:
    x = line.strip(SPACES)
    return x.lower() if x.isascii() else x.translate(_LOWER)


def digest(key: str) -> bytes:
    return xxhash.xxh3_128_digest(key.encode())


class PerfectHash:
    """A minimal perfect hash in levels: each level keeps the keys that are alone in their slot, the rest go down."""

    GAMMA = 1.5

    def __init__(self, bits: list[np.ndarray], rest: np.ndarray):
        self.bits, self.rest = bits, rest  # rest: sorted keys that no level could place
        counts = [int(b.sum()) for b in bits]
        self.base = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.rank = [np.cumsum(b, dtype=np.int32) for b in bits]

    @staticmethod
    def _slots(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (mix64(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        keys, bits = np.unique(keys), []
        while len(keys) and len(bits) < 24:
            size = max(8, int(len(keys) * cls.GAMMA))
            at = cls._slots(keys, len(bits), size)
            alone = np.bincount(at, minlength=size) == 1
            bits.append(alone)
            keys = keys[~alone[at]]
        return cls(bits, keys)

    def __len__(self) -> int:
        return int(self.base[-1]) + len(self.rest)

    def index(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key; any place, or -1, for a key that isn't in the set."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, b in enumerate(self.bits):
            at = self._slots(keys[left], level, len(b))
            hit = b[at]
            out[left[hit]] = self.base[level] + self.rank[level][at[hit]] - 1
            left = left[~hit]
        if len(left) and len(self.rest):
            k = np.searchsorted(self.rest, keys[left])
            hit = (k < len(self.rest)) & (self.rest[np.minimum(k, len(self.rest) - 1)] == keys[left])
            out[left[hit]] = self.base[-1] + k[hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.bits), *[len(b) for b in self.bits], len(self.rest)], np.int64)
        return head.tobytes() + b"".join(np.packbits(b).tobytes() for b in self.bits) + self.rest.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> PerfectHash:
        n = int(np.frombuffer(data, np.int64, 1)[0])
        head = np.frombuffer(data, np.int64, n + 2)
        at, bits = 8 * (n + 2), []
        for size in map(int, head[1:-1]):
            k = (size + 7) // 8
            bits.append(np.unpackbits(np.frombuffer(data, np.uint8, k, at), count=size).astype(bool))
            at += k
        return cls(bits, np.frombuffer(data, np.uint64, int(head[-1]), at))


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """doc_id and the hash (128 bits, as two longs) of every different key of ``min_chars`` or more in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text"):
                of_text = [{digest(k) for x in t.split("\n") if len(k := key_of(x)) >= min_chars} for t in b.column("text").to_pylist()]
                both = np.frombuffer(b"".join(h for s in of_text for h in s), np.int64).reshape(-1, 2)
                of = np.repeat(np.arange(len(of_text)), [len(s) for s in of_text])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(of)), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "h1", "h2"])

    return docs.mapInArrow(run, "doc_id long, h1 long, h2 long")


def _longs(pdf: pd.DataFrame, name: str) -> np.ndarray:
    return pdf[name].to_numpy(np.int64, na_value=0).view(np.uint64)


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    """One shard: the perfect hash over the first half of the line hashes, and arrays in its order.

    The fingerprint is the second half. Of lines that share the first half (64 bits) the first is in the arrays, the
    others are whole rows of ``extra``.
    """
    h1, h2 = _longs(pdf, "h1"), _longs(pdf, "h2")
    count, keeper = pdf["n_docs"].to_numpy(np.int64), pdf["keeper"].to_numpy(np.int64, na_value=NOBODY)
    keys, first = np.unique(h1, return_index=True)
    hashed = PerfectHash.build(keys)
    place = hashed.index(keys)
    arrays = {}
    for name, values in (("print", h2), ("count", count), ("keeper", keeper)):
        arrays[name] = np.zeros(len(keys), values.dtype)
        arrays[name][place] = values[first]
    more = np.setdiff1d(np.arange(len(h1)), first)
    extra = np.stack([h1[more].view(np.int64), h2[more].view(np.int64), count[more], keeper[more]], 1)
    return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "hash": [hashed.to_bytes()], **{k: [v.tobytes()] for k, v in arrays.items()}, "extra": [extra.tobytes()]})


def _probe(probes: pd.DataFrame, shard: pd.DataFrame, min_docs: int = MIN_DOCS) -> pd.DataFrame:
    """The probes whose line has a count of ``min_docs`` or more in the shard and another document as its keeper."""
    if not len(probes) or not len(shard):
        return pd.DataFrame({"doc_id": pd.Series([], dtype="Int64"), "h1": pd.Series([], dtype="int64"), "h2": pd.Series([], dtype="int64")})
    s = shard.iloc[0]
    prints, count, keeper = np.frombuffer(s["print"], np.uint64), np.frombuffer(s["count"], np.int64), np.frombuffer(s["keeper"], np.int64)
    h1, h2 = _longs(probes, "h1"), _longs(probes, "h2")
    at = PerfectHash.from_bytes(s["hash"]).index(h1)
    known, at = at >= 0, np.maximum(at, 0)
    known &= prints[at] == h2
    often, owner = known & (count[at] >= min_docs), keeper[at]
    for a, b, n, k in np.frombuffer(s["extra"], np.int64).reshape(-1, 4):
        same = (h1.view(np.int64) == a) & (h2.view(np.int64) == b)
        often, owner = np.where(same, n >= min_docs, often), np.where(same, k, owner)
    ids = probes["doc_id"].astype("Int64")
    lost = often & (owner != NOBODY) & (ids.isna().to_numpy() | (ids.fillna(0).to_numpy(np.int64) != owner))
    return pd.DataFrame({"doc_id": ids[lost], "h1": h1[lost].view(np.int64), "h2": h2[lost].view(np.int64)})


def lost_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, lost: the hashes (128 bits) of the lines that each document loses; only documents that lose some.

    Line hashes are written once. They are counted with map-side aggregation, so a line that most documents hold costs a
    row per task, and all different lines go with their counts to shards of bounded size, each a perfect hash with arrays.
    The written hashes probe these arrays. A shard that hot lines load gets as many copies as its number of probes asks
    for, and documents are dealt to the copies by id; only the shards with several copies, MANY at most, are broadcast.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    of_doc = line_hashes(read, min_chars)
    if read.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        of_doc = of_doc.distinct()  # rows that share an id are one document
    of_doc = materialise(of_doc)
    probes = of_doc.count()
    n_shards = max(1, math.ceil(probes / SHARD_KEYS))
    shard = F.pmod(F.xxhash64("h1", "h2"), F.lit(n_shards)).cast("int")
    counted = materialise(of_doc.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper")).withColumn("shard", shard))
    task = max(TASK_PROBES, math.ceil(probes / MANY))
    loads = counted.groupBy("shard").agg(F.sum("n_docs").alias("hits")).filter(F.col("hits") > task)
    hot = materialise(loads.select(F.col("shard").alias("hot"), F.ceil(F.col("hits") / task).cast("int").alias("copies")))
    index = counted.groupBy("shard").applyInPandas(_build, "shard int, hash binary, print binary, count binary, keeper binary, extra binary")
    copies = F.coalesce("copies", F.lit(1))
    index = index.join(F.broadcast(hot), F.col("shard") == F.col("hot"), "left").withColumn("copy", F.explode(F.sequence(F.lit(0), copies - 1)))
    asked = of_doc.withColumn("to_shard", shard).join(F.broadcast(hot), F.col("to_shard") == F.col("hot"), "left")
    asked = asked.select("to_shard", F.pmod(F.xxhash64("doc_id"), copies).cast("int").alias("to_copy"), "doc_id", "h1", "h2")

    def answer(asked: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        return _probe(asked, shard, min_docs)

    found = asked.groupBy("to_shard", "to_copy").cogroup(index.drop("hot", "copies").groupBy("shard", "copy")).applyInPandas(answer, "doc_id long, h1 long, h2 long")
    return found.groupBy("doc_id").agg(F.flatten(F.collect_list(F.array("h1", "h2"))).alias("lost"))


def _keep(text: str, lost: set[bytes], min_chars: int) -> tuple[int, int, str]:
    lines = text.split("\n")
    if not lost:
        return len(lines), 0, text
    kept = [x for x in lines if len(k := key_of(x)) < min_chars or digest(k) not in lost]
    return len(lines), len(lines) - len(kept), "\n".join(kept)


def _hashes(flat: list[int] | None) -> set[bytes]:
    raw = np.array(flat or [], np.int64).tobytes()
    return {raw[i : i + 16] for i in range(0, len(raw), 16)}


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The columns of ``docs`` with text as the kept lines, then n_lines and n_dropped; a row for every row of ``docs``.

    A line whose key (stripped, A-Z lowered) has at least ``min_chars`` code points and is in at least ``min_docs``
    documents stays only in the largest doc_id that holds it; copies of it within that document stay too. A null or
    empty text is one empty line, an empty table gives no rows. Rows that share an id are one document, each with its own
    row of the result; a null id is one document, never the largest. Columns of the input named n_lines or n_dropped are
    replaced; others keep their names, whatever they are.
    """
    small_batches(docs.sparkSession)
    lost = lost_lines(docs, min_chars, min_docs).select(F.col("doc_id").alias("of"), "lost")
    own = [f for f in docs.schema.fields if f.name.lower() not in ("n_lines", "n_dropped", "text")]
    read = docs.select(F.col("doc_id").cast("long").alias("id"), text_of().alias("text"), F.struct(F.lit(0).alias("none"), *[column(f.name) for f in own]).alias("own"))
    joined = read.join(lost, F.col("id").eqNullSafe(F.col("of")), "left").select("text", "own", "lost")
    schema = StructType([*own, StructField("text", StringType()), StructField("n_lines", LongType()), StructField("n_dropped", LongType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for b in byte_slices(big, "text"):
                rows = [_keep(t, _hashes(x), min_chars) for t, x in zip(b.column("text").to_pylist(), b.column("lost").to_pylist(), strict=True)]
                n, d, t = (pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.string()), strict=True))
                yield pa.RecordBatch.from_arrays([*b.column("own").flatten()[1:], t, n, d], names)

    return joined.mapInArrow(run, schema)


ORACLE = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
j AS (SELECT k.*, f.key IS NOT NULL AND f.keeper <> k.doc_id AS lost FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (lost))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256 FROM j GROUP BY doc_id
"""
