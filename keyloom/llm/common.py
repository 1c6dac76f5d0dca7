"""Helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space as the contracts define it: space and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = ASCII_UPPER.lower()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    Where it is unset a session on one machine (``local[...]``) gets a temporary one; any other session is refused, as its
    executors would write to disks of their own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="keyloom-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # noqa: BLE001  the session may be gone at exit
        pass


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/keyloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches small, so a worker's memory doesn't follow the longest texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def column(name: str) -> Column:
    """The column of this very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or that with a number after it, which no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    return next(n for n in (name, *(f"{name}{k}" for k in range(len(taken) + 1))) if n not in taken)


def text_of(name: str = "text") -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


#: The same white space as a regular expression class.
SPACE_CLASS = r"[\x20\x09-\x0D]"


def words_of(text: Column) -> Column:
    """The maximal runs of characters other than ASCII white space, in order."""
    return F.array_remove(F.split(text, SPACE_CLASS + "+", -1), "")


def byte_slices(batch: pa.RecordBatch, column: str | int, limit: int = 4 << 20, rows: int = 1 << 30) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of about ``limit`` bytes of ``column`` and at most ``rows`` rows; a longer row stands alone."""
    if not batch.num_rows:
        return
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, n in enumerate(lengths):
        if i > start and (total + n > limit or i - start >= rows):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    yield batch.slice(start)


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the ``len + 1`` offsets into them; nulls are empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser over uint64 (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    out = np.ones(max(n, 1), np.uint64)
    out[1:] = np.uint64(base)
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)[:n]


#: An odd base of rolling hashes and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Polynomial hashes (modulo 2**64, then mixed) of values[start:end] for each span."""
    with np.errstate(over="ignore"):
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(BASE, len(values)), out=sums[1:])
        raw = (sums[ends] - sums[starts]) * powers(UNBASE, len(values) + 1)[starts]
        return mix64(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


_SPACE_TABLE = np.zeros(256, bool)
_SPACE_TABLE[[ord(c) for c in SPACES]] = True


def word_spans(raw: np.ndarray, offsets: np.ndarray, other: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word of every text, and the text each word is in.

    ``other`` is a table of 256 booleans that marks the bytes between words, ASCII white space by default.
    """
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~(_SPACE_TABLE if other is None else other)[raw]
    step = np.diff(inside)
    starts, ends = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    # a text's end also ends a word
    cuts = offsets[1:-1]
    if len(cuts) and len(starts):
        k = np.searchsorted(starts, cuts, side="left") - 1
        split = (k >= 0) & (cuts < ends[np.maximum(k, 0)]) & (cuts > starts[np.maximum(k, 0)])
        at = np.unique(cuts[split])
        starts, ends = np.sort(np.concatenate([starts, at])), np.sort(np.concatenate([ends, at]))
    doc = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, doc


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 4 is 2; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
