"""Quality classifier: attention-based multiple-instance learning over passages, trained in numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from keyloom.llm.common import SPACES, byte_slices, column, fresh, held_out, small_batches, span_hashes, text_of, utf8_buffer, word_spans
from keyloom.llm.sampling import labelled

#: The bound of the training sample: documents per label, and code points of a document.
PER_CLASS, MAX_CHARS = 2000, 40_000
#: Words of a passage, hashed word buckets among its inputs, and sizes of the passage code and of the attention.
PASSAGE, BUCKETS, CODE, ATTENTION = 48, 32, 16, 8
ACCEPT = 0.7

_CLASS = np.full(256, 7)
for _k, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", SPACES, ".,;:?'\"()-", "#*$%&|<>", "!")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[128:] = 8
N_CLASSES = 9
FEATURES = N_CLASSES + 8 + BUCKETS


def _share_seen_twice(keys: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """For each key, whether the same key is elsewhere in its group."""
    if not len(keys):
        return np.zeros(0)
    both = span_hashes(np.stack([keys, groups.astype(np.uint64)], 1).ravel(), np.arange(len(keys)) * 2, np.arange(len(keys)) * 2 + 2)
    _, inverse, n = np.unique(both, return_inverse=True, return_counts=True)
    return (n[inverse] > 1).astype(np.float32)


def passages(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Inputs of every passage of every text, and the text of each passage, in order; a text without words has one of zeros."""
    n = len(texts)
    raw, offsets = utf8_buffer(texts)
    starts, ends, doc = word_spans(raw, offsets)
    first = np.searchsorted(doc, np.arange(n + 1))
    n_words = np.diff(first)
    n_pass = np.maximum(1, -(-n_words // PASSAGE))
    base = np.cumsum(n_pass) - n_pass
    of = np.repeat(np.arange(n), n_pass)
    passage = base[doc] + (np.arange(len(doc)) - first[doc]) // PASSAGE
    total = int(n_pass.sum())
    out = np.zeros((total, FEATURES), np.float32)
    if not len(starts):
        return out, of
    # bytes from a passage's first word up to the next passage's
    opens = np.ones(len(passage), bool)
    opens[1:] = passage[1:] != passage[:-1]
    edges = np.append(starts[opens], len(raw))
    where = np.repeat(passage[opens], np.diff(edges))
    span = raw[edges[0] :]
    counts = np.bincount(where * N_CLASSES + _CLASS[span], minlength=total * N_CLASSES).reshape(total, N_CLASSES)
    out[:, :N_CLASSES] = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    words = np.bincount(passage, minlength=total)
    size = np.maximum(words, 1)
    hashes = span_hashes(raw.astype(np.uint64) + np.uint64(1), starts, ends)
    lengths = (ends - starts).astype(np.float32)

    def mean(x: np.ndarray) -> np.ndarray:
        return np.bincount(passage, x, minlength=total) / size

    same = np.zeros(len(hashes), np.float32)
    same[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    grams = span_hashes(hashes, np.arange(len(hashes)), np.minimum(np.arange(len(hashes)) + 4, len(hashes)))
    extra = [mean(lengths) / 10, mean(np.minimum(lengths, 40) ** 2) / 100, mean(lengths <= 1), mean(lengths >= 12), mean(same), mean(_share_seen_twice(hashes, passage)), mean(_share_seen_twice(grams, doc)), np.minimum(words / PASSAGE, 1)]
    out[:, N_CLASSES : N_CLASSES + len(extra)] = np.stack(extra, 1)
    buckets = np.bincount(passage * BUCKETS + (hashes >> np.uint64(59)).astype(np.int64), minlength=total * BUCKETS).reshape(total, BUCKETS)
    out[:, N_CLASSES + len(extra) :] = buckets / size[:, None]
    return out, of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


def _pool(x: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(x, starts, axis=0)


class GatedAttention:
    """Passage code h = tanh(xE), weight softmax(w.(tanh(hV) * sigmoid(hU))) within a document, score of the weighted code."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, seed: int = 7):
        rng = np.random.default_rng(seed)
        shapes = {"E": (FEATURES, CODE), "e": (CODE,), "V": (CODE, ATTENTION), "U": (CODE, ATTENTION), "w": (ATTENTION,), "o": (CODE,), "b": (1,)}
        self.p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) > 1 or k in "wo" else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
        self.mean, self.std = mean.astype(np.float32), std.astype(np.float32)

    def forward(self, x: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, tuple]:
        p = self.p
        starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
        z = (x - self.mean) / self.std
        h = np.tanh(np.clip(z, -8, 8) @ p["E"] + p["e"])
        t, g = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
        a = (t * g) @ p["w"]
        a = np.exp(a - np.maximum.reduceat(a, starts)[of])
        a /= _pool(a, starts)[of]
        m = _pool(a[:, None] * h, starts)
        return _sigmoid(m @ p["o"] + p["b"]), (z, h, t, g, a, m, starts)

    def gradients(self, x: np.ndarray, of: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        s, (z, h, t, g, a, m, starts) = self.forward(x, of)
        ds = ((s - y) / len(y)).astype(np.float32)
        dm = ds[:, None] * p["o"]
        dmh = dm[of]
        da = (dmh * h).sum(1)
        da = a * (da - _pool(a * da, starts)[of])
        dtg = da[:, None] * p["w"]
        dt, dg = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (a[:, None] * dmh + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
        return {"E": np.clip(z, -8, 8).T @ dh, "e": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ da, "o": m.T @ ds, "b": ds.sum(keepdims=True)}

    def fit(self, x: np.ndarray, of: np.ndarray, y: np.ndarray, steps: int = 240, rate: float = 0.02) -> None:
        first, second = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        for i in range(1, steps + 1):
            for k, d in self.gradients(x, of, y).items():
                d = d + 1e-4 * self.p[k]
                first[k] = 0.9 * first[k] + 0.1 * d
                second[k] = 0.99 * second[k] + 0.01 * d * d
                self.p[k] = (self.p[k] - rate * (first[k] / (1 - 0.9**i)) / (np.sqrt(second[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame) -> GatedAttention | float:
    """The model learned from a bounded sample; a constant score where the labels have one value only (1.0 without any)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in byte_slices(whole, "text"):
                x, of = passages(b.column("text"))
                cuts = np.searchsorted(of, np.arange(b.num_rows + 1))
                yield pa.RecordBatch.from_arrays([b.column("label"), b.column("doc_id"), pa.array([x[i:j].tobytes() for i, j in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary())], ["label", "doc_id", "inputs"])

    rows = labelled(docs, labels, "quality", PER_CLASS, MAX_CHARS).select("label", "doc_id", "text").mapInArrow(run, "label int, doc_id long, inputs binary").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["inputs"]))
    y = np.array([r["label"] for r in rows], np.float32)
    if not len(y) or y.min() == y.max():
        return float(y.max()) if len(y) else 1.0
    parts = [np.frombuffer(r["inputs"], np.float32).reshape(-1, FEATURES) for r in rows]
    x = np.concatenate(parts)
    of = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    model = GatedAttention(x.mean(0), x.std(0) + 1e-3)
    model.fit(x, of, y)
    return model


def score(docs: DataFrame, labels: DataFrame, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and one more, ``name`` (0 to 1, higher: better), of every row, from the whole text alone.

    Null and empty texts get the score of one passage of zeros; repeated rows get equal scores; an empty table has no
    rows. Columns of ``docs`` may have any name but ``name``.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels))  # a few kilobytes
    small_batches(spark)
    fields = [StructField("text", StringType()) if f.name.lower() == "text" else f for f in docs.schema.fields]
    at = next(i for i, f in enumerate(fields) if f.name == "text")
    others = [column(f.name) for i, f in enumerate(fields) if i != at]
    read = docs.select(text_of().alias("text"), F.struct(F.lit(0).alias("none"), *others).alias("own"))
    names = [*[f.name for f in fields], name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for b in byte_slices(whole, "text"):
                text = b.column("text")
                s = np.full(b.num_rows, m) if isinstance(m, float) else m.forward(*passages(text))[0]
                own = b.column("own").flatten()[1:]
                yield pa.RecordBatch.from_arrays([*own[:at], text, *own[at:], pa.array(s.astype(np.float64))], names)

    return read.mapInArrow(run, StructType([*fields, StructField(name, DoubleType())]))


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    scored = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def accept(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs``, with its columns, that the classifier doesn't reject; empty texts are judged like others."""
    name = fresh(docs, "score")
    return score(docs, labels, name).filter(F.col(name) >= ACCEPT).drop(name)
