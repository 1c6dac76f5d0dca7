"""Toxicity: a bidirectional gated recurrent network with attention pooling over character and word inputs.

Embeddings of words and of their character n-grams, the network and the attention are trained together, in numpy, on a
bounded sample of labelled documents; a document's score is its worst window's, over all overlapping windows of its whole
text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import byte_slices, held_out, mix64, small_batches, span_hashes, text_of, utf8_buffer, word_spans
from keyloom.llm.sampling import labelled

#: The bound of the training sample: documents per label, and code points of a document.
PER_CLASS, MAX_CHARS = 1500, 30_000
#: Tokens of a window and between window starts, and hidden units per direction.
WINDOW, STRIDE, HIDDEN = 48, 24, 8
#: Bytes of character n-grams, numbers of embeddings for words and for n-grams at most, and their width. A word or
#: n-gram has one if it is in this number of documents of the sample.
GRAMS, MOST_WORDS, MOST_GRAMS, WIDTH, WORD_DOCS, GRAM_DOCS = (3, 5), 1 << 16, 1 << 17, 6, 2, 3
#: Each token's inputs: its word's embedding, the mean and the largest of its n-grams' embeddings, its length.
INPUTS = 3 * WIDTH + 1
TOXIC = 0.3

_APART = np.ones(256, bool)
for _c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789":
    _APART[_c] = False
_APART[128:] = False


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of every text: token hashes, the text of each token, lower-cased bytes, and token starts and ends.

    A token is a run of ASCII letters, digits and non-ASCII bytes, so signs that are stuck to a word don't change it.
    """
    low, offsets = utf8_buffer(pc.utf8_lower(texts.cast(pa.large_string())))
    starts, ends, doc = word_spans(low, offsets, _APART)
    return span_hashes(low.astype(np.uint64) + np.uint64(1), starts, ends), doc, low, starts, ends


def grams(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of the given tokens, with a sign for the token's edges, and the token of each, in order."""
    size = ends - starts + 2
    base = np.cumsum(size) - size
    total = int(size.sum())
    of = np.repeat(np.arange(len(starts)), size)
    j = np.arange(total) - base[of]
    inside = (j > 0) & (j < size[of] - 1)
    c = np.full(total + max(GRAMS), 1, np.uint64)
    if total:
        c[:total] = np.where(inside, low[np.clip(starts[of] + j - 1, 0, max(len(low) - 1, 0))] if len(low) else 0, 32)
    out, who = [], []
    with np.errstate(over="ignore"):
        packed = np.zeros(total, np.uint64)
        for n in range(1, max(GRAMS) + 1):
            packed = packed | (c[n - 1 : n - 1 + total] << np.uint64(8 * (n - 1)))
            if n in GRAMS:
                whole = j + n <= size[of]
                out.append(mix64(packed[whole] + (np.uint64(n) << np.uint64(56))))
                who.append(of[whole])
    if not out or not total:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    hashes, token = np.concatenate(out), np.concatenate(who)
    order = np.argsort(token, kind="stable")
    return hashes[order], token[order]


def _odds(toxic: np.ndarray, clean: np.ndarray, n_toxic: float, n_clean: float) -> np.ndarray:
    """Smoothed log odds of presence in toxic against clean documents, clipped."""
    a = (toxic + 0.5) / (n_toxic + 1)
    b = (clean + 0.5 * n_clean / max(n_toxic, 1.0)) / (n_clean * (1 + 1 / max(n_toxic, 1.0)))
    return np.clip(np.log(a / b), -4, 4).astype(np.float32) / 2


class Embeddings:
    """Embeddings of the words and n-grams that the sample has often enough; row 0, of all others, stays zero.

    They start from small random numbers, and their first number from the log odds of presence in toxic documents. While
    learning from a document, that start leaves the document itself out: ``without`` has what to add for clean and for
    toxic documents.
    """

    def __init__(self, y: np.ndarray, hashes: np.ndarray, doc: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 17):
        rng = np.random.default_rng(seed)
        one, first, back = np.unique(hashes, return_index=True, return_inverse=True)
        n = np.array([(y == 0).sum(), (y == 1).sum()], np.float64)
        seen = np.zeros((2, len(one)))
        g, of = grams(low, starts[first], ends[first])
        names, at = np.unique(g, return_inverse=True)
        begins = np.searchsorted(of, np.arange(len(one) + 1))
        seen_grams = np.zeros((2, len(names)))
        cuts = np.searchsorted(doc, np.arange(len(y) + 1))
        for d in range(len(y)):  # one document's tokens at a time
            mine = np.unique(back[cuts[d] : cuts[d + 1]])
            seen[y[d], mine] += 1
            if len(mine):
                size = begins[mine + 1] - begins[mine]
                k = np.repeat(begins[mine] - (np.cumsum(size) - size), size) + np.arange(size.sum())
                seen_grams[y[d], np.unique(at[k])] += 1
        self.words, self.E, of_words = self._table(one, seen, n, WORD_DOCS, MOST_WORDS, rng)
        self.names, self.G, of_grams = self._table(names, seen_grams, n, GRAM_DOCS, MOST_GRAMS, rng)
        self.without = (of_words, of_grams)

    @staticmethod
    def _table(names: np.ndarray, seen: np.ndarray, n: np.ndarray, least: int, most: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kept = np.flatnonzero(seen.sum(0) >= least)
        if len(kept) > most:
            kept = np.sort(kept[np.lexsort((names[kept], -seen.sum(0)[kept]))[:most]])
        clean, toxic = seen[0][kept], seen[1][kept]
        table, without = rng.normal(0, 0.1, (len(kept) + 1, WIDTH)).astype(np.float32), np.zeros((2, len(kept) + 1), np.float32)
        table[0], table[1:, 0] = 0, _odds(toxic, clean, n[1], n[0])
        without[0, 1:] = _odds(toxic, np.maximum(clean - 1, 0), n[1], max(n[0] - 1, 1)) - table[1:, 0]
        without[1, 1:] = _odds(np.maximum(toxic - 1, 0), clean, max(n[1] - 1, 1), n[0]) - table[1:, 0]
        return names[kept], table, without

    @staticmethod
    def _rows(names: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        if not len(names):
            return np.zeros(len(hashes), np.int64)
        k = np.minimum(np.searchsorted(names, hashes), len(names) - 1)
        return np.where(names[k] == hashes, k + 1, 0)

    def rows(self, hashes: np.ndarray, low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the given tokens: word rows, n-gram rows one token after the other, where each token's begin, and lengths."""
        g, of = grams(low, starts, ends)
        return self._rows(self.words, hashes), self._rows(self.names, g), np.searchsorted(of, np.arange(len(hashes))), np.minimum(ends - starts, 30).astype(np.float32) / 15

    def inputs(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], label: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """Inputs of tokens, and what their gradients need; ``label`` is that of the sample document each comes from."""
        words, all_grams, begins, lengths = rows
        out = np.zeros((len(words), INPUTS), np.float32)
        out[:, -1] = lengths
        if not len(words):
            return out, ()
        out[:, :WIDTH] = self.E[words]
        g = self.G[all_grams]
        n = np.diff(np.append(begins, len(all_grams)))[:, None]
        if label is not None:
            out[:, 0] += self.without[0][label, words]
            g[:, 0] += self.without[1][np.repeat(label, n[:, 0]), all_grams]
        out[:, WIDTH : 2 * WIDTH] = np.add.reduceat(g, begins, axis=0) / n
        out[:, 2 * WIDTH : 3 * WIDTH] = np.maximum.reduceat(g, begins, axis=0)
        return out, (g, n)

    def gradients(self, rows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], x: np.ndarray, saved: tuple, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of both tables from those of the inputs x."""
        words, all_grams, _, _ = rows
        g, n = saved
        of = np.repeat(np.arange(len(words)), n[:, 0])
        largest = g == x[of, 2 * WIDTH : 3 * WIDTH]
        each = (dx[:, WIDTH : 2 * WIDTH] / n)[of] + np.where(largest, dx[of, 2 * WIDTH : 3 * WIDTH], 0)
        dE, dG = np.zeros_like(self.E), np.zeros_like(self.G)
        for k in range(WIDTH):
            dE[:, k] = np.bincount(words, dx[:, k], minlength=len(self.E))
            dG[:, k] = np.bincount(all_grams, each[:, k], minlength=len(self.G))
        dE[0], dG[0] = 0, 0
        return dE, dG


def windows(n_tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First token (over all texts), number of tokens and text of every overlapping window."""
    n = np.where(n_tokens == 0, 0, np.maximum(1, -(-(n_tokens - WINDOW) // STRIDE) + 1))
    of = np.repeat(np.arange(len(n_tokens)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    base = np.cumsum(n_tokens) - n_tokens
    return base[of] + k * STRIDE, np.minimum(WINDOW, n_tokens[of] - k * STRIDE), of


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return np.float32(0.5) * (1 + np.tanh(np.float32(0.5) * x))


class RecurrentScorer:
    """Two GRUs, one per direction; weights softmax(v.tanh(hA)) over a window's steps; score of the weighted states."""

    def __init__(self, seed: int = 11):
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"W{d}"] = rng.normal(0, 0.5, (INPUTS, 3 * h))
            self.p[f"U{d}"] = rng.normal(0, 0.4, (h, 3 * h))
            self.p[f"c{d}"] = np.zeros(3 * h)
        self.p |= {"A": rng.normal(0, 0.4, (2 * h, h)), "v": rng.normal(0, 0.5, h), "o": rng.normal(0, 0.5, 2 * h), "b": np.full(1, -1.0)}
        self.p = {k: x.astype(np.float32) for k, x in self.p.items()}

    def _steps(self, d: str, inputs: np.ndarray, mask: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States of all steps (steps, windows, hidden); inputs are projected; a masked step carries the state on."""
        u, h = self.p[f"U{d}"], HIDDEN
        steps = range(len(inputs)) if d == "f" else range(len(inputs) - 1, -1, -1)
        state = np.zeros((inputs.shape[1], h), np.float32)
        out, saved = np.empty((len(inputs), inputs.shape[1], h), np.float32), []
        for t in steps:
            rec = state @ u
            gates = _sigmoid(inputs[t, :, : 2 * h] + rec[:, : 2 * h])
            r, z = gates[:, :h], gates[:, h:]
            n = np.tanh(inputs[t, :, 2 * h :] + r * rec[:, 2 * h :])
            new = z * state + (1 - z) * n
            m = mask[t][:, None]
            if keep:
                saved.append((t, state, r, z, n, rec[:, 2 * h :], m))
            state = np.where(m, new, state)
            out[t] = state
        return out, saved

    def run(self, projected: dict[str, np.ndarray], mask: np.ndarray, keep: bool = False) -> tuple[np.ndarray, tuple]:
        f, saved_f = self._steps("f", projected["f"], mask, keep)
        b, saved_b = self._steps("b", projected["b"], mask, keep)
        states = np.concatenate([f, b], axis=2)
        t = np.tanh(states @ self.p["A"])
        e = np.where(mask, t @ self.p["v"], np.float32(-30))
        a = np.exp(e - e.max(0))
        a /= a.sum(0)
        pooled = np.einsum("tn,tnh->nh", a, states)
        return _sigmoid(pooled @ self.p["o"] + self.p["b"]), (states, t, a, pooled, saved_f, saved_b)

    def project(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p[f"W{d}"] + self.p[f"c{d}"] for d in "fb"}

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
        """Gradients of the parameters and of x: (steps, windows, inputs)."""
        p, h = self.p, HIDDEN
        s, (states, t, a, pooled, saved_f, saved_b) = self.run(self.project(x), mask, True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        ds = (s - y) / len(y)
        g["o"], g["b"] = pooled.T @ ds, ds.sum(keepdims=True)
        dp = ds[:, None] * p["o"]
        da = np.einsum("tnh,nh->tn", states, dp)
        de = a * (da - (a * da).sum(0))
        dt = de[:, :, None] * p["v"] * (1 - t * t)
        g["v"] = np.einsum("tn,tnh->h", de, t)
        g["A"] = np.einsum("tni,tnj->ij", states, dt)
        dstates = a[:, :, None] * dp + dt @ p["A"].T
        into = np.zeros_like(x)
        for d, saved, part in (("f", saved_f, dstates[:, :, :h]), ("b", saved_b, dstates[:, :, h:])):
            carry = np.zeros((x.shape[1], h), np.float32)
            for step, before, r, z, n, rec_n, m in reversed(saved):
                dnew = np.where(m, carry + part[step], 0)
                carry = np.where(m, 0, carry + part[step])
                dn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (before - n) * z * (1 - z)
                dr = dn * rec_n * r * (1 - r)
                dx = np.concatenate([dr, dz, dn], 1)
                drec = np.concatenate([dr, dz, dn * r], 1)
                g[f"W{d}"] += x[step].T @ dx
                g[f"c{d}"] += dx.sum(0)
                into[step] += dx @ p[f"W{d}"].T
                g[f"U{d}"] += before.T @ drec
                carry = carry + dnew * z + drec @ p[f"U{d}"].T
        return g, into


def _gather(start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(steps, windows) token indices, padded with a window's last token, and the mask of real steps."""
    t = np.arange(int(size.max()))[:, None]
    return start + np.minimum(t, size - 1), t < size


class Detector:
    """Embeddings and network, trained together."""

    STEPS, BATCH, RATE, TABLE_RATE, DROPPED = 120, 192, 0.02, 0.05, 0.6

    def __init__(self, texts: pa.Array, y: np.ndarray, seed: int = 5):
        """Learned from texts with labels (0 or 1, both present).

        Labels are of documents, so the network learns from one window of each document, the one that it finds worst
        itself (at first, the one with the largest odds), and from as many windows drawn from clean documents. Word
        embeddings are left out at random, so that n-grams have to tell as well.
        """
        rng = np.random.default_rng(seed)
        hashes, doc, low, starts, ends = tokens(texts)
        self.tables, self.net = Embeddings(y, hashes, doc, low, starts, ends), RecurrentScorer()
        if not len(hashes):
            return
        _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        every = self.tables.rows(hashes[one], low, starts[one], ends[one])
        first, size, of = windows(np.bincount(doc, minlength=len(texts)))
        x, _ = self.tables.inputs(every)
        strong = np.concatenate([[0.0], np.cumsum((np.maximum(x[:, 0], 0) ** 2 + np.maximum(x[:, 2 * WIDTH], 0) ** 2)[back])])
        worst = strong[first + size] - strong[first]
        clean = np.flatnonzero(y[of] == 0)
        tables = {"E": self.tables.E, "G": self.tables.G}
        first_moment, second_moment = ({k: np.zeros_like(v) for k, v in self.net.p.items()} for _ in range(2))
        seen = {k: np.full_like(v, 1e-6) for k, v in tables.items()}
        for i in range(1, self.STEPS + 1):
            if i in (1, self.STEPS // 3, 2 * self.STEPS // 3):
                if i > 1:
                    worst = self._scores(back, every, first, size)
                order = np.lexsort((-worst, of))
                picked = order[np.concatenate([[True], of[order][1:] != of[order][:-1]])]
                more = rng.choice(clean, min(len(clean), len(picked)), replace=False) if len(clean) else clean
                picked = np.concatenate([picked, more])
            some = rng.choice(picked, min(self.BATCH, len(picked)), replace=False)
            index, mask = _gather(first[some], size[some])
            label = y[of[some]]
            used, at = np.unique(back[index] * 2 + label, return_inverse=True)
            rows = self._subset(every, used // 2)
            x, saved = self.tables.inputs(rows, used % 2)
            dropped = rng.random(len(used)) < self.DROPPED
            x[dropped, :WIDTH] = 0
            g, dx = self.net.gradients(x[at.reshape(index.shape)], mask, label.astype(np.float32))
            flat, where = dx.reshape(-1, INPUTS), at.ravel()
            per = np.stack([np.bincount(where, flat[:, k], minlength=len(used)) for k in range(INPUTS - 1)], 1).astype(np.float32)
            per[dropped, :WIDTH] = 0
            lr = self.RATE * min(1.0, 2 * (1 - (i - 1) / self.STEPS))
            for k, d in g.items():
                d = d + 1e-4 * self.net.p[k]
                first_moment[k] = 0.9 * first_moment[k] + 0.1 * d
                second_moment[k] = 0.99 * second_moment[k] + 0.01 * d * d
                self.net.p[k] = (self.net.p[k] - lr * (first_moment[k] / (1 - 0.9**i)) / (np.sqrt(second_moment[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
            for k, d in zip("EG", self.tables.gradients(rows, x, saved, per), strict=True):
                seen[k] += d * d
                tables[k] -= self.TABLE_RATE * d / np.sqrt(seen[k])

    @staticmethod
    def _subset(rows: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words, all_grams, begins, lengths = rows
        n = np.diff(np.append(begins, len(all_grams)))[which]
        new = np.cumsum(n) - n
        at = np.repeat(begins[which] - new, n) + np.arange(n.sum())
        return words[which], all_grams[at], new, lengths[which]

    def _scores(self, back: np.ndarray, rows: tuple, first: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The score of every window; tokens' inputs and their projections are made once per different token."""
        projected = self.net.project(self.tables.inputs(rows)[0])
        out = np.zeros(len(first), np.float32)
        for k in range(0, len(first), 8192):
            index, mask = _gather(first[k : k + 8192], size[k : k + 8192])
            at = back[index]
            out[k : k + 8192] = self.net.run({d: v[at] for d, v in projected.items()}, mask)[0]
        return out

    def worst_windows(self, texts: pa.Array) -> np.ndarray:
        """The largest window score of every text; a text without tokens has 0."""
        hashes, doc, low, starts, ends = tokens(texts)
        out = np.zeros(len(texts))
        if not len(hashes):
            return out
        _, one, back = np.unique(hashes, return_index=True, return_inverse=True)
        first, size, of = windows(np.bincount(doc, minlength=len(texts)))
        np.maximum.at(out, of, self._scores(back, self.tables.rows(hashes[one], low, starts[one], ends[one]), first, size))
        return out


def train(docs: DataFrame, labels: DataFrame) -> Detector | float:
    """Learned from a bounded sample; a constant score where the labels have one value only (0.0 without any)."""
    rows = labelled(docs, labels, "toxic", PER_CLASS, MAX_CHARS).select("doc_id", "text", "label").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["label"] for r in rows], np.int64)
    if not len(y) or y.min() == y.max():
        return float(y.max()) if len(y) else 0.0
    return Detector(pa.array([r["text"] for r in rows], pa.large_string()), y)


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: more likely toxic), predicted of every row.

    Null and empty texts score 0; repeated rows score the same; an empty table gives no rows; no other column of ``docs``
    is read.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels))  # some 8 MB, whatever the corpus
    small_batches(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for whole in batches:
            for b in byte_slices(whole, "text", 2 << 20):
                s = np.full(b.num_rows, m) if isinstance(m, float) else m.worst_windows(b.column("text"))
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s.astype(np.float64))], ["doc_id", "score"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
