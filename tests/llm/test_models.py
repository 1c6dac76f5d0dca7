"""The learned operators: gradients, held-out accuracy, defined results without labels, extraction."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import pytest

from keyloom.llm import html_main, quality_mil, queries, sampling, toxicity
from keyloom.llm.boosted_trees import BoostedTrees

DATA = "/root/testdata/sf0.01"


def area(score, label):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n = label.sum()
    return (rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))


@pytest.mark.parametrize(("name", "label", "least"), [("op4_quality_classifier", "quality", 0.95), ("op5_toxicity", "toxic", 0.82)])
def test_held_out_accuracy(spark, name, label, least):
    got = queries.QUERIES[name](spark, DATA)
    held = got.filter("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").toPandas()
    assert got.count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert held["score"].between(0, 1).all() and area(held["score"].to_numpy(), held[label].to_numpy()) >= least


def test_scores_without_labels(spark, docs, nothing):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {(r.score, r.predicted) for r in quality_mil.report(docs, labels).collect()} == {(1.0, 1)}
    assert {(r.score, r.predicted) for r in toxicity.score(docs, labels).collect()} == {(0.0, 0)}
    assert quality_mil.report(nothing, labels).count() == 0 and toxicity.score(nothing, labels).count() == 0


def test_scores_of_odd_texts(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(30)] + [(None, 1, 1)], "doc_id long, quality int, toxic int")
    for got in (quality_mil.report(docs, labels).collect(), toxicity.score(docs, labels).collect()):
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert set(quality_mil.accept(docs, labels).columns) == set(docs.columns)


def test_accept_keeps_columns_of_any_name(spark):
    odd = spark.createDataFrame([(1, "some text", 1, 2, 3), (None, None, 4, 5, 6)], "doc_id long, text string, score long, `__score` long, `a.b` long")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = quality_mil.accept(odd, labels)
    assert got.columns == odd.columns and sorted(r["a.b"] for r in got.collect()) == [3, 6]


def test_samples_settle_repeated_ids_and_conflicting_labels(spark):
    rows = [(1, "b"), (1, "a"), (1, "a"), (2, "x"), (3, "y"), (4, "too long a text"), (None, "z")]
    labels = [(1, 1), (1, 1), (2, 0), (2, 1), (3, 0), (4, 1), (5, 1), (None, 1)]
    held = {i for i in range(6) if zlib.crc32(str(i).encode()) % 4 == 2}
    smallest = min(("a", "b"), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    wanted = {(i, t, k) for i, t, k in ((1, smallest, 1), (3, "y", 0)) if i not in held}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for d in (docs, docs.repartition(4)):
        got = sampling.labelled(d, spark.createDataFrame(labels, "doc_id long, quality int"), "quality", 10, 10).collect()
        assert {(r.doc_id, r.text, r.label) for r in got} == wanted and len(got) == len(wanted)


def numeric_gradients_agree(model, grads, loss):
    for k, g in grads.items():
        flat = model.p[k].reshape(-1)
        for i in range(0, flat.size, max(1, flat.size // 4)):
            keep, eps = flat[i], 1e-3
            flat[i] = keep + eps
            up = loss()
            flat[i] = keep - eps
            down = loss()
            flat[i] = keep
            assert abs((up - down) / (2 * eps) - g.reshape(-1)[i]) < 2e-3, (k, i)


def cross_entropy(s, y):
    return float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean())


def test_attention_gradients():
    rng = np.random.default_rng(0)
    x, of, y = rng.normal(size=(12, quality_mil.FEATURES)).astype(np.float32), np.repeat([0, 1, 2], 4), np.array([0, 1, 1], np.float32)
    m = quality_mil.GatedAttention(np.zeros(quality_mil.FEATURES), np.ones(quality_mil.FEATURES))
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    numeric_gradients_agree(m, m.gradients(x, of, y), lambda: cross_entropy(m.forward(x, of)[0], y))


def test_recurrent_gradients():
    rng = np.random.default_rng(0)
    x, mask, y = rng.normal(size=(7, 3, toxicity.INPUTS)), np.ones((7, 3), bool), np.array([0, 1, 1.0])
    mask[4:, 1] = False
    m = toxicity.RecurrentScorer()
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}
    g, into = m.gradients(x, mask, y)
    numeric_gradients_agree(m, g, lambda: cross_entropy(m.run(m.project(x), mask)[0], y))
    for at in ((0, 0, 0), (3, 1, 5), (5, 1, 2), (6, 2, toxicity.INPUTS - 1)):
        near = [x.copy(), x.copy()]
        near[0][at] += 1e-4
        near[1][at] -= 1e-4
        up, down = (cross_entropy(m.run(m.project(z), mask)[0], y) for z in near)
        assert abs((up - down) / 2e-4 - into[at]) < 1e-4


def test_embedding_gradients():
    """Of both tables, through the mean and the largest of a token's n-grams."""
    texts, y = pa.array(["foo barbar foo", "barbar quux", "foo quux barbar"]), np.array([1, 0, 1])
    hashes, doc, low, starts, ends = toxicity.tokens(texts)
    t = toxicity.Embeddings(y, hashes, doc, low, starts, ends)
    t.E, t.G = t.E.astype(np.float64), t.G.astype(np.float64)
    rows = t.rows(hashes, low, starts, ends)
    assert (rows[0] > 0).all() and len(t.names)
    rng = np.random.default_rng(1)
    w = rng.normal(size=(len(hashes), toxicity.INPUTS)).astype(np.float32)
    x, saved = t.inputs(rows)
    for table, g in zip((t.E, t.G), t.gradients(rows, x, saved, w), strict=True):
        for at in zip(*(rng.integers(0, n, 6) for n in table.shape), strict=True):
            if not at[0]:
                continue
            keep, eps = table[at], 1e-3
            table[at] = keep + eps
            up = float((t.inputs(rows)[0] * w).sum())
            table[at] = keep - eps
            down = float((t.inputs(rows)[0] * w).sum())
            table[at] = keep
            assert abs((up - down) / (2 * eps) - g[at]) < 2e-2


def test_starts_leave_the_document_itself_out():
    texts, y = pa.array(["only here", "only", "other", "other here", "none of it"]), np.array([1, 1, 0, 0, 0])
    hashes, doc, low, starts, ends = toxicity.tokens(texts)
    t = toxicity.Embeddings(y, hashes, doc, low, starts, ends)
    rows = t.rows(hashes, low, starts, ends)
    whole, left_out = t.inputs(rows)[0][:, 0], t.inputs(rows, y[doc])[0][:, 0]
    assert whole[0] > left_out[0] and whole[3] < left_out[3]  # "only" is toxic, "other" is clean


def test_long_and_odd_tokens():
    texts = pa.array(["x" * 100_000, None, "", "É" * 3000 + " ÀB", "\u0000"])
    hashes, doc, low, starts, ends = toxicity.tokens(texts)
    g, of = toxicity.grams(low, starts, ends)
    assert len(g) and (np.diff(of) >= 0).all() and set(of) <= set(range(len(hashes)))
    assert toxicity.tokens(pa.array(["ÀÉ Ab"]))[0].tolist() == toxicity.tokens(pa.array(["àé aB"]))[0].tolist()


def test_windows_cover_every_token():
    first, size, of = toxicity.windows(np.array([0, 1, 47, 48, 49, 500]))
    base = np.cumsum([0, 0, 1, 47, 48, 49])
    for d, n in enumerate((0, 1, 47, 48, 49, 500)):
        seen = {t for f, s, o in zip(first, size, of, strict=True) if o == d for t in range(f - base[d], f - base[d] + s)}
        assert seen == set(range(n))


def test_passages_of_empty_texts():
    x, of = quality_mil.passages(pa.array([None, "", "a b c " * 100, "\n"]))
    assert list(of) == [0, 1, *[2] * 7, 3] and not x[0].any() and np.isfinite(x).all()


def test_boosted_trees_learn_xor():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((BoostedTrees(20).fit(x, y).margin(x) > 0) == y).mean() > 0.97


def test_extraction_on_pages_not_trained_on():
    model = html_main.trained()
    same = 0
    for seed in range(50_000, 50_060):
        plain, marked = html_main.compose(seed)
        nodes, pieces = html_main.parse(plain)
        known = np.array([x.index == 0 or "data-main" in x.attrs for x in html_main.parse(marked)[0]])
        same += html_main.extract_all([plain], model)[0] == html_main.text_of_kept(nodes, pieces, known)
    assert same >= 55


def test_decoding_never_contradicts():
    nodes, _ = html_main.parse(html_main.compose(3)[0])
    kept = html_main.decode(nodes, np.random.default_rng(1).normal(size=len(nodes)))
    assert all(kept[x.parent.index] for x in nodes[1:] if kept[x.index])


def test_extraction_of_a_page():
    page = "<html><body><nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><article><h1>A &amp; B</h1><p>First  paragraph\nhere, with some more words in it.<p>Second one, which is longer than the first by some words.</article><div class=comments><p>Nice one!</p></div><footer>&copy; Me</footer>"
    got = html_main.extract_all([page, "", "plain text, no markup", "<"], html_main.trained())
    assert got[0] == "A & B\nFirst paragraph here, with some more words in it.\nSecond one, which is longer than the first by some words."
    assert got[1] == ""


def test_main_text_rows(spark):
    pages = spark.createDataFrame([(1, "u", None), (1, "u", None), (2, None, "<article><p>hello there, all of you.</p></article>")], "page_id long, url string, html string")
    got = html_main.main_text(pages).collect()
    assert sorted((r.page_id, r.n_chars == len(r.text)) for r in got) == [(1, True), (1, True), (2, True)]
    assert html_main.main_text(pages.limit(0)).count() == 0
