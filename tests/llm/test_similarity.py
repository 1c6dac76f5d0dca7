"""Near-dedup and decontamination against brute force; DartMinHash against the weighted Jaccard similarity."""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import functions as F

from keyloom.llm import components, decontam, near_dup

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(t):
    w = WORD.findall(t)
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute_classes(rows):
    texts = {}
    for i, t in rows:
        texts.setdefault(i, t)
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    sets = {i: shingles(t) for i, t in texts.items()}
    for a in texts:
        for b in texts:
            if a < b and (texts[a] == texts[b] or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    return {i: root(i) for i in texts}


def test_classes(docs, nothing, rows):
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    wanted = brute_classes(rows)
    assert got == wanted and len(set(got.values())) < len(got) - 5
    kept = near_dup.keep_one(docs)
    assert set(kept.columns) == set(docs.columns)
    assert {r.doc_id for r in kept.select("doc_id").collect()} == set(wanted.values())
    assert near_dup.classes(nothing).count() == 0


def test_more_elections_change_nothing(docs, rows, monkeypatch):
    monkeypatch.setattr(near_dup, "BOUND", 0)
    monkeypatch.setattr(near_dup, "MOST_ELECTIONS", 4)
    assert {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()} == brute_classes(rows)


def exact_links(texts):
    """All pairs of different texts at a Jaccard similarity of 0.8 or more, by counting shared shingles."""
    sets = {i: shingles(t) for i, t in texts.items()}
    held, shared = defaultdict(list), Counter()
    for i, s in sets.items():
        for x in s:
            held[x].append(i)
    for ids in held.values():
        shared.update(itertools.combinations(ids, 2))
    return {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n) - 1e-9}


def test_recall_against_exact_similarities(spark):
    """On the whole table of sf0.01 no link between different texts is lost, and classes are as brute force gives them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    links = exact_links(texts)
    got = {r.doc_id: r.class_id for r in near_dup.classes(docs).collect()}
    found = sum(got[a] == got[b] for a, b in links)
    assert len(links) > 50 and found >= 0.95 * len(links)
    up = {i: i for i in texts}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    same = defaultdict(list)
    for i, t in texts.items():
        same[t].append(i)
    for a, b in [*links, *((ids[0], b) for ids in same.values() for b in ids[1:])]:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert got == {i: root(i) for i in texts}


def test_keep_one_keeps_columns_of_any_name(spark):
    rows = [(1, "same", 1, 2, 3, 4, 5), (2, "same", 6, 7, 8, 9, 10), (None, "own", 11, 12, 13, 14, 15)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, id long, `row` long, `__id` long, digest long, `a.b` long")
    got = near_dup.keep_one(odd)
    assert got.columns == odd.columns and {(r["a.b"], r["row"]) for r in got.collect()} == {(5, 2), (15, 12)}


def test_null_ids_stay_alone(spark):
    df = spark.createDataFrame([(None, "same"), (1, "same"), (2, "same"), (None, "x")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.class_id or 0) for r in near_dup.classes(df).collect())
    assert got == [(0, 0), (1, 1), (2, 1)]


def test_keep_one_counts_rows(spark, docs):
    """One row of each class, not one id: repeated rows and rows without an id are copies too."""
    assert near_dup.keep_one(docs).count() == len(set(brute_classes([(r.doc_id, r.text or "") for r in docs.collect()]).values()))
    long = " ".join(f"w{k}" for k in range(200))
    rows = [(1, "same", "a"), (1, "same", "a"), (1, "same", "b"), (2, "same", "c"), (None, "same", "d"), (None, "alone", "e"), (None, "alone", "e")]
    rows += [(7, "x y", "f"), (7, "z", "g"), (None, long, "h"), (None, long + " more", "i"), (None, None, "j"), (None, "", "k"), (-3, "minus", "l")]
    kept = near_dup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3))
    assert kept.columns == ["doc_id", "text", "lang"]
    got = [(r.doc_id, r.text or "") for r in kept.collect()]
    smallest = min(("x y", "z"), key=lambda t: hashlib.md5(t.encode()).digest())
    assert sorted(t for _, t in got if t not in (long, long + " more")) == sorted(["same", "alone", smallest, "", "minus"])
    assert {(1, "same"), (None, "alone"), (7, smallest), (-3, "minus")} <= set(got) and len(got) == 6


def test_a_repeated_id_is_the_text_with_the_smallest_digest(spark):
    """Whichever of an id's texts has the smallest digest is the one that is compared."""
    first = " ".join(f"w{k}" for k in range(100))
    other = " ".join(f"v{k}" for k in range(100))
    rows, wanted = [], {}
    for k in range(12):
        texts = [f"{first} a{k}", f"{other} b{k}"]
        chosen = min(texts, key=lambda t: hashlib.md5(t.encode()).digest())
        rows += [(10 + k, t) for t in texts]
        wanted[10 + k] = 1 if chosen.startswith("w0") else 2
    rows += [(1, first), (2, other)]
    assert set(wanted.values()) == {1, 2}
    got = {r.doc_id: r.class_id for r in near_dup.classes(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == wanted | {1: 1, 2: 2}


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(3)
    e = rng.integers(0, 1 << 63, 400, dtype=np.uint64)
    a, b = rng.integers(0, 4, 400), rng.integers(0, 4, 400)
    sig = near_dup.dart_signatures(np.concatenate([e, e]), np.concatenate([a, b]), np.repeat([0, 1], 400), 3, 1024)
    exact = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.05
    assert (sig[:2] != 0).all() and (sig[2] == 0).all()


def test_dart_signature_of_one_element_is_full():
    assert (near_dup.dart_signatures(np.array([5], np.uint64), np.array([1]), np.array([0]), 1) != 0).all()


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 7), (200, 201), (300, 300)], "a long, b long")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert all(got[k] == 0 for k in [*range(41), 100]) and got[201] == 200 and 300 not in got
    assert components.components(edges.limit(0)).count() == 0


def test_leaks(spark, docs, nothing, rows):
    parts = [WORD.findall(t) for _, t in rows]
    items = [(k, " ".join(w[a:b])) for k, (w, a, b) in enumerate([(parts[7], 20, 50), (parts[8], 0, 14), (parts[13], 900, 930), (parts[6], 10, 16), (parts[0], 0, 3)])]
    items += [(10, items[0][1].replace(" ", " zz ", 1)), (11, None), (12, ""), (13, "never seen words in any of these texts at all")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    wanted = set()
    for i, t in rows:
        for k, x in items:
            s = shingles(x or "")
            if s and len(s & shingles(t)) >= 0.8 * len(s):
                wanted.add((i, k, len(s & shingles(t)), len(s)))
    got = decontam.leaks(docs, bench)
    assert {tuple(r)[:4] for r in got.collect()} == wanted and len(wanted) >= 5
    clean = {r.doc_id for r in decontam.decontaminate(docs, bench).collect()}
    assert clean == {i for i, _ in rows} - {i for i, *_ in wanted}
    assert decontam.leaks(nothing, bench).count() == 0 and decontam.leaks(docs, bench.limit(0)).count() == 0


def test_decontaminate_sees_capitals_punctuation_and_short_items(spark):
    item = "the quick brown fox jumps over the lazy dog near the old river bank"
    texts = [f"start {item.upper()} end", "so (" + item.replace(" ", ", ") + ")!", f"plain {item} too", "nothing of it here at all", "they said: Grüße, WELT! and left", "grüße an die welt", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, item), (1, "Grüße Welt"), (2, "--"), (3, None)], "item_id long, text string")
    assert {r.doc_id for r in decontam.decontaminate(docs, bench).collect()} == {3, 5, 6}
    assert {r.doc_id for r in decontam.leaks(docs, bench).collect()} == {2}
    assert decontam.decontaminate(docs, bench.limit(0)).count() == len(texts)


def test_a_very_long_item_is_sent_once(spark, monkeypatch):
    """What is sent grows with the items, not with their squares; an item of 50,000 words is found in a longer text."""
    item = [f"w{k * 7919 % 50_021}" for k in range(50_000)]
    texts = ["before " + " ".join(item) + " after", " ".join(item[:39_000]), " ".join(item[5000:]), None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    bench = spark.createDataFrame([(0, " ".join(item)), (1, " ".join(item[100:130]))], "item_id long, text string")
    sent, broadcast = [], F.broadcast
    monkeypatch.setattr(decontam.F, "broadcast", lambda df: sent.append(df) or broadcast(df))
    got = {(r.doc_id, r.item_id) for r in decontam.leaks(docs, bench).collect()}
    assert got == {(0, 0), (0, 1), (1, 1), (2, 0)}
    wide = [df for df in sent if "item_shingles" in df.columns]
    assert sum(df.count() for df in wide) == 2  # each item once
    assert all(kind == "bigint" for df in sent if df not in wide for _, kind in df.dtypes)


def test_decontaminate_keeps_columns_of_any_name(spark):
    odd = spark.createDataFrame([(1, "one two three four five six", 1, 2), (2, None, 3, 4), (None, "x", 5, 6)], "doc_id long, text string, leaked long, `a.b` long")
    bench = spark.createDataFrame([(1, "two three four five six")], "item_id long, text string")
    got = decontam.decontaminate(odd, bench)
    assert got.columns == odd.columns and sorted(r["a.b"] for r in got.collect()) == [4, 6]


def test_leaks_in_blocks(spark, docs, rows, monkeypatch):
    bench = spark.createDataFrame([(k, " ".join(WORD.findall(rows[8][1])[k * 20 : k * 20 + 20])) for k in range(6)], "item_id long, text string")
    whole = sorted(map(tuple, decontam.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_SHINGLES", 30)
    assert sorted(map(tuple, decontam.leaks(docs, bench).collect())) == whole and whole


def test_sketch_is_never_too_small(spark):
    bench = spark.createDataFrame([(n, " ".join(f"w{n}x{k}" for k in range(n))) for n in range(5, 90)], "item_id long, text string")
    for r in decontam.sketch(bench).select("item_n", F.size("keys").alias("m")).collect():
        assert min(r.item_n, r.item_n - int(np.ceil(0.8 * r.item_n - 1e-9)) + 1) <= r.m


def test_signatures_do_not_depend_on_the_block(spark):
    texts = [f"one two three {i % 7} five six {i}" for i in range(3 * near_dup.TOGETHER + 5)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    together = {r.doc_id: r.sig for r in near_dup.signatures(rows).collect()}
    assert len(together) == len(texts)
    for i in (0, near_dup.TOGETHER - 1, near_dup.TOGETHER, len(texts) - 1):
        assert near_dup.signatures(rows.filter(rows.doc_id == i)).collect()[0].sig == together[i]
