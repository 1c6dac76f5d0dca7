"""Token counts, mixing, line dedup, substring dedup and quality counts against brute force."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from keyloom.llm import line_dedup, mixing, quality_rules, substring, token_count

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_token_counts_are_the_librarys(docs, nothing, rows):
    from tokenizers import Tokenizer

    t = Tokenizer.from_str(token_count.tokenizer_json())
    wanted = sorted((i, len(x.encode()), len(t.encode(x, add_special_tokens=False).ids)) for i, x in rows)
    assert sorted(tuple(r) for r in token_count.count_tokens(docs).collect()) == wanted
    assert token_count.count_tokens(nothing).count() == 0


def test_mix_takes_what_the_targets_say(docs, nothing, rows):
    got = mixing.mix_report(docs).collect()
    assert Counter((r.doc_id, r["size"]) for r in got) == Counter((i, len(WORD.findall(x))) for i, x in rows)
    total, sources = sum(r["size"] for r in got), {r.source_size: r.target for r in got}
    assert abs(sum(sources.values()) - total) < 1e-6 and all(t <= 3 * s + 1e-9 for s, t in sources.items())
    assert all(r.taken <= 3 * r["size"] and r.taken >= int(min(3, r.target / max(r.source_size, 1))) * r["size"] for r in got)
    assert sorted(map(tuple, mixing.mix_report(docs.repartition(7)).collect())) == sorted(map(tuple, got))
    mixed = mixing.mix(docs)
    assert set(mixed.columns) == set(docs.columns) and mixed.agg(F.sum(mixing.doc_size()).alias("n")).first().n == sum(r.taken for r in got)
    assert mixing.mix_report(nothing).count() == 0 and mixing.mix(nothing).count() == 0


def test_rows_without_an_id_or_repeated_are_drawn_one_by_one(spark):
    rows = [(None, f"w{k} w w w", "a") for k in range(250)] + [(7, "same text here now", "a")] * 250
    rows += [(None, "same text again too", "b")] * 250 + [(k, f"only {k} x y", "c") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix_report(docs).collect()
    assert len(got) == len(rows)
    for size, target in {(r.source_size, r.target) for r in got}:
        parts = [sum(r.taken for r in got if r.source_size == size and r.target == target and (r.doc_id is None) == none) for none in (True, False)]
        assert abs(sum(parts) - target) < 0.15 * target
    assert sorted(map(str, mixing.mix_report(docs.repartition(7)).collect())) == sorted(map(str, got))
    odd = docs.limit(3).selectExpr("*", "1 AS size", "2 AS `a.b`", "3 AS id", "4 AS digest", "5 AS k")
    assert set(mixing.mix(odd).columns) == {*odd.columns, "copy_no"}
    mixing.mix(odd).collect()


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 1, 1000], [5, 0, 5], [0, 0], [1000, 1, 1, 1], [7]])
def test_targets_fill_up_like_water(spark, sizes):
    names = [f"s{k}" for k in range(len(sizes))]
    got = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(list(zip(names, sizes, strict=True)), "source string, source_size long")).collect()}
    weights = dict(zip(names, (5, 2, 1, 5), strict=False))
    left, open_, wanted = float(sum(sizes)), set(names), {}
    while open_:
        w = sum(weights[n] for n in open_)
        full = {n for n in open_ if left * weights[n] / w >= 3 * sizes[names.index(n)]}
        if not full:
            wanted |= {n: left * weights[n] / w for n in open_}
            break
        wanted |= {n: 3.0 * sizes[names.index(n)] for n in full}
        left -= sum(wanted[n] for n in full)
        open_ -= full
    assert got == pytest.approx(wanted)


def brute_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    held = defaultdict(set)
    for i, t in rows:
        for x in t.split("\n"):
            held[key(x)].add(i)
    out = []
    for i, t in rows:
        lines = t.split("\n")
        kept = [x for x in lines if not (len(key(x)) >= 20 and len(held[key(x)]) >= 3 and max(held[key(x)]) != i)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out)


def test_line_dedup(docs, nothing, rows):
    out = line_dedup.dedup_lines(docs)
    got = sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect())
    assert got == brute_lines(rows) and sum(r[2] for r in got) > 0
    assert set(out.columns) == {*docs.columns, "n_dropped"}
    assert line_dedup.dedup_lines(nothing).count() == 0


def test_line_dedup_with_shards_and_copies(docs, rows, monkeypatch):
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 1)
    monkeypatch.setattr(line_dedup, "TASK_PROBES", 2)
    assert sorted((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(docs).collect()) == brute_lines(rows)


def test_line_dedup_keeps_columns_of_any_name(spark):
    line = "this very line is in three documents"
    rows = [(i, f"{line}\nown {i}", i, i, i, i) for i in range(3)] + [(None, line, 7, 7, 7, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, `__lost` long, `a.b` long, of long, `own` long")
    out = line_dedup.dedup_lines(docs)
    assert sorted((str(r[0]), r["__lost"], r["a.b"], r["of"], r["own"], r["text"]) for r in out.collect()) == [
        ("0", 0, 0, 0, 0, "own 0"), ("1", 1, 1, 1, 1, "own 1"), ("2", 2, 2, 2, 2, f"{line}\nown 2"), ("None", 7, 7, 7, 7, "")]


def shard_of(rows):
    import pandas as pd

    return line_dedup._build(pd.DataFrame(rows, columns=["h1", "h2", "n_docs", "keeper"]).assign(shard=0))


def probed(shard, probes):
    import pandas as pd

    return [tuple(map(int, r)) for r in line_dedup._probe(pd.DataFrame(probes, columns=["doc_id", "h1", "h2"]), shard).itertuples(index=False)]


def test_documents_lose_what_the_count_array_says():
    shard = shard_of([(5, 50, 3, 9), (6, 60, 2, 9), (7, 70, 4, 1)])
    probes = [(1, 5, 50), (9, 5, 50), (1, 6, 60), (1, 7, 70), (2, 7, 70), (1, 8, 80), (1, 5, 51)]
    assert probed(shard, probes) == [(1, 5, 50), (2, 7, 70)]
    counts = np.frombuffer(shard["count"][0], np.int64)
    shard["count"] = [(5 - counts).tobytes()]  # 3, 2, 4 become 2, 3, 1
    assert probed(shard, probes) == [(1, 6, 60)]


def test_lines_that_share_half_a_hash_are_both_known():
    shard = shard_of([(5, 50, 3, 9), (5, 51, 4, 8), (5, 52, 2, 8), (-6, -60, 3, 9)])
    assert probed(shard, [(1, 5, 50), (1, 5, 51), (8, 5, 51), (1, 5, 52), (1, -6, -60)]) == [(1, 5, 50), (1, 5, 51), (1, -6, -60)]


def test_perfect_hash_round_trip():
    keys = np.random.default_rng(1).integers(0, 1 << 63, 20_000, dtype=np.uint64)
    h = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(keys).to_bytes())
    assert sorted(h.index(np.unique(keys))) == list(range(len(np.unique(keys)))) and len(h) == len(np.unique(keys))


def test_substring_dedup(docs, nothing, rows):
    words = [WORD.findall(t) for _, t in rows]
    n = Counter(tuple(w[k : k + 35]) for w in words for k in range(len(w) - 34))
    wanted = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 34):
            if n[tuple(w[k : k + 35])] > 1:
                gone[k : k + 35] = True
        wanted.append((i, " ".join(x for x, g in zip(w, gone, strict=True) if not g), len(w), int(gone.sum())))
    got = sorted(tuple(r) for r in substring.remove_repeats(docs).collect())
    assert got == sorted(wanted) and sum(r[3] for r in got) > 0
    assert substring.remove_repeats(nothing).count() == 0


def test_substring_dedup_in_small_blocks(docs, monkeypatch):
    once = sorted(tuple(r) for r in substring.remove_repeats(docs).collect())
    monkeypatch.setattr(substring, "BLOCK_BYTES", 3000)
    assert sorted(tuple(r) for r in substring.remove_repeats(docs).collect()) == once


def test_what_the_automata_locate_is_what_goes():
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(list("abcd"), 60)) for _ in range(3)]
    texts += [f"x {texts[0]} y", texts[1] + " z " + texts[1], "", "short"]
    # one place of a passage in the block is enough for all its occurrences; the third text is no passage
    got = substring.clean_block(texts, [(0, 0, 60, None), (1, 2, 41, [0, 1, 5, 6])])
    assert [r[1] for r in got] == [60, 41, 0, 60, 82, 0, 0]
    assert substring.runs([0, 1, 5, 6], 41) == [(0, 36), (5, 41)] and substring.runs([3], 50) == [(3, 38)] and substring.runs(None, 50) == [(0, 50)]
    assert got[3][2] == "x y" and got[2][2] == texts[2] and got[4][0] == 121
    assert substring.clean_block(texts, []) == [(len(t.split()), 0, t) for t in texts]


def test_automata_are_sharded_without_loss(monkeypatch):
    rng = np.random.default_rng(2)
    texts = [tuple(map(int, rng.integers(1, 4, 60))) for _ in range(30)] + [tuple(range(10, 70))] * 2
    patterns = sorted({t[k : k + 6] for t in texts[::3] for k in range(0, 50, 2)})
    once = substring.locate(patterns, texts)
    for t, hit in zip(texts, once, strict=True):
        at = {j for k in range(len(t) - 5) if t[k : k + 6] in set(patterns) for j in range(k, k + 6)}
        assert set(np.flatnonzero(hit)) == at
    monkeypatch.setattr(substring, "AUTOMATON_WORDS", 60)
    assert all((a == b).all() for a, b in zip(once, substring.locate(patterns, texts), strict=True))


def test_quality_counts(docs, nothing, rows):
    def counts(t):
        w = WORD.findall(t)
        grams = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
        twice = {j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(twice)

    got = quality_rules.judge(docs).collect()
    assert sorted(tuple(r)[:6] for r in got) == sorted((i, *counts(t)) for i, t in rows)
    assert all(r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept) for r in got)
    assert quality_rules.judge(nothing).count() == 0


def test_repeated_words_of_very_long_texts(docs, monkeypatch):
    counts = lambda: sorted(tuple(r) for r in quality_rules.measures(docs, quality_rules.vocabulary(docs)).select("doc_id", "n_repeat_words").collect())
    wanted = counts()
    monkeypatch.setattr(quality_rules, "PACKED_POSITIONS", 0)
    assert counts() == wanted


def test_references_are_learned_per_language(spark):
    rng = np.random.default_rng(6)
    voc = {"xx": [f"ba{k}" for k in range(400)], "yy": [f"zu{k}" for k in range(400)]}
    common = {"xx": ["ka", "ko", "ki", "ku"], "yy": ["sa", "so", "si", "su"]}

    def text(lang, n=200):
        return " ".join(str(x) for x in np.where(rng.random(n) < 0.3, rng.choice(common[lang], n), rng.choice(voc[lang], n)))

    rows = [(k, text(lang), lang) for k, lang in enumerate(["xx", "yy"] * 70)] + [(200, text("xx"), "rare"), (201, text("xx"), None), (202, None, "xx")]
    rows += [(300, text("yy"), "xx"), (301, text("yy", 60), "xx"), (302, " ".join(voc["xx"][:200]), "xx")]  # another language, too short to tell, no common words
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    learned = {r.lang: (set(r.words), sum(r.common_ref)) for r in quality_rules.vocabulary(docs).collect()}
    assert set(learned) == {"xx", "yy", None} and set(common["xx"]) <= learned["xx"][0] and not set(common["yy"]) & learned["xx"][0]
    assert all(abs(total - 1) < 1e-9 for _, total in learned.values())
    got = {r.doc_id: r for r in quality_rules.judge(docs).collect()}
    assert len(got) == len(rows) and sum(got[k].kept for k in range(140)) >= 138
    assert not got[300].kept and not got[302].kept and not got[202].kept
    assert got[301].kept and got[301].word_distance > 0.4  # under the minimum length the distance doesn't count


def test_sha_is_of_utf8():
    assert hashlib.sha256("é".encode()).hexdigest().startswith("4a99557e")
