"""Quality rules: base counts, and Jensen-Shannon distances to language references, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import SPACE_CLASS, SPACES, materialise, text_of, words_of

#: Base rule: fewer words than this, or more than this share of words in repeated 3-word windows, fails.
MIN_WORDS, MAX_REPEATED_PERCENT = 50, 50
#: Verdict: a distance (square root of the divergence in bits) may reach BASE + NOISE / sqrt(n_words), as the shares of
#: a short text stray more. Minimum lengths: character classes are judged from MIN_CLASS_CHARS code points of words on,
#: common words from MIN_COMMON_WORDS words on.
CLASS_BASE, CLASS_NOISE, WORD_BASE, WORD_NOISE = 0.12, 1.2, 0.09, 2.2
MIN_CLASS_CHARS, MIN_COMMON_WORDS = 300, 80
#: A common word of a language: this share of its words or more, so there are at most 1 / COMMON_SHARE of them. Counted
#: are documents of MIN_WORDS words or more, of which MIN_DIFFERENT are different.
COMMON_SHARE, MIN_DIFFERENT = 0.003, 25
#: A language has references of its own from this number of such documents on, and this share of all of them (so there
#: are at most 1 / MIN_LANG_SHARE); others are held against all documents.
MIN_LANG_DOCS, MIN_LANG_SHARE = 50, 0.001
#: Positions up to this number fit beside 48 bits of a window's hash in one long.
PACKED_POSITIONS = 1 << 16

#: Character classes: name and the characters taken away to count it. What is left after all is the class "other".
CLASSES = (("lower", "[a-z]+"), ("upper", "[A-Z]+"), ("space", SPACE_CLASS + "+"), ("digit", "[0-9]+"), ("stop", r"[.,;:?!'\"()-]+"), ("symbol", r"[#*$%&|<>]+"))


def repeated_words(words: str, n: str) -> str:
    """SQL: how many words lie in 3-word windows found twice or more; ``words`` and ``n`` are names of lambda variables.

    Windows are hashed, and sorted with their positions; equal neighbours mark positions, three words each. Up to
    PACKED_POSITIONS words the hash (48 bits) and the position share a long; longer texts sort pairs of 64-bit hash
    and position.
    """
    window = f"xxhash64(x, get({words}, i + 1), get({words}, i + 2))"
    packed = f"sort_array(transform(slice({words}, 1, greatest({n} - 2, 0)), (x, i) -> shiftleft({window}, 16) | i))"
    pairs = f"array_sort(transform(slice({words}, 1, greatest({n} - 2, 0)), (x, i) -> named_struct('h', {window}, 'i', i)))"

    def covered(found: str, same: str, place: str) -> str:
        twice = f"filter(s, (x, j) -> {same.format('x', 'get(s, j - 1)')} OR {same.format('x', 'get(s, j + 1)')})"
        spread = f"flatten(transform({twice}, x -> array({place}, {place} + 1, {place} + 2)))"
        return f"coalesce(aggregate(array({found}), cast(0 as bigint), (z, s) -> cast(size(array_distinct({spread})) as bigint)), 0)"

    short = covered(packed, "shiftright({0}, 16) = shiftright({1}, 16)", "cast(x & 65535 as int)")
    long = covered(pairs, "{0}.h = {1}.h", "x.i")
    return f"CASE WHEN {n} < 4 THEN cast(0 as bigint) WHEN {n} <= {PACKED_POSITIONS} THEN {short} ELSE {long} END"


def _word_counts() -> str:
    """SQL: an array of one struct with all counts of the words of ``text``; ``words`` has the common words to count.

    Lambda variables hold the words and the common words among them, so neither is ever computed twice.
    """
    found = f"array_remove(split(text, '{SPACE_CLASS}+', -1), '')".replace("\\", "\\\\")
    each = "transform(words, c -> cast(size(k) - size(array_remove(k, c)) as double))"
    commons = f"transform(array(filter(w, x -> array_contains(words, x))), k -> concat({each}, array(cast(size(w) - size(k) as double))))[0]"
    return f"transform(array({found}), w -> named_struct('n_words', cast(size(w) as bigint), 'n_repeat_words', {repeated_words('w', 'size(w)')}, 'commons', {commons}))"


def vocabulary(docs: DataFrame) -> DataFrame:
    """lang, words, common_ref: the common words of each language and of all documents (a null language).

    common_ref: their shares, in order, then that of all other words. Each text is split once, words are counted
    with map-side aggregation; the empty word counts the documents.
    """
    counted_words = lambda w: F.when((F.size(w) >= MIN_WORDS) & (F.size(F.array_distinct(w)) >= MIN_DIFFERENT), F.concat(w, F.array(F.lit(""))))
    of_text = F.get(F.transform(F.array(words_of(text_of())), counted_words), F.lit(0))
    each = docs.select(F.col("lang").cast("string").alias("lang"), F.explode_outer(of_text).alias("word")).filter(F.col("word").isNotNull())
    counted = materialise(each.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")))
    of_docs = counted.filter("word = ''").select(F.col("lang").alias("of"), F.col("n").alias("n_docs"))
    every = of_docs.agg(F.sum("n_docs")).first()[0] or 0
    large = of_docs.filter(F.col("of").isNotNull() & (F.col("n_docs") >= max(MIN_LANG_DOCS, MIN_LANG_SHARE * every))).select("of")
    mine = counted.join(F.broadcast(large), F.col("lang") == F.col("of"), "left_semi")  # 1 / MIN_LANG_SHARE rows at most
    both = mine.unionByName(counted.groupBy("word").agg(F.sum("n").alias("n")).withColumn("lang", F.lit(None).cast("string"))).filter("word <> ''")
    totals = both.groupBy(F.col("lang").alias("of")).agg(F.sum("n").cast("double").alias("total"))
    often = both.join(F.broadcast(totals), F.col("lang").eqNullSafe(F.col("of"))).filter(F.col("n") >= F.col("total") * COMMON_SHARE)
    share = F.struct("word", (F.col("n") / F.col("total")).alias("share"))
    listed = often.groupBy("lang").agg(F.array_sort(F.collect_list(share)).alias("c"))
    shares = F.col("c.share")
    rest = F.greatest(F.lit(0.0), 1.0 - F.aggregate(shares, F.lit(0.0), lambda a, x: a + x))
    return materialise(listed.select("lang", F.col("c.word").alias("words"), F.concat(shares, F.array(rest)).alias("common_ref")))


def measures(docs: DataFrame, commons: DataFrame) -> DataFrame:
    """doc_id, ref_lang, common_ref, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes and commons of every row.

    classes: code points by class; commons: counts of the common words (``vocabulary``) of the row's language, in order,
    then of all other words. ref_lang is the language that a row is held against, null for all documents.
    """
    read = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_of().alias("text"))
    by_lang = commons.filter("lang IS NOT NULL").select(F.col("lang").alias("ref_lang"), F.col("words").alias("own_words"), F.col("common_ref").alias("own_ref"))
    overall = commons.filter("lang IS NULL").select(F.struct("words", "common_ref").alias("o")).scalar()
    # 1 / MIN_LANG_SHARE rows of 1 / COMMON_SHARE words at most
    read = read.join(F.broadcast(by_lang), F.col("lang") == F.col("ref_lang"), "left").withColumn("o", overall)
    words = F.coalesce("own_words", F.col("o.words"), F.array().cast("array<string>"))
    read = read.select("doc_id", "ref_lang", "text", words.alias("words"), F.coalesce("own_ref", F.col("o.common_ref"), F.array(F.lit(1.0))).alias("common_ref"))
    left, steps = "text", []
    counts = read.withColumn("n0", F.length("text"))
    for k, (name, chars) in enumerate(CLASSES):  # each class is taken away from what the last one left
        counts = counts.withColumn(f"left{k}", F.regexp_replace(left, chars, "")).withColumn(f"n{k + 1}", F.length(f"left{k}"))
        left = f"left{k}"
        steps.append((F.col(f"n{k}") - F.col(f"n{k + 1}")).cast("double").alias(name))
    n_of = {name: F.col(f"n{k}") - F.col(f"n{k + 1}") for k, (name, _) in enumerate(CLASSES)}
    lines = F.filter(F.split("text", "\n", -1), lambda x: F.length(F.btrim(x, F.lit(SPACES))) > 0)
    repeated = F.transform(F.array(lines), lambda x: F.size(x) - F.size(F.array_distinct(x)))
    counts = counts.withColumn("n_dup_lines", F.when(F.instr("text", "\n") > 0, F.get(repeated, F.lit(0))).otherwise(0))
    counts = counts.withColumn("of_words", F.expr(_word_counts())).withColumn("of_words", F.get("of_words", F.lit(0)))
    return counts.select(
        "doc_id", "ref_lang", "common_ref", F.col("of_words.n_words").alias("n_words"),
        (F.col("n0") - n_of["space"]).cast("long").alias("word_chars"),
        n_of["symbol"].cast("long").alias("n_symbols"),
        F.col("n_dup_lines").cast("long").alias("n_dup_lines"),
        F.col("of_words.n_repeat_words").alias("n_repeat_words"),
        F.array(*steps, F.col(f"n{len(CLASSES)}").cast("double")).alias("classes"),
        F.col("of_words.commons").alias("commons"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def references(measured: DataFrame) -> DataFrame:
    """lang, class_ref: each language's shares over its documents that pass the base rule; the null language has all of them.

    Counts are added up per language with map-side aggregation: a row per language and task is shuffled.
    """
    n = len(CLASSES) + 1
    by_lang = measured.filter(~base_failed()).groupBy(F.col("ref_lang").alias("lang")).agg(*[F.sum(F.col("classes")[k]).alias(f"c{k}") for k in range(n)])
    names = [c for c in by_lang.columns if c != "lang"]
    every = by_lang.agg(*[F.sum(c).alias(c) for c in names]).select(F.lit(None).cast("string").alias("lang"), *names)
    both = by_lang.filter(F.col("lang").isNotNull()).unionByName(every)
    total = reduce(lambda a, b: a + b, [F.col(c) for c in names])
    return both.select("lang", F.array(*[F.when(total > 0, F.col(c) / total).otherwise(0.0) for c in names]).alias("class_ref"))


def js_distance(counts: str, ref: str) -> Column:
    """The Jensen-Shannon distance (base 2) between the shares of ``counts`` and ``ref``; null where counts are all 0."""
    total = f"aggregate({counts}, 0D, (a, x) -> a + x)"
    term = "0.5D * (CASE WHEN p > 0 THEN p * log2(2 * p / (p + q)) ELSE 0D END + CASE WHEN q > 0 THEN q * log2(2 * q / (p + q)) ELSE 0D END)"
    term = term.replace("p", "t.p").replace("q", "t.q").replace("t.t.", "t.")
    pairs = f"zip_with({counts}, {ref}, (x, y) -> named_struct('p', x / tot, 'q', y))"
    return F.expr(f"aggregate(array({total}), cast(null as double), (z, tot) -> CASE WHEN tot > 0 THEN sqrt(greatest(0D, aggregate({pairs}, 0D, (a, t) -> a + {term}))) END)")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, class_distance, word_distance.

    A document is kept if the base rule passes and neither histogram is farther from its language's reference than
    allowed; a text that is too short for a histogram is not judged by it. The common words and both references are
    learned from the documents themselves, without the ones that fail the base rule or have few different words; a
    language that is null or rare is held against all documents. Null texts have no words and fail; repeated rows are
    rows of their own; an empty table gives none; only doc_id, lang and text are read.
    """
    measured = materialise(measures(docs, vocabulary(docs)))
    refs = references(measured)
    joined = measured.join(refs, F.col("ref_lang").eqNullSafe(F.col("lang")), "left")
    far = joined.withColumn("class_distance", js_distance("classes", "class_ref")).withColumn("word_distance", js_distance("commons", "common_ref"))
    failed = base_failed()
    noise = F.sqrt(F.greatest(F.col("n_words"), F.lit(1)).cast("double"))
    near_class = (F.col("word_chars") < MIN_CLASS_CHARS) | (F.coalesce("class_distance", F.lit(0.0)) <= CLASS_BASE + CLASS_NOISE / noise)
    near_words = (F.col("n_words") < MIN_COMMON_WORDS) | (F.coalesce("word_distance", F.lit(0.0)) <= WORD_BASE + WORD_NOISE / noise)
    return far.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"), (~failed & near_class & near_words).alias("kept"), "class_distance", "word_distance",
    )


def _oracle() -> str:
    """The same rules as SQL for DuckDB."""
    steps, left = [], "text"
    for k, (_, chars) in enumerate(CLASSES):
        quoted = chars.replace("'", "''").replace("\\'", "'")
        steps.append(f"l{k} AS (SELECT *, regexp_replace({left}, '{quoted}', '', 'g') AS left{k} FROM {f'l{k - 1}' if k else 't'})")
        left = f"left{k}"
    sizes = ["length(text)", *[f"length(left{k})" for k in range(len(CLASSES))]]
    counts = [f"({a} - {b})::DOUBLE" for a, b in zip(sizes, sizes[1:], strict=False)] + [f"{sizes[-1]}::DOUBLE"]
    n_c = len(CLASSES) + 1
    total = ", ".join(f"sum(c[{k + 1}])" for k in range(n_c))

    def distance(counted: str, ref: str, n: str) -> str:
        p, q = f"({counted}[i] / list_sum({counted}))", f"({ref}[i] / list_sum({ref}))"
        part = f"0.5::DOUBLE * (CASE WHEN {p} > 0 THEN {p} * log2(2 * {p} / ({p} + {q})) ELSE 0 END + CASE WHEN {q} > 0 THEN {q} * log2(2 * {q} / ({p} + {q})) ELSE 0 END)"
        return f"CASE WHEN list_sum({counted}) > 0 THEN sqrt(greatest(0.0::DOUBLE, list_sum(list_transform(range(1, {n} + 1), lambda i: {part})))) END"

    failed = f"(n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED_PERCENT} * n_words)"
    return f"""
WITH t AS (SELECT doc_id, lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
vd AS (SELECT lang, w FROM t WHERE len(w) >= {MIN_WORDS} AND len(list_distinct(w)) >= {MIN_DIFFERENT}),
big AS (SELECT lang FROM vd WHERE lang IS NOT NULL GROUP BY lang HAVING count(*) >= greatest({MIN_LANG_DOCS}, {MIN_LANG_SHARE}::DOUBLE * (SELECT count(*) FROM vd))),
vw AS (SELECT lang, unnest(w) AS word FROM vd),
vn AS (SELECT lang AS ref, word, count(*) AS n FROM vw WHERE lang IN (SELECT lang FROM big) GROUP BY lang, word UNION ALL SELECT NULL, word, count(*) FROM vw GROUP BY word),
vt AS (SELECT *, n / (sum(n) OVER (PARTITION BY ref))::DOUBLE AS share FROM vn),
g AS (SELECT ref, list(word ORDER BY word) AS words, list(share ORDER BY word) AS shares FROM vt WHERE share >= {COMMON_SHARE}::DOUBLE GROUP BY ref),
gr AS (SELECT ref, words, list_append(shares, greatest(0.0::DOUBLE, 1 - list_sum(shares))) AS rf FROM g),
{", ".join(steps)},
tri AS (SELECT doc_id, unnest(range(1, len(w) - 1)) AS p, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))) AS s FROM t),
twice AS (SELECT doc_id, s FROM tri GROUP BY doc_id, s HAVING count(*) > 1),
rep AS (SELECT doc_id, count(*) AS n FROM (SELECT DISTINCT doc_id, unnest(range(p, p + 3)) AS i FROM tri JOIN twice USING (doc_id, s)) GROUP BY doc_id),
m AS (SELECT doc_id, CASE WHEN lang IN (SELECT lang FROM big) THEN lang END AS ref, len(w)::BIGINT AS n_words, (length(text) - ({counts[2]}))::BIGINT AS word_chars, ({counts[5]})::BIGINT AS n_symbols, w,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
  [{", ".join(counts)}] AS c FROM l{len(CLASSES) - 1} LEFT JOIN rep USING (doc_id)),
wc AS (SELECT doc_id, word, count(*)::DOUBLE AS n FROM (SELECT doc_id, unnest(w) AS word FROM m) GROUP BY doc_id, word),
h AS (SELECT m.doc_id, u.word, u.pos, coalesce(wc.n, 0.0::DOUBLE) AS n FROM m JOIN (SELECT ref, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM gr) u ON m.ref IS NOT DISTINCT FROM u.ref LEFT JOIN wc ON wc.doc_id = m.doc_id AND wc.word = u.word),
hf AS (SELECT doc_id, list(n ORDER BY pos) AS f FROM h GROUP BY doc_id),
r AS (SELECT ref AS of, [{total}] AS rc FROM m WHERE ref IS NOT NULL AND NOT {failed} GROUP BY ref UNION ALL SELECT NULL, [{total}] FROM m WHERE NOT {failed}),
mm AS (SELECT m.*, list_append(hf.f, n_words - list_sum(hf.f)) AS f, gr.rf, r.rc FROM m JOIN hf USING (doc_id) JOIN gr ON m.ref IS NOT DISTINCT FROM gr.ref LEFT JOIN r ON m.ref IS NOT DISTINCT FROM r.of),
d AS (SELECT *, {distance("c", "rc", str(n_c))} AS cd, {distance("f", "rf", "len(f)")} AS wd, {failed} AS failed FROM mm)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, n_repeat_words, failed AS base_failed,
  NOT failed AND (word_chars < {MIN_CLASS_CHARS} OR coalesce(cd, 0) <= {CLASS_BASE} + {CLASS_NOISE}::DOUBLE / sqrt(greatest(n_words, 1)::DOUBLE)) AND (n_words < {MIN_COMMON_WORDS} OR coalesce(wd, 0) <= {WORD_BASE} + {WORD_NOISE}::DOUBLE / sqrt(greatest(n_words, 1)::DOUBLE)) AS kept,
  round(cd, 6) AS class_distance, round(wd, 6) AS word_distance FROM d
"""


ORACLE = _oracle()
