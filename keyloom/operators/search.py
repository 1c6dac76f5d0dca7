"""Search indexes over documents: BM25, filters, rank fusion."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyloom.functions.ranges import score_between

# Default ranking parameters, the largest number of different query terms, and the rank offset of fusion.
K1, B = 1.2, 0.75
MAX_QUERY_TERMS, RANK_OFFSET, LEGS = 64, 60.0, 4
#: Characters that always end a token, and those that are only cut off its ends.
ENDS = "\\x00-\\x20\"'`()\\[\\]{}<>|\\\\,;:!?"
EDGES = "-._+=*/&%@#~$^"


def tokens(text: Column) -> Column:
    """Tokens of a text: split at ENDS, EDGES cut off, ASCII letters lowered, empty ones dropped.

    The edges of all tokens are cut off in one pass over the whole text: runs of EDGES with nothing but an end before or
    after them.
    """
    edge = "[" + re.escape(EDGES) + "]+"
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    bare = F.regexp_replace(lowered, f"(?<![^{ENDS}]){edge}|{edge}(?![^{ENDS}])", "")
    return F.array_remove(F.split(bare, f"[{ENDS}]+", -1), "")


def postings(docs: DataFrame) -> DataFrame:
    """doc_id, term, tf, dl: one row per document and term, with the document's length in tokens."""
    t = docs.select("doc_id", tokens(F.col("text")).alias("t")).select("doc_id", F.size("t").alias("dl"), F.explode("t").alias("term"))
    return t.groupBy("doc_id", "dl", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(text: str) -> list[str]:
    parts = re.split(f"[{ENDS}]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    return list(dict.fromkeys(p for p in (x.strip(EDGES) for x in parts) if p))[:MAX_QUERY_TERMS]


def term_counts(docs: DataFrame, terms: list[str]) -> DataFrame:
    """doc_id, c: the text's number of tokens, then how often it has each term.

    The tokens are the variable of an outer lambda and c comes out of a generator, so no rewrite of the plan splits a
    text twice.
    """
    counts = lambda t: F.array(F.size(t), *[F.size(t) - F.size(F.array_remove(t, w)) for w in terms])
    return docs.select("doc_id", F.explode_outer(F.transform(F.array(tokens(F.col("text"))), counts)).alias("c"))


def bm25(docs: DataFrame, query: str, k1: float = K1, b: float = B) -> DataFrame:
    """doc_id and score of every document that has a query term.

    Only the query's terms are counted: a document's tokens never leave its row, and what is aggregated over documents is
    one row of counts. Each text is split once for the counts and once for the scores.
    """
    terms = query_terms(query)
    if not terms:
        return docs.limit(0).select("doc_id", F.lit(0.0).alias("score"))
    t = term_counts(docs, terms)
    length, tf = F.get("c", F.lit(0)), [F.get("c", F.lit(i + 1)) for i in range(len(terms))]
    stats = t.agg(F.struct(F.count(F.lit(1)).alias("n"), F.avg(length.cast("double")).alias("avgdl"), *[F.count_if(x > 0).alias(f"df{i}") for i, x in enumerate(tf)]).alias("s")).scalar()
    found = t.filter(F.exists(F.slice("c", 2, len(terms)), lambda x: x > 0)).select("doc_id", "c", stats.alias("s"))
    score = F.lit(0.0)
    for i, x in enumerate(tf):
        n, df = F.col("s.n"), F.col(f"s.df{i}")
        idf = F.log(1 + (n - df + 0.5) / (df + 0.5))
        score = score + F.when(x > 0, idf * x * (k1 + 1) / (x + k1 * (1 - b + b * F.greatest(length, F.lit(1)) / F.col("s.avgdl")))).otherwise(0.0)
    return found.select("doc_id", score.alias("score"))


def top(rows: DataFrame, k: int, ascending: bool = False) -> DataFrame:
    """The k best rows with rank from 0; ties to the smaller doc_id."""
    order = [F.col("score").asc() if ascending else F.round("score", 12).desc(), F.col("doc_id")]
    return rows.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)


def fuse(vector: DataFrame, text: DataFrame, k: int, alpha: float = 0.5) -> DataFrame:
    """Reciprocal rank fusion of two ranked legs (doc_id, rank): (1 - alpha) / (60 + rank) + alpha / (60 + rank)."""
    v = vector.select("doc_id", F.col("rank").alias("rv"))
    t = text.select("doc_id", F.col("rank").alias("rt"))
    part = lambda w, r: F.coalesce(F.lit(w) / (RANK_OFFSET + F.col(r)), F.lit(0.0))
    return top(v.join(t, "doc_id", "full").select("doc_id", (part(1.0 - alpha, "rv") + part(alpha, "rt")).alias("score")), k)


def tag_match(col: Column, tags: list[str], separator: str = ",", case_sensitive: bool = False) -> Column:
    """Whether one of the separated, trimmed tags is among ``tags``."""
    fold = (lambda x: x) if case_sensitive else F.lower
    wanted = [t.strip() if case_sensitive else t.strip().lower() for t in tags]
    return F.exists(F.split(col, re.escape(separator)), lambda x: F.trim(fold(x)).isin(wanted))


def filter_clause(expression: str, tag_fields: set[str]) -> Column:
    """The condition of ``@f:[lo hi] @g:{a|b}``: all clauses hold, at most four; alternatives and negation are refused."""
    if expression.strip() in ("", "*"):
        return F.lit(True)
    found = re.findall(r"@(\w+):(?:\[([^\]]*)\]|\{([^}]*)\})", expression)
    rest = re.sub(r"@\w+:(?:\[[^\]]*\]|\{[^}]*\})", "", expression).replace("(", "").replace(")", "").strip()
    if rest or not found or len(found) > 4:
        raise ValueError("filters are up to four clauses that all hold")
    out = F.lit(True)
    for name, numbers, tags in found:
        if tags:
            if name not in tag_fields:
                raise ValueError(f"{name} is no tag field")
            out = out & tag_match(F.col(name).cast("string"), tags.split("|"))
        else:
            low, high = numbers.split()
            number = F.col(name).cast("string").try_cast("double")
            out = out & F.coalesce(score_between(number, low, high), F.lit(False))
    return out


def sort_by(rows: DataFrame, field: str, descending: bool = False, slot: str = "doc_id") -> DataFrame:
    """Missing values last either way; ties by slot, turned round when descending."""
    order = [F.col(field).isNull().asc(), F.col(field).desc() if descending else F.col(field).asc(), F.col(slot).desc() if descending else F.col(slot).asc()]
    return rows.orderBy(*order)


@dataclass(frozen=True)
class Index:
    """FT.CREATE: a name, the prefixes of its keys, and the fields of its schema with their types.

    An index is a view: what is stored under its prefixes, before or after it was made, is in it.
    """

    name: str
    prefixes: tuple[str, ...]
    fields: dict[str, str]

    def __post_init__(self) -> None:
        wrong = [k for k, kind in self.fields.items() if kind not in ("VECTOR", "TAG", "NUMERIC", "TEXT")]
        if wrong or not self.fields:
            raise ValueError(f"no such field types: {wrong}")

    def rows(self, hashes: DataFrame) -> DataFrame:
        """key and a typed column per field of every hash under a prefix; a field that it lacks, or no number, is null."""
        own = F.lit(False)
        for p in self.prefixes or ("",):
            own = own | F.startswith(F.col("key"), F.lit(p))
        value = lambda k: F.max(F.when(F.col("field") == k, F.col("value").cast("string")))
        typed = {"NUMERIC": lambda c: c.try_cast("double"), "VECTOR": lambda c: F.from_json(c, "array<float>")}
        columns = [typed.get(kind, lambda c: c)(value(k)).alias(k) for k, kind in self.fields.items()]
        return hashes.filter(own).groupBy("key").agg(*columns)

    def info(self, hashes: DataFrame) -> DataFrame:
        """FT.INFO: documents, and how many have each field."""
        rows = self.rows(hashes)
        return rows.agg(F.count(F.lit(1)).alias("docs"), *[F.count(column).alias(column) for column in self.fields])


class Catalog:
    """The indexes of a keyspace: FT.CREATE, FT.DROPINDEX, FT._LIST."""

    def __init__(self) -> None:
        self.held: dict[str, Index] = {}

    def create(self, index: Index) -> Index:
        if index.name in self.held:
            raise ValueError("index already exists")
        self.held[index.name] = index
        return index

    def drop(self, name: str, hashes: DataFrame, documents: bool = False) -> DataFrame:
        """The hashes that are left: all of them or, with DD, those that the index doesn't cover."""
        index = self.held.pop(name, None)
        if index is None:
            raise KeyError("unknown index name")
        return hashes.join(index.rows(hashes).select("key"), "key", "left_anti") if documents else hashes

    def list(self) -> list[str]:
        return sorted(self.held)


def page(rows: DataFrame, order: list[Column], offset: int, count: int, fields: list[str] | None = None, key: str = "key") -> DataFrame:
    """LIMIT offset count in a total order, then RETURN fields (all by default), or NOCONTENT (no fields): keys only."""
    some = rows.orderBy(*order, key).offset(offset).limit(count)
    return some if fields is None else some.select(key, *fields)
