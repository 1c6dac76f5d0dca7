"""Bounded samples of labelled documents for the classifiers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyloom.llm.common import held_out, text_of


def labelled(docs: DataFrame, labels: DataFrame, label: str, per_class: int, max_chars: int) -> DataFrame:
    """doc_id, text, label of at most ``per_class`` documents per label, none of them held out or over ``max_chars``.

    Rows are chosen by the order of a hash of doc_id; the chosen ids (a bounded number) are broadcast to the documents.
    A document that is labelled both ways teaches nothing and is left out. Of texts that share an id the one with the
    smallest digest is taken, so there is never more than a row per chosen id, and reruns agree.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out(F.col("doc_id")))
    own = own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most")
    some = [own.filter(F.col("label") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).filter(F.length("text") <= max_chars)
    found = texts.join(F.broadcast(some[0].union(some[1])), "doc_id")
    one = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.md5(F.col("text").cast("binary")).alias("digest"), "text")).alias("t"))
    return one.select("doc_id", F.col("t.text").alias("text"), "label")
