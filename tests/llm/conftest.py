from __future__ import annotations

import random

import pytest
from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType

#: Extra columns whose names operators might use themselves.
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("n_chars", LongType()), StructField("size", StringType()), StructField("n_lines", IntegerType()), StructField("label", StringType()), StructField("copy_no", StringType())])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.choice((2, 3, 5, 8)))) for _ in range(n))


def corpus() -> list[tuple]:
    """Texts with copies, near copies, shared lines and passages, nulls, empty and long texts, odd white space."""
    rng = random.Random(4)
    texts: list[str | None] = [words(rng, n) for n in (3, 4, 5, 8, 60, 60, 120, 200, 400)]
    long = words(rng, 4000)
    line, passage = words(rng, 12), words(rng, 60)
    base = words(rng, 300).split(" ")
    texts += [None, "", " \n\t ", "\n\n", long, texts[5], texts[5], long + " tail"]
    texts += ["\n".join([words(rng, 9), f"  {line.upper() if k % 2 else line}\t", words(rng, 5), line]) for k in range(5)]
    texts += [f"{words(rng, 40 + k)} {passage} {words(rng, 7)}" for k in range(3)] + [" ".join([passage] * 2)]
    for k in range(6):  # near copies, and one that is too far
        near = list(base)
        for i in rng.sample(range(300), 3 if k < 5 else 60):
            near[i] = f"edit{k}x{i}"
        texts.append(" ".join(near))
    texts += ["a b " * 50, "x" * 5000, "naïve café — déjà vu ok\x1cno <|endoftext|> done's", "one two three\x0bfour\x0cfive six"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", "s1", "s1", None)[i % 5], len(t or ""), "x", 1, "y", "z") for i, t in enumerate(texts)]
    return [*rows, rows[5], (rows[6][0], *rows[6][1:])]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def rows():
    return [(r[0], r[1] or "") for r in corpus()]
