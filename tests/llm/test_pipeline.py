"""The stages: columns kept, decisions that take effect, clean documents kept."""

from __future__ import annotations

import shutil

import pytest


def test_stages(spark, tmp_path, docs):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality classifier", "line dedup", "near dedup", "decontamination", "source mixing"]
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    own = docs.select(*columns)
    own.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    leaked = own.filter("doc_id = 8").first().text
    spark.createDataFrame([(0, " ".join(leaked.split(" ")[50:80]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, before = own, {r.doc_id for r in own.collect()}
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == columns
        path = str(tmp_path / name)
        out.write.parquet(path)
        now = spark.read.parquet(path)
        ids = {r.doc_id for r in now.select("doc_id").collect()}
        assert ids <= before
        if name == "decontamination":
            assert before - ids == {8}
        if name == "near dedup":
            assert 14 not in ids and 5 in ids
        before = ids
    mixed = pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in mixed.select("doc_id").collect()} <= before
    shutil.rmtree(tmp_path)


def test_stages_of_an_empty_corpus(spark, tmp_path, nothing):
    """Every stage gives an empty table with the columns it was given."""
    pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(0, "some item of the benchmark here")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in pipeline.STAGES:
        out = stage(spark, nothing, str(tmp_path))
        assert out.count() == 0 and set(nothing.columns) <= set(out.columns), name


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    names = ["id", "row", "digest", "score", "lost", "leaked", "own", "k", "a.b", "__x"]
    kinds = ", ".join(f"`{n}` long" for n in names)
    rows = [(k, f"text number {k} of these few " + " ".join(f"w{k}x{j}" for j in range(20)), "en", "s", 9, *range(len(names))) for k in range(5)] + [(None, None, None, None, None, *range(len(names)))]
    docs = spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {kinds}")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert set(out.columns) == set(docs.columns) and out.count() == 6, name
    assert {*docs.columns, "copy_no"} == set(pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).columns)
