"""The corpus pipeline's stages."""

import inspect

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.columns == corpus_pipeline.COLUMNS and 0 < docs.count() <= before
            before = docs.count()
            assert docs.select("doc_id").distinct().count() == before
        if name == "pii":
            assert docs.where("text rlike '[a-z0-9.]+@mail[0-9]+[.]example[.]com'").count() == 0
            kept = before
    assert docs.select("doc_id").distinct().count() == kept


def test_quality_rejects_what_the_operator_rejects():
    from docspark.llm.quality import quality_scores

    assert corpus_pipeline.QUALITY == inspect.signature(quality_scores).parameters["threshold"].default


def test_near_duplicates_keeps_one_of_each_group(spark, sf):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(7, text, "en", "s", 1), (3, text + " end", "en", "s", 1), (9, "short other text", "en", "s", 1), (9, "short other text", "en", "s", 1), (None, "nobody", "en", "s", 1), (11, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id or 0 for r in corpus_pipeline.near_duplicates(spark, docs, sf).collect())
    assert got == [0, 3, 9, 11]
