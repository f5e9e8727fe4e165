"""The corpus pipeline against its stages done by brute force."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, sf):
    from loomwork.llm import decontam, mixing, neardup, pii, quality

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("labels", "benchmark"))
    out = corpus_pipeline.run(spark, sf).toPandas()
    model = quality.fit(docs, labels)
    good = quality.classify(docs, model).filter("accepted").select("doc_id")
    kept = docs.join(good, "doc_id")
    classes = neardup.near_duplicates(kept).filter("is_first").select("doc_id")
    kept = kept.join(classes, "doc_id")
    leaks = decontam.find_leaks(kept, bench).select("doc_id").distinct()
    kept = kept.join(leaks, "doc_id", "left_anti")
    want = mixing.mix(pii.redact(kept.select(docs.columns), length_col="n_chars")).toPandas()
    key = ["doc_id", "copy", "text", "n_chars", "shuffle_key"]
    assert sorted(map(tuple, out[key].to_numpy().tolist())) == sorted(map(tuple, want[key].to_numpy().tolist()))
    assert len(out) and not out.text.str.contains(r"@[a-z0-9]+\.example\.", regex=True).any()


def test_stages_keep_columns(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "personal_data", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_edges(spark, sf, tmp_path):
    """Nulls in every column, empty and repeated rows, ties, extra and clashing columns."""
    import shutil

    from pyspark.sql import functions as F

    for name in ("labels", "benchmark"):
        shutil.copy(f"{sf}/{name}.parquet", tmp_path / f"{name}.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(60)
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, None, None, None, None), (-2, "", "en", "a", 0), (-3, "same text of a few words here", "en", None, 29), (-3, "same text of a few words here", "en", None, 29), (None, "no id", "en", "a", 5)], docs.schema)
    clash = {c: F.lit("clash") for c in ("score", "copy", "class_id", "id", "print", "rate", "note")}
    docs.unionByName(odd).withColumns(clash).write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*docs.columns, "score", "class_id", "id", "print", "note", "copy", "n_copies", "rate", "shuffle_key"]
    rows = out.collect()
    assert {r.note for r in rows} <= {"clash"} and len({r.shuffle_key for r in rows}) == len(rows)
    spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0).write.parquet(str(tmp_path / "none"))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, spark.read.parquet(str(tmp_path / "none")), str(tmp_path)).count() == 0
