import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages(spark, docs, texts, tmp_path):
    labels = spark.createDataFrame([(d, int(bool(t) and "stone" in t)) for d, t in texts if d is not None], "doc_id long, toxic int")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    rows, df = docs.count(), docs
    assert [k for k, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "personal_data", "mixture", "packing"]
    for k, f in corpus_pipeline.STAGES[:-1]:
        df = f(spark, df, str(tmp_path))
        assert df.columns == docs.columns
        df.write.parquet(str(tmp_path / k))
        df = spark.read.parquet(str(tmp_path / k))
        assert df.count() <= rows
        rows = df.count()
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1


def test_stages_keep_columns_of_any_name(spark, texts):
    """Other columns come out as they went in, also under the names that the stages use inside; so do empty tables."""
    from pyspark.sql import functions as F

    from textloom.llm.mixing import sample
    from textloom.llm.ngram_join import near_duplicate_free
    from textloom.llm.privacy import sanitise_texts

    names = ["__gone", "__twice", "__nth", "__id", "__rows", "__base", "__terms", "__key", "row_key", "__weight", "__u", "__topic", "__tokens", "__sampled", "__probability", "__lang", "__source", "other_0", "other_1"]
    rows = [(d, t, "s", "en", len(t or "")) for d, t in texts if len(t or "") < 2000]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    mark = F.concat_ws("|", F.col("doc_id").cast("string"), F.col("n_chars").cast("string"))
    odd = docs.select("*", *(F.concat(F.lit(n), mark).alias(n) for n in names))
    for stage in (near_duplicate_free, sanitise_texts, sample):
        out = stage(odd)
        assert out.columns == odd.columns
        found = out.collect()
        assert found and all(r[n] == f"{n}{'|'.join(str(r[c]) for c in ('doc_id', 'n_chars') if r[c] is not None)}" for r in found for n in names)
        assert sorted(str(r["text"]) for r in found) == sorted(str(r["text"]) for r in stage(docs).collect())
        assert stage(odd.limit(0)).collect() == []
