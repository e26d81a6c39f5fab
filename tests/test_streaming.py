from textloom.streaming.audit_stream import feature_stream, start_audit


def test_audit_of_a_stream(spark, tmp_path):
    rows = [(1, "All nodes sync. Fine."), (2, "nothing"), (3, "Every day. No more.")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("doc_id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    assert feature_stream(stream).isStreaming
    start_audit(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {(r["doc_id"], r["seq"], r["signal"]) for r in got} == {(1, 1, "RED"), (3, 1, "RED")}
