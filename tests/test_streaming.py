from turnwise.operators.concordance import search
from turnwise.streaming import search_stream, terms_stream


def test_streamed_matches_equal_a_batch(spark, sherlock, tmp_path):
    source, out, state = (str(tmp_path / n) for n in ("in", "out", "state"))
    sherlock.filter("text_id < 3").write.parquet(source)
    stream = spark.readStream.schema(sherlock.schema).parquet(source)
    search_stream(stream, "s", out, checkpoint=state, window_width=5).awaitTermination()
    sherlock.filter("text_id >= 3").write.mode("append").parquet(source)
    search_stream(stream, "s", out, checkpoint=state, window_width=5).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, search(sherlock, "s", window_width=5).collect()))


def test_streamed_terms(spark, sherlock, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    sherlock.write.parquet(source)
    stream = spark.readStream.schema(sherlock.schema).parquet(source)
    terms_stream(stream, out, stopwords=["the"]).awaitTermination()
    terms = [r["term"] for r in spark.read.parquet(out).collect()]
    assert "sherlock" in terms and "the" not in terms


def test_a_second_run_without_a_named_checkpoint_goes_on(spark, sherlock, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ("text_id < 3", "text_id >= 3"):
        sherlock.filter(part).write.mode("append").parquet(source)
        stream = spark.readStream.schema(sherlock.schema).parquet(source)
        search_stream(stream, "s", out, window_width=5).awaitTermination()
    got = sorted(map(tuple, spark.read.parquet(out).collect()))
    assert got == sorted(map(tuple, search(sherlock, "s", window_width=5).collect()))
