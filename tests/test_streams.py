"""Streams against their batch forms."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from quarry.operators.postings import Index
from quarry.streaming import state


def clicks(spark, seconds=(0, 10, 59, 61, 130)):
    t0 = datetime(2024, 1, 1)
    return spark.createDataFrame([(i, 1, t0 + timedelta(seconds=s)) for i, s in enumerate(seconds)] + [(9, 2, t0)], "event_id long, user_id long, ts timestamp")


def test_anchored_windows(spark):
    got = {r["event_id"]: r["accepted"] for r in state.rate_anchored_rows(clicks(spark), 60, 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 9: True}
    # an event just at the window's end is still in it
    got = {r["event_id"]: r["accepted"] for r in state.rate_anchored_rows(clicks(spark, (0, 30, 60)), 60, 2).collect()}
    assert got[2] is False


def test_rate_stream(spark, tmp_path):
    rows = clicks(spark)
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 minute")
    q = state.rate_stream(stream, 60, 2).writeStream.format("memory").queryName("rates").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["event_id"]: r["accepted"] for r in spark.table("rates").collect()} == {0: True, 1: True, 2: False, 3: True, 4: True, 9: True}


def test_index_from_stream(spark, tmp_path):
    """New, changed and deleted documents reach the index; a replayed batch changes nothing."""
    schema = "doc_id long, source string, text string, deleted boolean"
    tokens = lambda rows: rows.select(F.col("doc_id").alias("key"), F.col("source").alias("spec"), F.split("text", " ").alias("title"), F.split("text", " ").alias("body"))
    base = Index.build(tokens(spark.createDataFrame([(1, "s", "a b"), (2, "s", "b c")], "doc_id long, source string, text string")), f"file://{tmp_path}/i")
    spark.createDataFrame([(1, "s", "x b", None), (2, "s", "", True), (3, "s", "a b", False)], schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    state.maintain_index(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, base, str(tmp_path / "at")).awaitTermination()
    for _ in range(2):
        after = Index(spark, base.path, 1)
        assert {r["key"] for r in after.search(["b"]).collect()} == {1, 3} and {r["key"] for r in after.search(["x"]).collect()} == {1} and after.search(["c"]).count() == 0
        assert after.table("stats").first()["n_docs"] == 2
        state.maintain_index(spark, str(tmp_path / "in"), spark.createDataFrame([], schema).schema, base, str(tmp_path / "at2")).awaitTermination()


def test_heartbeat(spark):
    from pyspark.sql import Observation

    seen = Observation("beat")
    spark.range(5).observe(seen, F.count(F.lit(1)).alias("seen")).count()
    assert seen.get["seen"] == 5
    assert state.heartbeat(spark.range(3), "h").count() == 3
