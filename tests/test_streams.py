"""Streams give what the batch operators give on a replayed source."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillon import model
from quillon.operators import telemetry
from quillon.streaming import streams

DATA = "/root/testdata/sf0.001"


def replayed(spark, df, path):
    df.repartition(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path)


def collected(stream, name):
    """All rows of what is there; a query with timeouts would otherwise never be idle."""
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(90)
        return stream.sparkSession.sql(f"SELECT * FROM {name}").collect()
    finally:
        q.stop()


def test_throttle(spark, tmp_path):
    # A day is half a minute, so that all levels occur.
    e = model.tool_events(spark, DATA).withColumn("us", F.floor(F.col("us") / 3000)).withColumn("path", F.lit("p")).withColumn("search", F.col("event") == "ask")
    s = replayed(spark, e, str(tmp_path / "e"))
    got = {tuple(r) for r in collected(streams.throttled(s, expire=False), "throttled")}
    want = {(r.event_id, r.session, r.calls, r.searches, r.level) for r in telemetry.throttle(e, F.col("search")).collect()}
    assert {x[4] for x in want} == {"normal", "hint", "reduce", "block"}
    assert got == want


def test_debounce(spark, tmp_path):
    rows = [("a", 0), ("a", 100_000), ("a", 2_000_000), ("b", 0)]
    s = replayed(spark, spark.createDataFrame(rows, "key string, us long"), str(tmp_path / "c"))
    got = collected(streams.debounced(s, expire=False), "debounced")
    assert {tuple(r) for r in got} == {("a", 0, 100_000, 2)}


def test_windowed_counts(spark, tmp_path):
    e = spark.createDataFrame([(i * 60, "t", 1.0) for i in range(180)], "s long, tool string, value double").select(F.timestamp_seconds("s").alias("ts"), "tool", "value")
    got = collected(streams.counted(replayed(spark, e, str(tmp_path / "w"))), "counted")
    assert sorted((r.calls, r.value) for r in got) in ([(60, 60.0)] * 2, [(60, 60.0)] * 3)
