"""Streams give what the batch forms give."""

from pyspark.sql import functions as F

from scholia.streaming import stateful as S

SF = "/root/testdata/sf0.001/events.parquet"


def streamed(spark, tmp_path, make, mode="append"):
    rows = spark.read.parquet(SF).withColumn("ts", F.col("ts").cast("timestamp"))
    late = rows.agg((F.max("ts") + F.expr("INTERVAL 2 DAYS")).alias("ts"), F.lit(-1).cast("long").alias("user_id"), F.lit(-1).cast("long").alias("event_id"), F.lit("click").alias("event_type"))
    wide = rows.select("ts", "user_id", "event_id", "event_type")
    wide.coalesce(1).write.parquet(str(tmp_path / "in" / "a"))
    late.select(wide.columns).write.parquet(str(tmp_path / "in" / "b"))
    stream = spark.readStream.schema(wide.schema).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    query = make(stream).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table("out")


def test_sessions(spark, tmp_path):
    found = streamed(spark, tmp_path, lambda s: S.sessions(s.withWatermark("ts", "1 hour"))).where("user_id >= 0")
    batch = S.sessions(spark.read.parquet(SF))
    assert found.agg(F.count("*"), F.sum("events")).first() == batch.agg(F.count("*"), F.sum("events")).first()


def test_counters(spark, tmp_path):
    found = streamed(spark, tmp_path, lambda s: S.hourly_clicks(s.withWatermark("ts", "1 hour")))
    assert found.agg(F.sum("clicks")).first() == S.hourly_clicks(spark.read.parquet(SF)).agg(F.sum("clicks")).first()


def test_rate_limit(spark, tmp_path):
    found = streamed(spark, tmp_path, lambda s: S.rate_limited_stream(s, 3, 86_400)).where("user_id >= 0")
    batch = S.rate_limited(spark.read.parquet(SF), 3, 86_400)
    assert {tuple(r) for r in found.collect()} == {tuple(r) for r in batch.collect()}


def test_repeats_within_an_interval(spark, tmp_path):
    """Repeats of one key in the interval go; a later one, beyond the watermark, counts anew."""
    found = streamed(spark, tmp_path, lambda s: S.once_within(s.union(s), ["event_id"], "1 hour")).where("user_id >= 0")
    assert sorted(r.event_id for r in found.collect()) == sorted(r.event_id for r in spark.read.parquet(SF).collect())


def test_rounds(spark, tmp_path):
    """One up with each message of a batch, back to 0 on understanding or at the most."""
    rows = [(1, False), (1, False), (2, True), (3, False)]
    for i, part in enumerate((rows, [(1, False), (2, False)], [(1, True)])):
        spark.createDataFrame(part, "user_id long, understood boolean").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("user_id long, understood boolean").parquet(str(tmp_path / "in"))
        query = S.rounds_stream(stream, 3).writeStream.foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))).outputMode("update").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    found = sorted((r.user_id, r.rounds) for r in spark.read.parquet(str(tmp_path / "out")).collect())
    assert found == [(1, 0), (1, 0), (1, 2), (2, 0), (2, 1), (3, 1)]
