"""Expiring entries and page sessions: literal cases, and streams against the batch forms."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from scholia.streaming import keyed as K

OPS = "key string, op_id long, ts timestamp, op string, value string, seconds long"
VISITS = "user_id long, event_id long, ts timestamp, page string"
DAY = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def at(seconds):
    return DAY + datetime.timedelta(seconds=seconds)


@pytest.fixture
def stream(spark, tmp_path):
    """Runs a stream over parts, one batch each, with a restart from the checkpoint after the first ones."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    K.keep_state_in_files(spark)

    def run(make, parts, schema, restart):
        for own in (parts[:restart], parts[restart:]):
            for part in own:
                spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
            query = make(rows).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            query.awaitTermination(150)
            assert query.exception() is None
        return spark.read.parquet(str(tmp_path / "out"))

    yield run
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def plain_cache(ops):
    state, out = {}, []
    for key, op_id, ts, op, value, seconds in sorted(ops, key=lambda x: (x[2], x[1])):
        entry = state.get(key)
        live = entry is not None and (entry[1] is None or ts < entry[1])
        out.append((key, op_id, live, entry[0] if live and op == "get" else None))
        end = None if seconds is None else ts + datetime.timedelta(seconds=seconds)
        if op == "put":
            state[key] = (value, end)
        elif op == "expire":
            state[key] = (entry[0], end) if live else None
        elif op == "delete":
            state[key] = None
    return sorted(out, key=str)


def random_ops(n, seed):
    rng = random.Random(seed)
    return [(rng.choice("aabc"), i, at(10 * i + rng.randint(0, 9)), rng.choice(["put", "get", "get", "expire", "delete", "look"]), rng.choice(["x", "y", "", None]), rng.choice([None, 0, 5, 30, 300])) for i in range(n)]


def test_entries_that_expire(spark):
    ops = [("a", 1, at(0), "put", "x", 10), ("a", 2, at(9), "get", None, None), ("a", 3, at(10), "get", None, None), ("a", 4, at(11), "expire", None, 60), ("a", 5, at(12), "get", None, None), ("b", 6, at(0), "get", None, None), ("b", 7, at(1), "put", "y", 5), ("b", 8, at(5), "expire", None, 60), ("b", 9, at(60), "get", None, None), ("b", 10, at(61), "delete", None, None), ("b", 11, at(62), "delete", None, None)]
    rows = {r.op_id: (r.found, r.value) for r in K.cached(spark.createDataFrame(ops + [(None, 12, at(0), "get", None, None), ("a", 13, None, "get", None, None)], OPS)).collect()}
    assert rows == {1: (False, None), 2: (True, "x"), 3: (False, None), 4: (False, None), 5: (False, None), 6: (False, None), 7: (False, None), 8: (True, None), 9: (True, "y"), 10: (True, None), 11: (False, None)}
    for seed in range(3):
        ops = random_ops(400, seed)
        assert sorted(map(tuple, K.cached(spark.createDataFrame(ops, OPS)).collect()), key=str) == plain_cache(ops)


def test_entries_of_a_stream_with_a_restart(spark, stream):
    ops = random_ops(90, 7)
    parts = [ops[:30], ops[30:60], ops[60:]]
    # With state that the clock ends, a trigger on what is there would go on with batches without data.
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")
    try:
        found = stream(K.cached_stream, parts, OPS, 2)
    finally:
        spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "true")
    assert sorted(map(tuple, found.select("key", "op_id", "found", "value").collect()), key=str) == plain_cache(ops)


def test_page_sessions(spark):
    rows = [(1, 1, at(0), "exam"), (1, 2, at(60), "exam"), (1, 3, at(100), "chat"), (1, 4, at(100 + 600), "chat"), (1, 5, at(900), None), (1, 6, at(950), "exam"), (1, 7, at(5000), "exam"), (2, 8, at(0), None), (None, 9, at(0), "x"), (1, 10, None, "x")]
    found = {(r.user_id, r.page, r.opened_s, r.closed_s, r.events) for r in K.page_sessions(spark.createDataFrame(rows, VISITS)).select("*", (F.unix_seconds("opened") - int(DAY.timestamp())).alias("opened_s"), (F.unix_seconds("closed") - int(DAY.timestamp())).alias("closed_s")).collect()}
    assert found == {(1, "exam", 0, 100, 2), (1, "chat", 100, 700, 1), (1, "chat", 700, 900, 1), (1, "exam", 950, 1550, 1), (1, "exam", 5000, 5600, 1)}


def test_page_sessions_of_a_shuffled_stream(spark, stream):
    rng = random.Random(4)
    visits = [(rng.randint(1, 4), i, at(rng.randint(0, 20_000)), rng.choice(["exam", "chat", "post", None])) for i in range(240)]
    last = [(9, 9999, at(10**6), "end")]
    parts = [visits[:80], visits[80:160], visits[160:], last]  # shuffled over all batches, within the watermark
    found = stream(lambda s: K.page_sessions_stream(s.withWatermark("ts", "6 hours")), parts, VISITS, 2)
    batch = K.page_sessions(spark.createDataFrame(visits, VISITS))
    columns = ["user_id", "page", "opened", "closed", "events"]
    assert sorted(map(tuple, found.where("user_id < 9").select(columns).collect())) == sorted(map(tuple, batch.select(columns).collect()))
