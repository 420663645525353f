"""Stateful behaviour: the same functions over a table or, where they say so, over a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def sessions(events: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """user_id, event_type, opened, closed and events of each session; a stream needs a watermark on ts."""
    rows = events.withColumn("at", F.col("ts").cast("timestamp")) if not events.isStreaming else events.withColumn("at", F.col("ts"))
    found = rows.groupBy("user_id", "event_type", F.session_window("at", gap).alias("w")).agg(F.count("*").alias("events"))
    kind = "timestamp" if events.isStreaming else "timestamp_ntz"
    return found.select("user_id", "event_type", F.col("w.start").cast(kind).alias("opened"), F.col("w.end").cast(kind).alias("closed"), "events")


def hourly_clicks(events: DataFrame) -> DataFrame:
    """hour and clicks; a stream needs a watermark on ts."""
    rows = events.where("event_type = 'click'")
    found = rows.groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("clicks"))
    return found.select(F.col("w.start").alias("hour"), "clicks")


def once_within(events: DataFrame, keys: list[str], interval: str = "5 seconds") -> DataFrame:
    """A stream without repeats of keys within interval."""
    return events.withWatermark("ts", interval).dropDuplicatesWithinWatermark(keys)


def rate_limited(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """user_id, event_id and allowed: most events in a window that opens with a user's first event after the last one.

    A pass over each user's events in order, batch by batch, that holds two numbers; no list of a user is built.
    """
    width = seconds * 1_000_000
    rows = events.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, start, n = None, 0, 0
        for batch in batches:
            out = []
            for own, at in zip(batch["user_id"].tolist(), batch["u"].tolist()):
                if own != user or at - start >= width:
                    user, start, n = own, at, 0
                n += 1
                out.append(n <= most)
            yield pd.DataFrame({"user_id": batch["user_id"], "event_id": batch["event_id"], "allowed": out})

    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "u", "event_id")
    return ordered.mapInPandas(run, "user_id long, event_id long, allowed boolean")


def rate_limited_stream(events: DataFrame, most: int, seconds: int) -> DataFrame:
    """The stream's form of rate_limited, with state that a window's end clears."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, n = state.get if state.exists else (-1, 0)
        for batch in batches:
            batch = batch.sort_values(["ts", "event_id"])
            allowed = []
            for at in batch["ts"].astype("datetime64[us]").astype("int64"):
                if start < 0 or at - start >= seconds * 1_000_000:
                    start, n = int(at), 0
                n += 1
                allowed.append(n <= most)
            yield pd.DataFrame({"user_id": key[0], "event_id": batch["event_id"], "allowed": allowed})
        state.update((start, n))
        state.setTimeoutDuration(seconds * 1000)

    return events.groupBy("user_id").applyInPandasWithState(run, "user_id long, event_id long, allowed boolean", "start long, n long", "append", GroupStateTimeout.ProcessingTimeTimeout)


def locked_out(attempts: DataFrame, most: int, seconds: int) -> DataFrame:
    """user_id, event_id and locked of attempts (user_id, event_id, ts, failed): refused after most failures in a row.

    A failure starts its count's time anew, a success ends it, and after so many seconds it is forgotten; attempts that
    are refused change nothing. State goes over each user's attempts in order, batch by batch, and holds two numbers.
    """
    rows = attempts.select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"), "failed")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, n, until = None, 0, 0
        for batch in batches:
            out = []
            for own, at, failed in zip(batch["user_id"].tolist(), batch["u"].tolist(), batch["failed"].tolist()):
                if own != user:
                    user, n, until = own, 0, 0
                n = 0 if at >= until else n
                out.append(n >= most)
                if n < most:
                    n, until = (n + 1, at + seconds * 1_000_000) if failed else (0, until)
            yield pd.DataFrame({"user_id": batch["user_id"], "event_id": batch["event_id"], "locked": out})

    ordered = rows.repartition("user_id").sortWithinPartitions("user_id", "u", "event_id")
    return ordered.mapInPandas(run, "user_id long, event_id long, locked boolean")


def rounds_stream(messages: DataFrame, most: int = 5) -> DataFrame:
    """user_id and rounds of a stream of (user_id, understood): one up with each message, back to 0 on a sign of
    understanding or at most rounds."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (n,) = state.get if state.exists else (0,)
        for batch in batches:
            for understood in batch["understood"]:
                n = 0 if understood or n + 1 >= most else n + 1
        state.update((n,))
        yield pd.DataFrame({"user_id": [key[0]], "rounds": [n]})

    return messages.groupBy("user_id").applyInPandasWithState(run, "user_id long, rounds long", "rounds long", "update", GroupStateTimeout.NoTimeout)
