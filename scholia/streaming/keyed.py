"""State by key with an end: entries that expire, and page sessions that a page change or silence closes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, StatefulProcessor, StatefulProcessorHandle, TimerValues

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CACHED = "key string, op_id long, found boolean, value string"
SESSION = "user_id long, page string, opened timestamp, closed timestamp, events long"
#: How long silence leaves a page session open, in seconds.
SILENCE = 600


def keep_state_in_files(spark: SparkSession) -> None:
    """State of streams goes to the store that processors with several states need; before the stream starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def cached(ops: DataFrame) -> DataFrame:
    """key, op_id, found and value of each operation on a table of entries that expire.

    ops: key, op_id, ts, op, value, seconds. put sets a value for so many seconds (null: for ever), get reads it, expire
    gives a live entry that many seconds from now (null: for ever), delete ends it. found: whether the key was live
    before; value: what get found. An entry is dead from its end on; a dead one can't be renewed. Operations of a key go
    by ts, then op_id; rows with a null key, ts or op are dropped, other operations only look. Windows run over a key's operations in
    order, holding a row, so a hot key is one long task and not a large one.
    """
    rows = _timed(ops)
    before = Window.partitionBy("key").orderBy("u", "op_id").rowsBetween(Window.unboundedPreceding, -1)
    sets = F.when(F.col("op").isin("put", "expire", "delete"), F.struct(F.col("ends")))
    resets = F.when(F.col("op").isin("put", "delete"), F.struct("op", "value"))
    rows = rows.select("*", F.last(sets, True).over(before)["ends"].alias("end"), F.last(resets, True).over(before).alias("head"), F.count(resets).over(before).alias("life"))
    in_time = F.col("end").isNull() | (F.col("u") < F.col("end"))
    rows = rows.withColumn("in_time", in_time).withColumn("missed", (F.col("op") == "expire") & ~F.col("in_time"))
    own = Window.partitionBy("key", "life").orderBy("u", "op_id").rowsBetween(Window.unboundedPreceding, -1)
    found = (F.coalesce(F.col("head.op"), F.lit("")) == "put") & F.col("in_time") & ~F.coalesce(F.max("missed").over(own), F.lit(False))
    return rows.select("key", "op_id", found.alias("found"), F.when(found & (F.col("op") == "get"), F.col("head.value")).alias("value"))


def _timed(ops: DataFrame) -> DataFrame:
    """Operations with u and ends, in microseconds."""
    rows = ops.select(F.col("key").cast("string").alias("key"), "op_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"), "op", F.col("value").cast("string").alias("value"), F.col("seconds").cast("long").alias("seconds"))
    ends = F.when(F.col("op").isin("put", "expire"), F.col("u") + F.col("seconds") * 1_000_000)
    return rows.where("key is not null and u is not null and op is not null").select("key", "op_id", "u", "op", "value", ends.alias("ends"))


class Entries(StatefulProcessor):
    """One key's entry: one that ends in a state that the store forgets by itself, any other in one that stays."""

    def __init__(self, keep_seconds: int):
        self.keep = keep_seconds * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ending = handle.getValueState("ending", "value string, ends long", ttlDurationMs=self.keep // 1000)
        self.lasting = handle.getValueState("lasting", "value string, ends long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        own = pd.concat(list(rows)).sort_values(["u", "op_id"])
        entry = self.ending.get() or self.lasting.get()
        value, ends = (entry[0], entry[1]) if entry else (None, None)
        live, out, at = entry is not None, [], 0
        for op_id, at, op, new, end in own[["op_id", "u", "op", "value", "ends"]].astype(object).itertuples(index=False, name=None):
            end = None if pd.isna(end) else int(end)
            live = live and (ends is None or at < ends)
            out.append((key[0], op_id, live, value if live and op == "get" else None))
            if op == "put":
                live, value, ends = True, None if pd.isna(new) else new, end
            elif op == "expire" and live:
                ends = end
            elif op == "delete":
                live = False
        self.ending.clear()
        self.lasting.clear()
        if live:
            soon = ends is not None and ends - at <= self.keep // 2
            (self.ending if soon else self.lasting).update((value, ends))
        yield pd.DataFrame(out, columns=["key", "op_id", "found", "value"])

    def close(self) -> None:
        pass


def cached_stream(ops: DataFrame, keep_seconds: int = 172_800) -> DataFrame:
    """The stream's form of cached: operations of a batch in order, batches as they come.

    An entry whose end is within half of keep_seconds is forgotten by the store after keep_seconds of the clock, so a stream may stand
    still or lag by the other half; whether an entry is live is told by its end and the operation's ts alone. Needs
    keep_state_in_files.
    """
    return _timed(ops).groupBy("key").transformWithStateInPandas(Entries(keep_seconds), CACHED, "Append", "ProcessingTime")


def page_sessions(visits: DataFrame, silence: int = SILENCE) -> DataFrame:
    """user_id, page, opened, closed and events of each page session, of visits (user_id, event_id, ts, page).

    Visits of a user go by ts, then event_id. A session opens with a visit to a page (not a null one) that follows one
    of another page or so many seconds without any, and closes at the next visit to another page or after the silence, whatever
    comes first. Rows with a null user_id or ts are dropped. Windows run over a user's visits in order, holding a row.
    """
    rows = visits.where("user_id is not null and ts is not null").select(F.col("user_id").cast("long").alias("user_id"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("u"), F.col("page").cast("string").alias("page"))
    order = Window.partitionBy("user_id").orderBy("u", "event_id")
    quiet = F.lit(silence * 1_000_000)
    last = F.lag("u").over(order)
    opens = last.isNull() | ~F.lag("page").over(order).eqNullSafe(F.col("page")) | (F.col("u") - last >= quiet)
    rows = rows.select("*", opens.cast("int").alias("opens"), F.lead("u").over(order).alias("after"))
    rows = rows.withColumn("session", F.sum("opens").over(order))
    end = F.least(F.max_by("after", F.struct("u", "event_id")), F.max("u") + quiet)  # a null after is left out
    found = rows.groupBy("user_id", "session", "page").agg(F.min("u").alias("opened"), end.alias("closed"), F.count("*").alias("events"))
    return found.where("page is not null").select("user_id", "page", F.timestamp_micros("opened").alias("opened"), F.timestamp_micros("closed").alias("closed"), "events")


class Pages(StatefulProcessor):
    """A user's open session, and visits that wait until no earlier one can come."""

    def __init__(self, silence: int):
        self.quiet = silence * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "page string, opened long, last long, events long")
        self.waiting = handle.getListState("waiting", "u long, event_id long, page string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        first = None
        for batch in rows:
            u = batch["ts"].astype("datetime64[us]").astype("int64")
            first = int(u.min()) if first is None else min(first, int(u.min()))
            self.waiting.appendList([(int(a), int(b), None if pd.isna(c) else c) for a, b, c in zip(u, batch["event_id"], batch["page"])])
        if first is not None:
            self.handle.registerTimer(-(-first // 1000))
        return iter([])

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs() * 1000
        visits = sorted((tuple(x) for x in self.waiting.get()), key=lambda x: x[:2])
        due = [x for x in visits if x[0] <= now]
        later = visits[len(due) :]
        session = tuple(self.open.get()) if self.open.exists() else None
        out = []
        for u, _, page in due:
            if session and (page != session[0] or u - session[2] >= self.quiet):
                out.append((key[0], session[0], session[1], min(u, session[2] + self.quiet), session[3]))
                session = None
            if session:
                session = (page, session[1], u, session[3] + 1)
            elif page is not None:
                session = (page, u, u, 1)
        if session and session[2] + self.quiet <= now:
            out.append((key[0], session[0], session[1], session[2] + self.quiet, session[3]))
            session = None
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(-(-later[0][0] // 1000))
        self.open.clear()
        if session:
            self.open.update(session)
            self.handle.registerTimer(-(-(session[2] + self.quiet) // 1000))
        frame = pd.DataFrame(out, columns=["user_id", "page", "opened", "closed", "events"])
        for c in ("opened", "closed"):
            frame[c] = pd.to_datetime(frame[c], unit="us", utc=True)
        yield frame

    def close(self) -> None:
        pass


def page_sessions_stream(visits: DataFrame, silence: int = SILENCE) -> DataFrame:
    """The stream's form of page_sessions, of visits with a watermark on ts (a timestamp).

    Visits wait in the user's state until the watermark is beyond them, so they count in order, however they arrived
    within it; timers of event time close sessions after the silence. Later visits are dropped. Needs keep_state_in_files.
    """
    rows = visits.where("user_id is not null and ts is not null").select(F.col("user_id").cast("long").alias("user_id"), "event_id", "ts", F.col("page").cast("string").alias("page"))
    return rows.groupBy("user_id").transformWithStateInPandas(Pages(silence), SESSION, "Append", "EventTime")
