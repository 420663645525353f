"""Queries of state by key: entries that expire, page sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import keyed as K
from .registry import Tables, query

#: What the events do to the entry of their user, by turns.
OPS = ["put", "get", "get", "expire", "put", "get", "get", "delete"]


@query(f"""WITH RECURSIVE o AS (SELECT CAST(user_id AS VARCHAR) AS key, event_id, epoch_us(ts) AS u, {OPS}[CAST(event_id % 8 AS INTEGER) + 1] AS op, event_type AS value, CASE WHEN event_id % 5 > 0 THEN (event_id % 48 + 1) * 3600000000 END AS span, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
w AS (SELECT key, i, event_id, op, false AS found, op = 'put' AS has, CASE WHEN op = 'put' THEN value END AS v, CASE WHEN op = 'put' THEN u + span END AS e, CAST(NULL AS VARCHAR) AS got FROM o WHERE i = 1 UNION ALL
SELECT o.key, o.i, o.event_id, o.op, w.has AND coalesce(o.u < w.e, true), CASE o.op WHEN 'put' THEN true WHEN 'delete' THEN false ELSE w.has AND coalesce(o.u < w.e, true) END, CASE WHEN o.op = 'put' THEN o.value ELSE w.v END,
CASE WHEN o.op = 'put' OR (o.op = 'expire' AND w.has AND coalesce(o.u < w.e, true)) THEN o.u + o.span ELSE w.e END, CASE WHEN o.op = 'get' AND w.has AND coalesce(o.u < w.e, true) THEN w.v END FROM w JOIN o ON o.key = w.key AND o.i = w.i + 1)
SELECT key, event_id AS op_id, found, got AS value FROM w""")
def stm_expiring(t: Tables) -> DataFrame:
    """What each event finds in its user's entry, which others of the user's events set, renew and delete."""
    kind = F.element_at(F.array(*map(F.lit, OPS)), (F.col("event_id") % 8 + 1).cast("int"))
    seconds = F.when(F.col("event_id") % 5 > 0, (F.col("event_id") % 48 + 1) * 3600)
    return K.cached(t.events.select(F.col("user_id").alias("key"), F.col("event_id").alias("op_id"), "ts", kind.alias("op"), F.col("event_type").alias("value"), seconds.alias("seconds")))


@query("""WITH v AS (SELECT user_id, event_id, ts, nullif(event_type, 'error') AS page FROM events),
o AS (SELECT *, lag(ts) OVER w AS before, lag(page) OVER w AS page_before, lead(ts) OVER w AS after FROM v WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(CASE WHEN before IS NULL OR page IS DISTINCT FROM page_before OR ts - before >= INTERVAL 12 HOUR THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM o)
SELECT user_id, page, min(ts) AS opened, least(coalesce(max(ends), max(ts) + INTERVAL 12 HOUR), max(ts) + INTERVAL 12 HOUR) AS closed, count(*) AS events
FROM (SELECT *, CASE WHEN row_number() OVER (PARTITION BY user_id, n ORDER BY ts DESC, event_id DESC) = 1 THEN after END AS ends FROM s) GROUP BY user_id, n, page HAVING page IS NOT NULL""")
def stm_pages(t: Tables) -> DataFrame:
    """Page sessions of all users, closed by a change of page or twelve hours without a visit; errors leave all pages."""
    page = F.when(F.col("event_type") != "error", F.col("event_type"))
    found = K.page_sessions(t.events.select("user_id", "event_id", "ts", page.alias("page")), 43_200)
    return found.select("user_id", "page", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("opened", "closed")], "events")
