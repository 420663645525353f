"""Activity reports: heatmaps over a dense calendar, levels and streaks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def clamp_days(days: Column) -> Column:
    """From 1 to 366; null is 1."""
    return F.least(F.greatest(F.coalesce(days, F.lit(1)), F.lit(1)), F.lit(366))


def calendar(spark, start: str, end: str) -> DataFrame:
    return spark.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}')) AS day")


def heatmap(sessions: DataFrame, users: DataFrame, days: DataFrame, types: Sequence[str]) -> DataFrame:
    """A row for each user and day: a count of each type, how many types and sessions there were, score and level.

    sessions: user_id, day, type. Types that aren't listed don't count. One aggregation by user and day, whose map side
    leaves a row for each day of a user; the spine of users and days is made where the counts are joined.
    """
    counts = sessions.where(F.col("type").isin(list(types))).groupBy("user_id", "day").agg(*[F.count_if(F.col("type") == x).alias(x) for x in types])
    # Every user has every day: the days, 366 at most, become one list that each user's row carries and unfolds.
    listed = days.agg(F.array_sort(F.collect_set("day")).alias("days"))
    spine = users.select("user_id").join(F.broadcast(listed)).select("user_id", F.explode("days").alias("day"))
    rows = spine.join(counts, ["user_id", "day"], "left").na.fill(0, list(types))
    n_types = sum(F.when(F.col(x) > 0, 1).otherwise(0) for x in types)
    n_sessions = sum(F.col(x) for x in types)
    score = 0.72 * F.col("type_count") / len(types) + 0.28 * F.least(F.col("session_count") / 12, F.lit(1.0))
    level = F.when(F.col("session_count") == 0, 0).when(F.col("type_count") == len(types), 4).when(score < 0.30, 1).when(score < 0.60, 2).when(score < 0.85, 3).otherwise(4)
    rows = rows.withColumn("type_count", n_types.cast("long")).withColumn("session_count", n_sessions.cast("long"))
    return rows.withColumn("score", F.round(score, 6)).withColumn("level", level)


def streaks(active: DataFrame, last_day: str) -> DataFrame:
    """user_id, active_days, longest and current run of days in a row of active (user_id, day, distinct); the current
    one ends on last_day, else it is 0."""
    run = F.date_sub("day", F.row_number().over(Window.partitionBy("user_id").orderBy("day")))
    runs = active.withColumn("run", run).groupBy("user_id", "run").agg(F.count("*").alias("n"), F.max("day").alias("end"))
    current = F.max(F.when(F.col("end") == F.lit(last_day).cast("date"), F.col("n")).otherwise(0))
    return runs.groupBy("user_id").agg(F.sum("n").alias("active_days"), F.max("n").alias("longest"), current.alias("current"))
