"""Queries of aggregation and reporting."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import activity
from .registry import Tables, query

TYPES = ["signup", "error", "click", "view", "purchase"]
#: The days of the events, 366 at most from the first one.
FIRST = "(SELECT CAST(min(ts) AS DATE) FROM events)"
DAYS = f"SELECT CAST({FIRST} + CAST(i AS INTEGER) AS DATE) AS day FROM range(366) r(i) WHERE {FIRST} + CAST(i AS INTEGER) <= (SELECT CAST(max(ts) AS DATE) FROM events)"


def _days(t: Tables) -> DataFrame:
    ends = t.events.agg(F.min("ts").cast("date").alias("f"), F.max("ts").cast("date").alias("l")).where("f IS NOT NULL")
    n = activity.clamp_days(F.date_diff("l", "f") + 1)
    return ends.select(F.explode(F.sequence("f", F.date_add("f", n - 1))).alias("day"))


@query(f"""WITH d AS ({DAYS}), u AS (SELECT DISTINCT user_id FROM events),
c AS (SELECT user_id, CAST(ts AS DATE) AS day, count(*) FILTER (event_type = 'signup') AS signup, count(*) FILTER (event_type = 'error') AS error, count(*) FILTER (event_type = 'click') AS click,
count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'purchase') AS purchase FROM events GROUP BY ALL),
j AS (SELECT u.user_id, d.day, coalesce(signup, 0) AS signup, coalesce(error, 0) AS error, coalesce(click, 0) AS click, coalesce("view", 0) AS "view", coalesce(purchase, 0) AS purchase
FROM u CROSS JOIN d LEFT JOIN c ON c.user_id = u.user_id AND c.day = d.day),
k AS (SELECT *, CAST((signup > 0)::INT + (error > 0)::INT + (click > 0)::INT + ("view" > 0)::INT + (purchase > 0)::INT AS BIGINT) AS type_count, signup + error + click + "view" + purchase AS session_count FROM j),
s AS (SELECT *, 0.72::DOUBLE * type_count / 5 + 0.28::DOUBLE * least(session_count / 12, 1) AS x FROM k)
SELECT * EXCLUDE x, round(x, 6) AS score, CASE WHEN session_count = 0 THEN 0 WHEN type_count = 5 THEN 4 WHEN x < 0.3 THEN 1 WHEN x < 0.6 THEN 2 WHEN x < 0.85 THEN 3 ELSE 4 END AS level FROM s""")
def activity_heatmap(t: Tables) -> DataFrame:
    """Activity of every user on every day, zero-filled."""
    sessions = t.events.select("user_id", F.col("ts").cast("date").alias("day"), F.col("event_type").alias("type"))
    return activity.heatmap(sessions, t.events.select("user_id").distinct(), _days(t), TYPES)


@query("""WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) AS day FROM events), e AS (SELECT max(day) AS last FROM d),
r AS (SELECT user_id, day - CAST(row_number() OVER (PARTITION BY user_id ORDER BY day) AS INTEGER) AS run, day FROM d),
g AS (SELECT user_id, run, count(*) AS n, max(day) AS stop FROM r GROUP BY ALL)
SELECT user_id, CAST(sum(n) AS BIGINT) AS active_days, max(n) AS longest, max(CASE WHEN stop = last THEN n ELSE 0 END) AS current FROM g, e GROUP BY user_id""")
def agg_streaks(t: Tables) -> DataFrame:
    """Active days, the longest run and the run that ends on the last day of all."""
    active = t.events.select("user_id", F.col("ts").cast("date").alias("day")).distinct()
    last = t.events.agg(F.max("ts").cast("date")).first()[0]
    return activity.streaks(active, str(last))


@query("SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events WHERE event_type IN ('click', 'view') AND ts >= TIMESTAMP '2024-01-05' GROUP BY ALL")
def agg_by_day_type(t: Tables) -> DataFrame:
    rows = t.events.where(F.col("event_type").isin("click", "view") & (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz")))
    return rows.groupBy(F.col("ts").cast("date").alias("day"), "event_type").agg(F.count("*").alias("n"))


@query("SELECT c_custkey, count(*) AS n, count(DISTINCT l_partkey) AS questions FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey")
def agg_per_user(t: Tables) -> DataFrame:
    """Rows and distinct questions of each existing user."""
    rows = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    counts = rows.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.countDistinct("l_partkey").alias("questions"))
    return counts.join(t.customer, "c_custkey", "left_semi")


@query("""SELECT user_id, event_type, arg_max(event_id, (ts, event_id)) AS latest, arg_min(value, (ts, event_id)) AS first_value FROM (SELECT *, coalesce(value, -1) AS v FROM events WHERE value IS NOT NULL) GROUP BY ALL""")
def agg_latest_first(t: Tables) -> DataFrame:
    """The latest row and the first answer of each key, by aggregates that are merged before the exchange."""
    at = F.struct("ts", "event_id")
    return t.events.where("value IS NOT NULL").groupBy("user_id", "event_type").agg(F.max_by("event_id", at).alias("latest"), F.min_by("value", at).alias("first_value"))


@query("""SELECT user_id, event_type AS most, n FROM (SELECT user_id, event_type, count(*) AS n, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, event_type) AS r FROM events GROUP BY user_id, event_type) WHERE r = 1""")
def agg_mode(t: Tables) -> DataFrame:
    """The most frequent value of each key, of equals the smallest."""
    n = t.events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    best = n.groupBy("user_id").agg(F.min(F.struct((-F.col("n")).alias("m"), F.col("event_type"), F.col("n"))).alias("b"))
    return best.select("user_id", F.col("b.event_type").alias("most"), F.col("b.n").alias("n"))


@query("SELECT p_brand, count(*) AS n, count(*) - count(DISTINCT p_name) AS repeats, max(p_name) AS name FROM part GROUP BY p_brand HAVING count(*) > 1")
def agg_unique(t: Tables) -> DataFrame:
    """Whether names are unique within a parent."""
    rows = t.part.groupBy("p_brand").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("p_name")).alias("repeats"), F.max("p_name").alias("name"))
    return rows.where("n > 1")


@query("SELECT DISTINCT p_brand, trim(w) AS permission FROM part, unnest(string_split(p_type, ' ')) AS x(w) WHERE trim(w) <> ''")
def agg_tokens(t: Tables) -> DataFrame:
    """Distinct permissions out of lists in text."""
    rows = t.part.select("p_brand", "p_type").distinct().select("p_brand", F.explode(F.split("p_type", " ")).alias("w"))
    return rows.select("p_brand", F.trim("w").alias("permission")).where("permission <> ''").distinct()


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def agg_joined_names(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"))


@query("""WITH d AS (SELECT lang, source, n_chars, contains(text, '|') AS bar FROM documents)
SELECT CASE WHEN grouping(lang) = 0 THEN 'lang' WHEN grouping(source) = 0 THEN 'source' ELSE 'all' END AS part, coalesce(lang, source, '') AS value, count(*) AS n, round(avg(bar::INT), 4) AS bar_ratio
FROM d GROUP BY GROUPING SETS ((lang), (source), ())""")
def agg_dataset_stats(t: Tables) -> DataFrame:
    """Counts and ratios of a dataset by each of its columns and in all, in one pass."""
    d = t.documents.select("lang", "source", F.col("text").contains("|").cast("int").alias("bar"))
    sets = d.groupingSets([["lang"], ["source"], []], "lang", "source").agg(F.grouping("lang").alias("no_lang"), F.grouping("source").alias("no_source"), F.count("*").alias("n"), F.round(F.avg("bar"), 4).alias("bar_ratio"))
    part = F.when(F.col("no_lang") == 0, "lang").when(F.col("no_source") == 0, "source").otherwise("all")
    return sets.select(part.alias("part"), F.coalesce("lang", "source", F.lit("")).alias("value"), "n", "bar_ratio")


@query("SELECT p_type, count(*) AS n, min(p_partkey) AS first_at FROM part GROUP BY p_type")
def agg_distribution(t: Tables) -> DataFrame:
    """Values with their counts and first places, most frequent first."""
    return t.part.groupBy("p_type").agg(F.count("*").alias("n"), F.min("p_partkey").alias("first_at")).orderBy(F.desc("n"), "first_at")


REASONS = "list_filter([CASE WHEN length(text) < 200 THEN 'short' END, CASE WHEN contains(text, '|') THEN 'table' END, CASE WHEN contains(text, '***') THEN 'marks' END], lambda x: x IS NOT NULL)"


@query(f"""WITH d AS (SELECT doc_id, {REASONS} AS reasons FROM documents)
SELECT 'kept' AS reason, count(*) FILTER (len(reasons) = 0) AS n FROM d UNION ALL SELECT 'dropped', count(*) FILTER (len(reasons) > 0) FROM d
UNION ALL SELECT r, count(*) FROM d, unnest(reasons) AS x(r) GROUP BY r""")
def agg_filter_report(t: Tables) -> DataFrame:
    """Kept, dropped, and how many rows each reason holds for; a row can have several."""
    text = F.col("text")
    reasons = F.array_compact(F.array(F.when(F.length(text) < 200, "short"), F.when(text.contains("|"), "table"), F.when(text.contains("***"), "marks")))
    marked = F.array_append(reasons, F.when(F.size(reasons) == 0, "kept").otherwise("dropped"))
    return t.documents.select(F.explode(marked).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query("""SELECT count(*) FILTER (role = 'assistant') AS answered, count(*) FILTER (length(text) < 20) AS degraded, round(avg(length(text)), 6) AS mean_length,
count(DISTINCT conv_id) AS dialogues, round(count(*) / count(DISTINCT conv_id), 6) AS mean_turns FROM conversations""")
def agg_synthesis(t: Tables) -> DataFrame:
    """A one-row summary of dialogues."""
    n, dialogues = F.count("*"), F.countDistinct("conv_id")
    return t.conversations.agg(F.count_if(F.col("role") == "assistant").alias("answered"), F.count_if(F.length("text") < 20).alias("degraded"), F.round(F.avg(F.length("text")), 6).alias("mean_length"), dialogues.alias("dialogues"), F.round(n / dialogues, 6).alias("mean_turns"))


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS quantity, round(sum(l_extendedprice), 2) AS price, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def agg_totals(t: Tables) -> DataFrame:
    """A report with subtotals and a total row."""
    return t.lineitem.rollup("l_returnflag", "l_linestatus").agg(F.round(F.sum("l_quantity"), 2).alias("quantity"), F.round(F.sum("l_extendedprice"), 2).alias("price"), F.count("*").alias("n"))


@query("SELECT sum(try_cast(substr(p_brand, 7) AS DOUBLE)) AS brands, sum(coalesce(try_cast(p_name AS DOUBLE), 0)) AS names FROM part")
def agg_column_totals(t: Tables) -> DataFrame:
    """Totals of text columns; what isn't a number adds nothing."""
    return t.part.agg(F.sum(F.substring("p_brand", 7, 100).try_cast("double")).alias("brands"), F.sum(F.coalesce(F.col("p_name").try_cast("double"), F.lit(0.0))).alias("names"))


@query("""SELECT round(avg(total), 4) AS mean_return, round(avg((n >= 5)::INT), 6) AS success_rate, round(avg(n), 6) AS mean_length FROM (SELECT l_orderkey, sum(l_discount) AS total, count(*) AS n FROM lineitem GROUP BY l_orderkey)""")
def agg_episodes(t: Tables) -> DataFrame:
    """Mean return, success rate and length of episodes."""
    runs = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_discount").alias("total"), F.count("*").alias("n"))
    return runs.agg(F.round(F.avg("total"), 4).alias("mean_return"), F.round(F.avg((F.col("n") >= 5).cast("int")), 6).alias("success_rate"), F.round(F.avg("n"), 6).alias("mean_length"))


@query("""SELECT l_partkey AS post, count(DISTINCT o_custkey) AS likes, bool_or(o_custkey = 7) AS mine FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey""")
def agg_likes(t: Tables) -> DataFrame:
    """Users who like each post, and whether user 7 is one."""
    likes = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_partkey").alias("post"), "o_custkey").distinct()
    return likes.groupBy("post").agg(F.count("*").alias("likes"), F.bool_or(F.col("o_custkey") == 7).alias("mine"))


@query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def agg_hourly(t: Tables) -> DataFrame:
    """Counters flushed once an hour."""
    return t.events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("""SELECT p_partkey, CAST(greatest(p_size - coalesce(n, 0), 0) AS BIGINT) AS remaining FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = p_partkey""")
def agg_clamped(t: Tables) -> DataFrame:
    """A counter less its deletions, never below zero."""
    gone = t.lineitem.where("l_returnflag = 'R'").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    return t.part.join(gone, "p_partkey", "left").select("p_partkey", F.greatest(F.col("p_size") - F.coalesce("n", F.lit(0)), F.lit(0)).cast("long").alias("remaining"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, round((l_quantity - avg(l_quantity) OVER w) / (stddev_pop(l_quantity) OVER w + 1e-6), 6) AS advantage FROM lineitem WINDOW w AS (PARTITION BY l_orderkey)""")
def agg_standardised(t: Tables) -> DataFrame:
    """Rewards of a group by its mean and deviation."""
    w = Window.partitionBy("l_orderkey")
    x = (F.col("l_quantity") - F.avg("l_quantity").over(w)) / (F.stddev_pop("l_quantity").over(w) + 1e-6)
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", F.round(x, 6).alias("advantage"))
