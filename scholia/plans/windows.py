"""Queries of order-sensitive operators, sampling, paging and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chance, sequence_id
from ..operators import relational as R
from .registry import Tables, query


@query("SELECT doc_id, source || '-' || lpad(CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS VARCHAR), 6, '0') AS qid FROM documents")
def win_sequence_ids(t: Tables) -> DataFrame:
    """Numbers within a source."""
    rows = R.numbered(t.documents.select("doc_id", "source"), ["source"], ["doc_id"], "n")
    return rows.select("doc_id", sequence_id(F.col("source"), F.col("n")).alias("qid"))


@query("SELECT doc_id FROM documents QUALIFY row_number() OVER (PARTITION BY lower(text) ORDER BY doc_id) = 1")
def win_keep_first(t: Tables) -> DataFrame:
    """The first of documents of equal folded text: the key is a digest, so texts aren't exchanged."""
    return t.documents.select("doc_id", F.sha2(F.lower("text"), 256).alias("k")).groupBy("k").agg(F.min("doc_id").alias("doc_id")).select("doc_id")


@query("""SELECT user_id || '/' || event_type AS k, min(event_id) AS pos, arg_max(value, event_id) AS value FROM (SELECT user_id, event_type, event_id, value FROM events WHERE value IS NOT NULL) GROUP BY 1""")
def win_last_wins(t: Tables) -> DataFrame:
    """The last row of a key in the place of the first."""
    rows = t.events.where("value IS NOT NULL").select(F.concat_ws("/", F.col("user_id").cast("string"), "event_type").alias("k"), F.col("event_id").alias("pos"), "value")
    return R.last_wins(rows, "k", "pos")


@query("""WITH r AS (SELECT p_partkey AS pos, CASE WHEN p_size % 4 = 0 THEN NULL WHEN p_size % 4 = 1 THEN p_brand ELSE 'u' || (p_partkey % 700) END AS id, p_size AS value FROM part),
n AS (SELECT *, id IS NULL OR row_number() OVER (PARTITION BY id ORDER BY pos) = 1 AS fresh FROM r),
k AS (SELECT pos, value, coalesce(id, 'q-' || lpad(CAST(coalesce(sum(fresh::INTEGER) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + 1 AS VARCHAR), 6, '0')) AS id FROM n)
SELECT id, min(pos) AS pos, arg_max(value, pos) AS value FROM k GROUP BY id""")
def win_numbered(t: Tables) -> DataFrame:
    """The last row of an id in the place of its first, blank ids numbered."""
    n, k = F.col("p_size") % 4, F.col("p_partkey")
    rows = t.part.select(k.alias("pos"), F.when(n == 1, F.col("p_brand")).when(n > 1, F.concat(F.lit("u"), k % 700)).alias("id"), F.col("p_size").alias("value"))
    return R.last_wins_numbered(rows, "id", "pos")


@query("SELECT p_partkey, p_brand, p_size FROM part QUALIFY row_number() OVER (PARTITION BY p_brand, p_size ORDER BY md5('42-' || p_partkey), p_partkey) <= 2")
def win_capped(t: Tables) -> DataFrame:
    """At most two of each group, drawn by digest."""
    return R.capped(t.part, ["p_brand", "p_size"], "p_partkey", 2, 42).select("p_partkey", "p_brand", "p_size")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) <= 2")
def win_first_children(t: Tables) -> DataFrame:
    """The first two replies of each post."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_quantity"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", n.alias("n")).where("n <= 2").drop("n")


@query("""SELECT conv_id, turn, CAST(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS BIGINT) AS rest,
max(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS had_system,
coalesce(length(text) >= lag(length(text)) OVER (PARTITION BY conv_id ORDER BY turn), true) AS rising FROM conversations""")
def win_returns(t: Tables) -> DataFrame:
    """Suffix sums, what came before, and whether a level doesn't fall: one exchange and one sort for all three."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    n = F.length("text")
    return t.conversations.select(
        "conv_id", "turn",
        F.sum(n).over(w.rowsBetween(0, Window.unboundedFollowing)).cast("long").alias("rest"),
        F.max(F.col("role") == "system").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("had_system"),
        F.coalesce(n >= F.lag(n).over(w), F.lit(True)).alias("rising"))


@query("""SELECT a.conv_id, count(*) AS pairs FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn < b.turn AND a.role = 'user' AND b.role = 'assistant' GROUP BY a.conv_id""")
def win_ordered_pairs(t: Tables) -> DataFrame:
    """User turns before assistant turns, as a running count instead of a join."""
    before = F.count_if(F.col("role") == "user").over(Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1))
    rows = t.conversations.withColumn("b", before).where("role = 'assistant'")
    return rows.groupBy("conv_id").agg(F.sum("b").alias("pairs")).where("pairs > 0")


@query("""SELECT conv_id, count(*) - count(DISTINCT (role, text)) AS repeats, arg_min(length(text), turn) AS first_length, arg_max(length(text), turn) AS last_length,
coalesce(max(turn) FILTER (role <> 'system'), 0) AS owner FROM conversations GROUP BY conv_id""")
def win_dialogue(t: Tables) -> DataFrame:
    """Repeated turns, the first and last state, the turn that owns the credit."""
    n = F.length("text")
    return t.conversations.groupBy("conv_id").agg((F.count("*") - F.countDistinct("role", "text")).alias("repeats"), F.min_by(n, "turn").cast("long").alias("first_length"), F.max_by(n, "turn").cast("long").alias("last_length"), F.coalesce(F.max(F.when(F.col("role") != "system", F.col("turn"))), F.lit(0)).cast("long").alias("owner"))


@query("""WITH a AS (SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_returnflag, avg(l_quantity) OVER w AS m, stddev_pop(l_quantity) OVER w AS s FROM lineitem WINDOW w AS (PARTITION BY l_suppkey, l_returnflag))
SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, round((l_quantity - m) / (s + 1e-6), 4) AS advantage FROM a""")
def win_anchors(t: Tables) -> DataFrame:
    """Values by the mean and deviation of those that share an anchor: an aggregate, merged before its exchange."""
    spread = t.lineitem.groupBy("l_suppkey", "l_returnflag").agg(F.avg("l_quantity").alias("m"), F.stddev_pop("l_quantity").alias("s"))
    x = (F.col("l_quantity") - F.col("m")) / (F.col("s") + 1e-6)
    return t.lineitem.join(spread, ["l_suppkey", "l_returnflag"]).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.round(x, 4).alias("advantage"))


@query("""WITH s AS (SELECT l_suppkey % 40 AS g, l_orderkey AS rec, l_linenumber AS n, l_partkey AS p, l_returnflag AS anchor, l_quantity AS suffix, l_linestatus = 'F' AS inherits, l_extendedprice AS price FROM lineitem),
o AS (SELECT *, row_number() OVER (PARTITION BY g, rec ORDER BY n, p, suffix) AS i FROM s), c AS (SELECT *, CASE WHEN inherits AND i > 1 THEN i - 1 ELSE i END AS credit FROM o),
t AS (SELECT g, rec, sum(price) AS total FROM s GROUP BY g, rec), q AS (SELECT g, rec, (total - avg(total) OVER (PARTITION BY g)) / (stddev_pop(total) OVER (PARTITION BY g) + 1e-6) AS seq FROM t),
a AS (SELECT g, rec, i, (suffix - avg(suffix) OVER w) / (stddev_pop(suffix) OVER w + 1e-6) AS act FROM c WHERE credit = i WINDOW w AS (PARTITION BY g, anchor))
SELECT c.g, c.rec, c.i, round(0.5 * seq + 0.5 * coalesce(act, 0), 4) AS mixed FROM c JOIN q USING (g, rec) LEFT JOIN a ON a.g = c.g AND a.rec = c.rec AND a.i = c.credit""")
def win_advantages(t: Tables) -> DataFrame:
    """Advantages of steps: half the sequence's within its group, half the step's among its anchor; some inherit it."""
    rows = t.lineitem.select((F.col("l_suppkey") % 40).alias("g"), F.col("l_orderkey").alias("rec"), "l_linenumber", "l_partkey", F.col("l_returnflag").alias("anchor"), F.col("l_quantity").alias("suffix"), (F.col("l_linestatus") == "F").alias("inherits"), F.col("l_extendedprice").alias("price"))
    i = F.row_number().over(Window.partitionBy("g", "rec").orderBy("l_linenumber", "l_partkey", "suffix"))
    steps = rows.withColumn("i", i).withColumn("credit", F.when(F.col("inherits") & (F.col("i") > 1), F.col("i") - 1).otherwise(F.col("i")))
    totals = steps.groupBy("g", "rec").agg(F.sum("price").alias("total"))
    mixed = R.advantages(steps, totals, "g", "rec", "i", "credit", "anchor", "suffix", "total", 0.5)
    return mixed.select("g", "rec", "i", F.round("mixed", 4).alias("mixed"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT day, CASE WHEN lag(month(day)) OVER (ORDER BY day) = month(day) THEN '' ELSE strftime(day, '%Y-%m') END AS label, CAST(isodow(day) AS INTEGER) AS weekday, CAST(date_trunc('week', day) AS DATE) AS week FROM d""")
def win_calendar(t: Tables) -> DataFrame:
    """Days in weeks, with a month's name where it changes; the days of a year are its bound."""
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    before = F.lag("day").over(Window.partitionBy(F.trunc("day", "month")).orderBy("day"))
    label = F.when(before.isNull(), F.date_format("day", "yyyy-MM")).otherwise("")
    return days.select("day", label.alias("label"), (F.weekday("day") + 1).alias("weekday"), F.trunc("day", "week").alias("week"))


@query("""WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders)
SELECT CAST(date_trunc('week', day) AS DATE) AS week, concat_ws(' ', coalesce(CAST(max(day) FILTER (isodow(day) = 1) AS VARCHAR), '-'), coalesce(CAST(max(day) FILTER (isodow(day) = 2) AS VARCHAR), '-'), coalesce(CAST(max(day) FILTER (isodow(day) = 3) AS VARCHAR), '-'), coalesce(CAST(max(day) FILTER (isodow(day) = 4) AS VARCHAR), '-'), coalesce(CAST(max(day) FILTER (isodow(day) = 5) AS VARCHAR), '-'), coalesce(CAST(max(day) FILTER (isodow(day) = 6) AS VARCHAR), '-'), coalesce(CAST(max(day) FILTER (isodow(day) = 7) AS VARCHAR), '-')) AS days FROM d GROUP BY 1""")
def win_weeks(t: Tables) -> DataFrame:
    """Weeks of seven places, with a mark where a day is missing."""
    days = t.orders.select(F.col("o_orderdate").cast("date").alias("day")).distinct()
    places = [F.coalesce(F.max(F.when(F.weekday("day") == i, F.col("day"))).cast("string"), F.lit("-")) for i in range(7)]
    return days.groupBy(F.trunc("day", "week").alias("week")).agg(F.concat_ws(" ", *places).alias("days"))


@query("""WITH p AS (SELECT doc_id, i AS pos, string_split(text, chr(10))[i] AS para FROM documents, range(1, 100000) r(i) WHERE i <= len(string_split(text, chr(10)))),
s AS (SELECT *, sum(length(para) + 2) OVER (PARTITION BY doc_id ORDER BY pos) AS total FROM p)
SELECT doc_id, count(*) AS paragraphs, CAST(sum(length(para)) AS BIGINT) AS chars FROM s WHERE total <= 600 OR pos = 1 GROUP BY doc_id""")
def win_prefix(t: Tables) -> DataFrame:
    """Paragraphs up to 600 characters, one at least: a fold over each row's own list, without an exchange."""
    paras = F.split("text", "\n")
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("chars"))

    def step(a, p):
        total = a["total"] + F.length(p) + 2
        fits = (total <= 600) | (a["total"] == 0)
        return F.struct(total.alias("total"), (a["n"] + F.when(fits, 1).otherwise(0)).alias("n"), (a["chars"] + F.when(fits, F.length(p)).otherwise(0)).alias("chars"))

    return t.documents.select("doc_id", F.aggregate(paras, zero, step).alias("a")).select("doc_id", F.col("a.n").alias("paragraphs"), F.col("a.chars").alias("chars"))


@query("""SELECT conv_id, bool_and(turn = prev + 1) AS continuous, count(*) FILTER (turn = last) AS ends FROM (SELECT conv_id, turn, coalesce(lag(turn) OVER w, turn - 1) AS prev, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) GROUP BY conv_id""")
def win_continuity(t: Tables) -> DataFrame:
    """Whether turns follow each other and end once."""
    w = Window.partitionBy("conv_id")
    rows = t.conversations.select("conv_id", "turn", F.coalesce(F.lag("turn").over(w.orderBy("turn")), F.col("turn") - 1).alias("prev"), F.max("turn").over(w).alias("last"))
    return rows.groupBy("conv_id").agg(F.bool_and(F.col("turn") == F.col("prev") + 1).alias("continuous"), F.count_if(F.col("turn") == F.col("last")).alias("ends"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def srt_page(t: Tables) -> DataFrame:
    """The third page of a list sorted by what the caller names."""
    rows = t.orders.select("o_orderkey", "o_totalprice")
    return R.page(rows, R.order_columns(rows, "oTotalprice desc, o_orderkey".replace("oTotalprice", "o_totalprice")), 3, None)


@query("SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10")
def srt_top_k(t: Tables) -> DataFrame:
    return t.orders.select("o_orderkey", "o_orderdate").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(10)


@query("SELECT doc_id, source FROM (SELECT doc_id, source FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY doc_id) <= 5) ORDER BY doc_id LIMIT 60")
def srt_caps(t: Tables) -> DataFrame:
    """Five of each source, sixty of all."""
    n = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return t.documents.select("doc_id", "source", n.alias("n")).where("n <= 5").drop("n").orderBy("doc_id").limit(60)


@query("SELECT p_partkey, p_brand FROM part ORDER BY CASE WHEN p_brand = 'Brand#11' THEN 0 ELSE 1 END, md5('42-' || p_partkey), p_partkey LIMIT 400")
def smp_priority(t: Tables) -> DataFrame:
    """All of one class first, then a random fill."""
    return R.priority_sample(t.part.select("p_partkey", "p_brand"), F.col("p_brand") == "Brand#11", "p_partkey", 400, 42)


UNIT = "(CAST(('0x' || substr(md5('7-' || event_id), 1, 8)) AS BIGINT) + 1) / 4294967297.0"


@query(f"SELECT event_id FROM events WHERE value IS NOT NULL ORDER BY round(-ln(CAST({UNIT} AS DOUBLE)) / pow(abs(value) + 1, 0.6), 12), event_id LIMIT 100")
def smp_weighted(t: Tables) -> DataFrame:
    """Without replacement, by priority to the power 0.6: the smallest exponential keys, a top-k of one pass."""
    unit = (F.conv(F.substring(chance(7, F.col("event_id")), 1, 8), 16, 10).cast("long") + 1) / 4294967297.0
    key = F.round(-F.log(unit) / F.pow(F.abs("value") + 1, F.lit(0.6)), 12)
    return t.events.where("value IS NOT NULL").select("event_id", key.alias("k")).orderBy("k", "event_id").limit(100).select("event_id")


#: The draw with replacement: for each place of a batch, the row whose share of the running sum holds its unit.
REPLAY = """WITH e AS (SELECT event_id, event_type = 'purchase' AS offline, pow(abs(value) + 1, 0.6) AS w FROM events WHERE value IS NOT NULL), r AS (SELECT *, sum(w) OVER o AS upto, sum(w) OVER (PARTITION BY offline) AS total, count(*) OVER () AS n FROM e WINDOW o AS (PARTITION BY offline ORDER BY event_id)),
d AS (SELECT i::INTEGER AS place, i < 16 AS offline, (CAST(('0x' || substr(md5('11-' || i), 1, 8)) AS BIGINT) + 0.5) / 4294967296.0 AS u FROM range(32) x(i)),
p AS (SELECT place, event_id, pow(n * 0.5 * w / total, -0.4) AS raw FROM d JOIN r ON d.offline = r.offline AND d.u * total <= upto AND d.u * total > upto - w)"""


@query(REPLAY + " SELECT place, event_id, round(raw / max(raw) OVER (), 6) AS weight FROM p")
def smp_replay(t: Tables) -> DataFrame:
    """32 draws with replacement, half of each kind, by priority to the power 0.6, with importance weights."""
    rows = t.events.where("value IS NOT NULL").select("event_id", (F.col("event_type") == "purchase").alias("offline"), F.pow(F.abs("value") + 1, F.lit(0.6)).alias("w"))
    return R.replayed(rows, "event_id", "w", "offline", 32, 0.4, 0.5, 11)


@query("SELECT user_id, arg_min(event_id, md5('3-' || event_id)) AS picked FROM events GROUP BY user_id")
def smp_pick(t: Tables) -> DataFrame:
    """One random row of each key, the same in each run."""
    return t.events.groupBy("user_id").agg(F.min_by("event_id", chance(3, F.col("event_id"))).alias("picked"))


@query("SELECT l_partkey, n, round(1.0 / n / sum(1.0 / n) OVER (), 8) AS weight FROM (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey)")
def smp_damped(t: Tables) -> DataFrame:
    """Chances that fall with how often an item was shown."""
    n = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"))
    total = n.agg(F.sum(1.0 / F.col("n")).alias("s"))
    return n.join(F.broadcast(total)).select("l_partkey", "n", F.round(1.0 / F.col("n") / F.col("s"), 8).alias("weight"))


@query("SELECT event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) <= 500")
def smp_buffer(t: Tables) -> DataFrame:
    """A buffer that keeps the latest five hundred of each source."""
    n = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("event_id")))
    return t.events.select("event_id", "event_type", n.alias("n")).where("n <= 500").drop("n")


@query("SELECT n_name AS name, 'nation' AS kind FROM nation UNION ALL SELECT r_name, 'region' FROM region")
def set_bag(t: Tables) -> DataFrame:
    return t.nation.select(F.col("n_name").alias("name"), F.lit("nation").alias("kind")).unionByName(t.region.select(F.col("r_name").alias("name"), F.lit("region").alias("kind")))


@query("""WITH seen AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_quantity > 45), left_ AS (SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT p FROM seen))
SELECT p_partkey FROM left_ UNION ALL SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM left_)""")
def set_difference(t: Tables) -> DataFrame:
    """What a user hasn't had yet, or all if nothing is left."""
    seen = t.lineitem.where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    left = t.part.select("p_partkey").join(seen, "p_partkey", "left_anti")
    return t.part.select("p_partkey") if left.isEmpty() else left


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set_union(t: Tables) -> DataFrame:
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("""SELECT p_partkey, len(list_filter(string_split(p_name, ' '), lambda x: NOT list_contains(['red', 'blue', 'ring', 'bolt'], x))) = 0 AS subset,
array_to_string(list_distinct(string_split(p_name, ' ')), ' ') IS NOT NULL AS has_words, list_has_any(string_split(p_name, ' '), ['cold', 'hot']) AS overlaps FROM part""")
def set_tests(t: Tables) -> DataFrame:
    """Subset and overlap of word sets."""
    words = F.split("p_name", " ")
    allowed, temps = F.array(*map(F.lit, ("red", "blue", "ring", "bolt"))), F.array(F.lit("cold"), F.lit("hot"))
    return t.part.select("p_partkey", (F.size(F.array_except(words, allowed)) == 0).alias("subset"), (F.size(F.array_distinct(words)) > 0).alias("has_words"), F.arrays_overlap(words, temps).alias("overlaps"))


@query("""SELECT s_suppkey, s_name, s_acctbal FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, upper(s_name), s_acctbal + 1 FROM supplier WHERE s_suppkey % 5 = 0""")
def set_upsert(t: Tables) -> DataFrame:
    """New rows in place of old ones of their keys."""
    rows = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    new = rows.where("s_suppkey % 5 = 0").select("s_suppkey", F.upper("s_name").alias("s_name"), (F.col("s_acctbal") + 1).alias("s_acctbal"))
    return R.replaced(rows, new, "s_suppkey")


@query("""SELECT coalesce(n.k, o.s_suppkey) AS s_suppkey, coalesce(n.name, o.s_name) AS s_name, coalesce(n.bal, o.s_acctbal) AS s_acctbal FROM supplier o FULL JOIN
(SELECT c_custkey * 3 AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name END AS name, c_acctbal AS bal FROM customer) n ON n.k = o.s_suppkey""")
def dml_merge(t: Tables) -> DataFrame:
    """A merge in which a null leaves the old value."""
    c = F.col("c_custkey")
    new = t.customer.select((c * 3).alias("s_suppkey"), F.when(c % 2 == 0, F.col("c_name")).alias("s_name"), F.col("c_acctbal").alias("s_acctbal"))
    return R.upsert(t.supplier.select("s_suppkey", "s_name", "s_acctbal"), new, "s_suppkey")


@query("""SELECT o_orderkey, CASE WHEN c_custkey IS NULL THEN 'reject' WHEN o_totalprice > 200000 THEN 'update' ELSE 'accept' END AS outcome FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0""")
def dml_import(t: Tables) -> DataFrame:
    """The outcome of each imported row."""
    known = t.customer.where("c_acctbal > 0").select("c_custkey")
    outcome = F.when(F.col("c_custkey").isNull(), "reject").when(F.col("o_totalprice") > 200000, "update").otherwise("accept")
    return t.orders.join(known, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", outcome.alias("outcome"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, CASE WHEN l_returnflag = substr(p_brand, 7, 1) OR (l_returnflag = 'A' AND p_size > 25) THEN 1 ELSE 0 END AS score FROM lineitem JOIN part ON p_partkey = l_partkey""")
def dml_grading(t: Tables) -> DataFrame:
    """Answers graded against the truth."""
    right = (F.col("l_returnflag") == F.substring("p_brand", 7, 1)) | ((F.col("l_returnflag") == "A") & (F.col("p_size") > 25))
    return t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", F.when(right, 1).otherwise(0).alias("score"))


@query("""WITH f AS (SELECT l_orderkey, arg_min(l_returnflag, (l_linenumber, l_partkey, l_quantity)) AS given, arg_min(l_partkey, (l_linenumber, l_partkey, l_quantity)) AS part, count(*) AS n FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, n, CASE WHEN given = CASE p_size % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'N' ELSE 'R' END THEN 1 ELSE 0 END AS score FROM f JOIN part ON p_partkey = part""")
def dml_first_grade(t: Tables) -> DataFrame:
    """Of what is submitted together only the first item is graded into the record."""
    order = F.struct("l_linenumber", "l_partkey", "l_quantity")
    first = t.lineitem.groupBy("l_orderkey").agg(F.min_by(F.struct(F.col("l_returnflag").alias("given"), F.col("l_partkey").alias("part")), order).alias("f"), F.count("*").alias("n"))
    n = F.col("p_size") % 3
    right = F.col("f.given") == F.when(n == 0, "A").when(n == 1, "N").otherwise("R")
    return first.join(t.part, F.col("f.part") == F.col("p_partkey")).select("l_orderkey", "n", F.when(right, 1).otherwise(0).alias("score"))


@query("""SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT 100 + r_regionkey, r_name FROM region UNION ALL SELECT 200, 'none'""")
def dml_insert_rows(t: Tables) -> DataFrame:
    """Several rows appended in one go, from a table and from values, by column name."""
    new = t.region.select(F.col("r_name").alias("name"), (F.lit(100) + F.col("r_regionkey")).alias("k"))
    return R.inserted(t.nation.select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name")), [new, t.spark.createDataFrame([(200, "none")], "k int, name string")])


@query("""SELECT o_orderkey, o_orderstatus = 'P' OR EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal < -500) AS deleted FROM orders""")
def dml_logical_delete(t: Tables) -> DataFrame:
    """A delete flag that parents hand down to their children."""
    gone = t.customer.where("c_acctbal < -500").select("c_custkey", F.lit(True).alias("g"))
    return t.orders.join(gone, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", ((F.col("o_orderstatus") == "P") | F.coalesce("g", F.lit(False))).alias("deleted"))
