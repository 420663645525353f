"""Queries of joins, data scopes and trees."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import relational as R
from .registry import Tables, query


@query("SELECT o_orderkey, l_linenumber, p_name FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F'")
def jn_inner(t: Tables) -> DataFrame:
    """Favourites to questions through a bridge; columns are cut to what is read."""
    orders = t.orders.where("o_orderstatus = 'F'").select("o_orderkey")
    return t.lineitem.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(t.part, F.col("l_partkey") == F.col("p_partkey")).select("o_orderkey", "l_linenumber", "p_name")


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P' GROUP BY c_custkey")
def jn_left_on(t: Tables) -> DataFrame:
    """A predicate in the join, so customers without such orders stay; orders are counted before the join."""
    counts = t.orders.where("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("k"))
    return t.customer.join(counts, "c_custkey", "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, cn.n_name AS buyer, sn.n_name AS seller FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN supplier ON l_suppkey = s_suppkey JOIN nation cn ON c_nationkey = cn.n_nationkey JOIN nation sn ON s_nationkey = sn.n_nationkey""")
def jn_two_roles(t: Tables) -> DataFrame:
    """One table joined twice."""
    nation = t.nation.select("n_nationkey", "n_name")
    buyers = t.customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("buyer"))
    sellers = t.supplier.join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.col("n_name").alias("seller"))
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).join(buyers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.join(sellers, F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "l_linenumber", "buyer", "seller")


@query("""SELECT c_custkey, n_name, r_name, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS roles FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey
LEFT JOIN region ON n_regionkey = r_regionkey LEFT JOIN orders ON o_custkey = c_custkey GROUP BY ALL""")
def jn_nested_roles(t: Tables) -> DataFrame:
    """User, department and the list of roles."""
    roles = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.array_join(F.array_sort(F.collect_set("o_orderpriority")), ",").alias("roles"))
    rows = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"), "left").join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return rows.join(roles, "c_custkey", "left").select("c_custkey", "n_name", "r_name", "roles")


@query("SELECT DISTINCT n_name, l_shipmode_like AS status FROM (SELECT n_name, l_linestatus AS l_shipmode_like FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)")
def jn_distinct(t: Tables) -> DataFrame:
    """Distinct before the last join, so few rows meet it."""
    pairs = t.lineitem.select("l_suppkey", "l_linestatus").distinct()
    return pairs.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_name", F.col("l_linestatus").alias("status")).distinct()


@query("SELECT n_nationkey, n_name, (SELECT r_name FROM region WHERE r_regionkey = n_regionkey) AS parent_name FROM nation")
def jn_parent_name(t: Tables) -> DataFrame:
    return t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_nationkey", "n_name", F.col("r_name").alias("parent_name"))


@query("SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 49 AND l_returnflag = 'R')")
def jn_unanswered(t: Tables) -> DataFrame:
    """Questions without such an answer."""
    return t.part.join(t.lineitem.where("l_quantity > 49 AND l_returnflag = 'R'").select(F.col("l_partkey").alias("p_partkey")), "p_partkey", "left_anti").select("p_partkey")


@query("SELECT p_partkey, CASE WHEN f.k IS NULL THEN '0' ELSE '1' END AS favourite FROM part LEFT JOIN (SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_returnflag = 'R') f ON k = p_partkey")
def jn_flag(t: Tables) -> DataFrame:
    """A yes or no by existence."""
    liked = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_partkey").alias("k")).distinct()
    return t.part.join(liked, F.col("k") == F.col("p_partkey"), "left").select("p_partkey", F.when(F.col("k").isNotNull(), "1").otherwise("0").alias("favourite"))


@query("""SELECT c_custkey, c_nationkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_nationkey IN (1, 2) OR n_regionkey = 3 OR c_nationkey = 3 OR c_custkey = 42""")
def jn_data_scope(t: Tables) -> DataFrame:
    """Rows that a user's roles may see: listed departments, the own one with all below, own rows."""
    depts = t.nation.select("n_nationkey", F.col("n_regionkey").cast("string").alias("above"))
    roles = [{"scope": 2, "depts": [1, 2]}, {"scope": 4}, {"scope": 4}, {"scope": 5}]
    seen = R.data_scope(roles, 42, 3, "c_nationkey", "above", "c_custkey")
    return t.customer.join(depts, F.col("c_nationkey") == F.col("n_nationkey")).where(seen).select("c_custkey", "c_nationkey")


TREE = """WITH RECURSIVE n AS (SELECT p_partkey AS node, CASE WHEN p_partkey % 10 = 1 THEN -1 ELSE p_partkey // 2 END AS parent FROM part),
t AS (SELECT node, 0 AS depth, CAST(node AS VARCHAR) AS path FROM n WHERE parent NOT IN (SELECT node FROM n)
UNION ALL SELECT n.node, depth + 1, path || ',' || n.node FROM t JOIN n ON n.parent = t.node)"""


def _tree(t: Tables) -> DataFrame:
    nodes = t.part.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 10 == 1, F.lit(-1).cast("long")).otherwise(F.floor(F.col("p_partkey") / 2)).alias("parent"))
    return R.depths(nodes, "node", "parent")


@query(TREE + " SELECT node, depth, path FROM t")
def jn_tree(t: Tables) -> DataFrame:
    """A forest from parent links: depth and path of each node."""
    return _tree(t)


@query(TREE + " SELECT node, CASE WHEN path = '2' OR starts_with(path, '2,') THEN '7,2' || substr(path, 2) ELSE path END AS path FROM t")
def jn_reparent(t: Tables) -> DataFrame:
    """A subtree moved below another node."""
    return _tree(t).select("node", R.reparented(F.col("path"), "2", "7,2").alias("path"))


@query("SELECT p_partkey, k AS keyword FROM part, (SELECT unnest(['BRASS', 'STEEL', 'PROMO']) AS k) WHERE list_contains(string_split(p_type, ' '), k)")
def jn_keywords(t: Tables) -> DataFrame:
    """Keywords to items whose categories hold them: the items' words meet the keywords by equality."""
    words = t.spark.createDataFrame([("BRASS",), ("STEEL",), ("PROMO",)], "keyword string")
    items = t.part.select("p_partkey", F.explode(F.array_distinct(F.split("p_type", " "))).alias("keyword"))
    return items.join(F.broadcast(words), "keyword").select("p_partkey", "keyword")


@query("""SELECT o_orderkey, coalesce(c.c_name, 'n:' || n.n_name, 'none') AS found FROM orders LEFT JOIN customer c ON o_custkey = c_custkey AND c_acctbal > 5000
LEFT JOIN nation n ON o_custkey % 40 = n_nationkey""")
def jn_tiers(t: Tables) -> DataFrame:
    """A lookup by the exact key, else by a coarser one, else a default."""
    exact = t.customer.where("c_acctbal > 5000").select("c_custkey", "c_name")
    rows = t.orders.join(exact, F.col("o_custkey") == F.col("c_custkey"), "left").join(t.nation, F.col("o_custkey") % 40 == F.col("n_nationkey"), "left")
    return rows.select("o_orderkey", F.coalesce("c_name", F.concat(F.lit("n:"), "n_name"), F.lit("none")).alias("found"))


@query("""SELECT event_id, (SELECT max(v.event_id) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND (v.ts, v.event_id) < (e.ts, e.event_id)
AND v.ts = (SELECT max(w.ts) FROM events w WHERE w.user_id = e.user_id AND w.event_type = 'view' AND (w.ts, w.event_id) < (e.ts, e.event_id))) AS opened FROM events e WHERE event_type = 'purchase'""")
def jn_latest_open(t: Tables) -> DataFrame:
    """The latest earlier view of the same user for each purchase: one window over both, no join."""
    past = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    opened = F.last(F.when(F.col("event_type") == "view", F.col("event_id")), True).over(past)
    rows = t.events.where(F.col("event_type").isin("view", "purchase")).select("event_id", "event_type", opened.alias("opened"))
    return rows.where("event_type = 'purchase'").select("event_id", "opened")


@query("SELECT o_custkey, string_agg(p_name, ';' ORDER BY ord, l_partkey, p_name) AS names FROM (SELECT o_custkey, o_orderkey AS ord, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey) JOIN part ON p_partkey = l_partkey GROUP BY o_custkey")
def jn_id_list(t: Tables) -> DataFrame:
    """A stored list of ids, looked up one by one and joined again in its order."""
    lists = t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_custkey").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "l_partkey"))), lambda x: x["l_partkey"].cast("string")), " ").alias("ids"))
    ids = lists.select("o_custkey", F.posexplode(F.split("ids", " ")).alias("pos", "id")).withColumn("p_partkey", F.col("id").cast("long"))
    named = ids.join(t.part.select("p_partkey", "p_name"), "p_partkey")
    return named.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "p_name"))), lambda x: x["p_name"]), ";").alias("names"))
