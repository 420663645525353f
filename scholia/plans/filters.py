"""Queries of projections and predicates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import numbers, text
from ..operators.relational import Where, not_in
from .registry import Tables, query


@query("""SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 100000
AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1997-01-01'""")
def flt_if_present(t: Tables) -> DataFrame:
    """A list page whose form has some fields filled in and others blank."""
    where = Where().eq("o_orderstatus", "O").eq("o_orderpriority", "").isin("o_orderpriority", ["1-URGENT", "2-HIGH"]).between("o_totalprice", 100000.0, None)
    return where.days("o_orderdate", "1995-01-01", "1996-12-31").like("o_orderstatus", " ").isin("o_custkey", [])(t.orders).select("o_orderkey", "o_totalprice")


@query("SELECT c_custkey, c_name FROM customer WHERE lower(c_name) LIKE '%omer#00000001%'")
def flt_like(t: Tables) -> DataFrame:
    """Substring search whatever the case."""
    return Where().like("c_name", "OMER#00000001")(t.customer).select("c_custkey", "c_name")


@query("SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(replace(p_name, ' ', ','), ','), 'widget')")
def flt_find_in_set(t: Tables) -> DataFrame:
    """An id in a comma-separated path."""
    return t.part.where(F.find_in_set(F.lit("widget"), F.translate("p_name", " ", ",")) > 0).select("p_partkey", "p_name")


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey <> 3 AND n_regionkey <> 3")
def flt_outside_subtree(t: Tables) -> DataFrame:
    """Nodes but one and all below it, by their paths."""
    path = F.concat_ws(",", F.lit("0"), F.col("n_regionkey").cast("string"))
    return t.nation.where((F.col("n_nationkey") != 3) & (F.find_in_set(F.lit("3"), path) == 0)).select("n_nationkey", "n_name")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 150000)")
def flt_in_subquery(t: Tables) -> DataFrame:
    return t.customer.join(t.orders.where("o_totalprice > 150000").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("""SELECT 'plain' AS kind, c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)
UNION ALL SELECT 'with null', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT nullif(o_custkey, 7) FROM orders) UNION ALL SELECT 'empty', c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice < 0)""")
def flt_not_in(t: Tables) -> DataFrame:
    """NOT IN with its rules for nulls: of some values, of values with a null (nothing), of no values (all)."""
    keys = t.customer.select("c_custkey")
    plain = not_in(keys, "c_custkey", t.orders.where("o_totalprice > 300000").select("o_custkey"))
    null = not_in(keys, "c_custkey", t.orders.select(F.nullif(F.col("o_custkey"), F.lit(7)).alias("o_custkey")))
    empty = not_in(keys, "c_custkey", t.orders.where("o_totalprice < 0").select("o_custkey"))
    return plain.select(F.lit("plain").alias("kind"), "c_custkey").unionByName(null.select(F.lit("with null").alias("kind"), "c_custkey")).unionByName(empty.select(F.lit("empty").alias("kind"), "c_custkey"))


@query("""SELECT doc_id, lower(text) LIKE '%stupid%' OR lower(text) LIKE '%moron%' OR lower(text) LIKE '%clown%' AS risky,
contains(text, 'Apache License') AS licensed FROM documents""")
def flt_keywords(t: Tables) -> DataFrame:
    """Any of some keywords in whole texts; a phrase by its exact case."""
    return t.documents.select("doc_id", text.keyword_any(F.col("text"), ["stupid", "Moron", "clown"]).alias("risky"), F.col("text").contains("Apache License").alias("licensed"))


@query("""SELECT p_partkey, array_to_string(list_filter([CASE WHEN p_size > 10 THEN 'A:' || p_brand END, CASE WHEN trim(p_name) <> '' THEN 'B:' || p_name END,
CASE WHEN p_retailprice > 1000 THEN 'C:' || p_type END], lambda x: x IS NOT NULL), '|') AS choices FROM part""")
def flt_choices(t: Tables) -> DataFrame:
    """Wide choice columns to a list of those that aren't blank, in order."""
    wide = F.array(*[F.when(c, F.struct(F.lit(k).alias("title"), F.col(v).alias("choice"))) for k, v, c in (("A", "p_brand", F.col("p_size") > 10), ("B", "p_name", F.trim("p_name") != ""), ("C", "p_type", F.col("p_retailprice") > 1000))])
    kept = F.filter(wide, lambda x: x.isNotNull() & (F.trim(x["choice"]) != ""))
    return t.part.select("p_partkey", F.array_join(F.transform(kept, lambda x: F.concat(x["title"], F.lit(":"), x["choice"])), "|").alias("choices"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%a%' THEN p_brand WHEN p_type LIKE '%STEEL%' THEN p_type ELSE 'none' END AS answer,
CASE WHEN contains(p_type, 'BRASS') THEN 'image' ELSE 'text' END AS kind, coalesce(nullif(p_brand, 'Brand#11'), '') AS brand FROM part""")
def flt_first_match(t: Tables) -> DataFrame:
    """The first matching column pair, a kind by content, a default for nothing."""
    answer = F.coalesce(F.when(F.col("p_name").contains("a"), F.col("p_brand")), F.when(F.col("p_type").contains("STEEL"), F.col("p_type")), F.lit("none"))
    kind = F.when(F.col("p_type").contains("BRASS"), "image").otherwise("text")
    return t.part.select("p_partkey", answer.alias("answer"), kind.alias("kind"), F.coalesce(F.nullif(F.col("p_brand"), F.lit("Brand#11")), F.lit("")).alias("brand"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN '300.1.1.1' WHEN event_id % 3 = 0 THEN '192.168.' || (event_id % 256) || '.7' ELSE '8.' || (event_id % 250) || '.4.4' END AS ip FROM events)
SELECT event_id, ip, CASE WHEN event_id % 7 <> 0 THEN event_id % 3 = 0 OR (event_id % 250 BETWEEN 3 AND 9) END AS allowed, CASE WHEN event_id % 7 <> 0 THEN event_id % 3 = 0 END AS internal FROM e""")
def flt_ip(t: Tables) -> DataFrame:
    """Addresses against single ones, wildcards and ranges; null where the address isn't one."""
    n = F.col("event_id")
    ip = F.when(n % 7 == 0, "300.1.1.1").when(n % 3 == 0, F.concat(F.lit("192.168."), (n % 256).cast("string"), F.lit(".7"))).otherwise(F.concat(F.lit("8."), (n % 250).cast("string"), F.lit(".4.4")))
    rows = t.events.select("event_id", ip.alias("ip"))
    return rows.select("event_id", "ip", numbers.ip_allowed(F.col("ip"), ["192.168.*.*", "8.3.0.0-8.9.255.255"]).alias("allowed"), numbers.internal_ip(F.col("ip")).alias("internal"))


@query("SELECT page_id, url, regexp_matches(url, '^https?://[^/]*/.*$') AS has_path, regexp_matches(url, '^[^?]*[0-9]$') AS ends_in_digit FROM pages")
def flt_path(t: Tables) -> DataFrame:
    """Addresses against path patterns."""
    url = F.col("url")
    return t.pages.select("page_id", "url", (url.rlike(text.ant_pattern("http://*/**")) | url.rlike(text.ant_pattern("https://*/**"))).alias("has_path"), url.rlike("^[^?]*[0-9]$").alias("ends_in_digit"))


@query("""SELECT c_custkey, list_has_any(['*', c_mktsegment], ['BUILDING', 'MACHINERY']) AS any_role, NOT list_contains([c_mktsegment], 'BUILDING') AS lacks_role,
c_custkey = 1 OR c_mktsegment = 'AUTOMOBILE' AS permitted FROM customer""")
def flt_roles(t: Tables) -> DataFrame:
    """Role tests, with a user to whom all is permitted."""
    roles = F.array(F.lit("*"), F.col("c_mktsegment"))
    asked = F.array(F.lit("BUILDING"), F.lit("MACHINERY"))
    return t.customer.select("c_custkey", F.arrays_overlap(roles, asked).alias("any_role"), (~F.array_contains(F.array("c_mktsegment"), "BUILDING")).alias("lacks_role"), ((F.col("c_custkey") == 1) | (F.col("c_mktsegment") == "AUTOMOBILE")).alias("permitted"))


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type <> 'error' AND value IS NOT NULL AND ts >= TIMESTAMP '2024-01-01' ")
def flt_timestamps(t: Tables) -> DataFrame:
    """A raw time range with a soft-delete flag and a null test."""
    return t.events.where((F.col("event_type") != "error") & F.col("value").isNotNull() & (F.col("ts") >= F.lit("2024-01-01").cast("timestamp_ntz"))).select("event_id", "user_id", "event_type")
