"""Queries of tables that are rewritten in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shared import shared_folder
from ..sources.keyed_table import KeyedTable
from .registry import Tables, query


@query("""WITH kept AS (SELECT o_custkey, o_orderkey, o_orderpriority FROM orders WHERE o_custkey % 11 > 0),
new AS (SELECT o_custkey, o_orderkey, CASE o_custkey % 3 WHEN 0 THEN 'first' WHEN 1 THEN 'second' ELSE o_orderpriority END AS o_orderpriority FROM kept)
SELECT * FROM new WHERE o_custkey % 7 > 0 UNION ALL SELECT o_custkey, max(o_orderkey), 'last' FROM orders WHERE o_custkey % 7 = 0 GROUP BY o_custkey""")
def dml_rewrites(t: Tables) -> DataFrame:
    """Orders after a delete by customer, an update by customer, and a replacement of some customers' orders by their last."""
    orders = t.orders.select("o_custkey", "o_orderkey", "o_orderpriority")
    table = KeyedTable(t.spark, shared_folder(t.spark, "orders"), "o_custkey").create(orders)
    customers = orders.select("o_custkey").distinct()
    table.delete(customers.where("o_custkey % 11 = 0"))
    table.update(customers.where("o_custkey % 3 < 2").withColumn("o_orderpriority", F.when(F.col("o_custkey") % 3 == 0, "first").otherwise("second")))
    last = orders.where("o_custkey % 7 = 0").groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"), F.lit("last").alias("o_orderpriority"))
    table.replace(customers.where("o_custkey % 7 = 0"), last)
    return table.read()
