"""Rewrites of a keyed table: what changes, what is left alone, and a write that fails."""

import os

import pytest
from pyspark.sql import functions as F

from scholia.sources.keyed_table import KeyedTable

SCHEMA = "k long, v string, new_0 int"


def files(path):
    return {f"{d}/{n}" for d, _, names in os.walk(path) for n in names if n.endswith(".parquet")}


def test_rewrites(spark, tmp_path):
    path = str(tmp_path / "t")
    table = KeyedTable(spark, path, "k", 8).create(spark.createDataFrame([(i % 40, f"v{i}", i) for i in range(120)] + [(None, "none", 1)], SCHEMA))
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "k long")
    rows = lambda: sorted(((r.k, r.v, r.new_0) for r in table.read().collect()), key=str)
    wanted = [(i % 40, f"v{i}", i) for i in range(120)] + [(None, "none", 1)]
    before = files(path)
    table.delete(keys(3, 999))
    wanted = [r for r in wanted if r[0] != 3]
    assert rows() == sorted(wanted, key=str) and len(before & files(path)) >= 5
    table.update(spark.createDataFrame([(5, "five", None), (None, None, 7), (3, "x", 0)], SCHEMA))
    wanted = [(k, "five" if k == 5 else v, 7 if k is None else n) for k, v, n in wanted]
    assert rows() == sorted(wanted, key=str)
    table.replace(keys(6, 7), spark.createDataFrame([(6, "a", 0), (6, "b", 0), (8, "no", 0)], SCHEMA))
    wanted = [r for r in wanted if r[0] not in (6, 7)] + [(6, "a", 0), (6, "b", 0)]
    assert rows() == sorted(wanted, key=str)
    with pytest.raises(Exception):
        table.update(keys(6).select("k", F.raise_error(F.lit("no")).cast("string").alias("v")))
    assert rows() == sorted(wanted, key=str)
    table.replace(keys(6, 7), spark.createDataFrame([(6, "a", 0), (6, "b", 0)], SCHEMA))
    assert rows() == sorted(wanted, key=str)
    table.delete(table.read().select("k"))
    assert rows() == []
    table.delete(keys())
    table.create(spark.createDataFrame([(1, "x", 1)], SCHEMA))
    assert rows() == [(1, "x", 1)]
