"""Every registered query against its DuckDB counterpart on the smallest tables."""

import datetime
import decimal
import glob

import duckdb
import pytest

import __spark_entry__ as contract
from scholia.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        files = glob.glob(f"{SF}/{name}.parquet/*.parquet") or [f"{SF}/{name}.parquet"]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet({files})")
    return con


def plain(x):
    if isinstance(x, float):
        return None if x != x else round(x, 7) + 0.0
    if isinstance(x, decimal.Decimal):
        return round(float(x), 7)
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x.replace(tzinfo=None).isoformat() if isinstance(x, datetime.datetime) else x


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())
    if name not in registry.ORACLES:  # held against literal cases elsewhere
        assert rows
        return
    found = duck.execute(registry.ORACLES[name])
    at = [d[0] for d in found.description]
    assert sorted(at) == columns
    order = [at.index(c) for c in columns]
    assert rows == sorted(repr(tuple(plain(r[i]) for i in order)) for r in found.fetchall())


def test_entry(spark):
    assert contract.entry(spark).count() > 0
