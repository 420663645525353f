"""Ranking by shared terms: against the queries' SQL on odd rows, and bounds of what tasks hand on."""

import random

import duckdb
import pytest

from scholia.operators import retrieval, term_search
from scholia.plans import registry

WORDS = ["one", "Two", "THREE", "été", "Ñandú", "İstanbul", "ΟΔΟΣ", "straße", "x²", "naïve—word", "日本", "a.b", "42", "١٢", "é"]


def plain(rows):
    return sorted(repr(tuple(round(x, 6) if isinstance(x, float) else x for x in r)) for r in rows)


def odd(seed=5):
    """Documents with repeated and null ids, null and empty texts; items with repeated and null ids."""
    r = random.Random(seed)
    text = lambda n: r.choice([" ", ", ", "\n", "—"]).join(r.choices(WORDS, weights=range(len(WORDS), 0, -1), k=n))
    docs = [(r.choice([None, *range(250), 7, 7, 7]), r.choice([None, "", "..", *(text(r.randrange(1, 12)) for _ in range(12))])) for _ in range(400)]
    return docs, [(r.choice([None, *range(12)]), r.choice([None, "", text(3), text(6)])) for _ in range(30)]


@pytest.mark.parametrize("name", ["ret_bm25", "ret_fusion"])
def test_odd_rows(spark, tmp_path, name):
    docs, items = odd()
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for table in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    found = con.execute(registry.ORACLES[name])
    df = registry.QUERIES[name](spark, str(tmp_path)).select(*[d[0] for d in found.description])
    assert plain(df.collect()) == plain(found.fetchall())


def test_pairs_are_no_rows(spark):
    """Every document meets every query; tasks hand on k rows a query, of equal scores those of the smallest keys."""
    docs = spark.range(9000).selectExpr("9000 - id AS k", "concat('same words', IF(id % 2 = 0, '', ' more')) AS text").repartition(3)
    queries = spark.createDataFrame([(f"q{i}", "words same") for i in range(5)], "q string, text string")
    (block,) = term_search.blocks(docs, queries, "k", "q")
    for found in (block.bm25(4, 0.9, 0.4), block.counts(4)):
        assert found.count() <= 3 * 5 * 4
    best = retrieval.bm25(docs, queries, "k", "q", 4).where("q = 'q3'").orderBy("rank").collect()
    assert [r.k for r in best] == [2, 4, 6, 8]


def test_blocks_and_slices(spark, monkeypatch):
    """Blocks of few terms, small slices and keys of strings change nothing; nothing gives nothing."""
    docs, items = odd(8)
    docs = spark.createDataFrame([(None if k is None else f"d{k:03}", t) for k, t in docs], "k string, text string")
    items = spark.createDataFrame(items, "q long, text string")
    whole = [plain(x.collect()) for x in retrieval.bm25_and_counts(docs, items, "k", "q", 6)]
    assert all(whole)
    for limit in ("BLOCK_TERMS", "SPLIT_BYTES", "SUMMED"):
        monkeypatch.setattr(term_search, limit, 16)
    assert [plain(x.collect()) for x in retrieval.bm25_and_counts(docs, items, "k", "q", 6)] == whole
    for a, b in ((docs.limit(0), items), (docs, items.limit(0)), (docs, items.where("text = ''"))):
        assert not any(x.collect() for x in retrieval.bm25_and_counts(a, b, "k", "q", 6))
