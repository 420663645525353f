"""Exact search against a loop over all pairs."""

import decimal
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.operators import exact_search, retrieval


def score(a, b, metric):
    if a is None or b is None or len(a) != len(b) or None in a or None in b:
        return None
    out = 0.0
    for x, y in zip(a, b):
        out += x * y if metric == "inner" else (x - y) * (x - y)
    out = out if metric == "inner" else math.sqrt(out)
    return out if not abs(out) < 1e9 else float(decimal.Decimal(repr(out)).quantize(decimal.Decimal("0.000001"), decimal.ROUND_HALF_UP)) + 0.0


def place(s, metric):
    if s is None:
        return (2, 0.0)
    if s != s:
        return (0, 0.0) if metric == "inner" else (1.5, 0.0)
    return (1, s if metric == "l2" else -s)


@pytest.mark.parametrize("metric", ["inner", "l2"])
@pytest.mark.parametrize("block, k", [(4096, 7), (3, 4), (4096, 700)])
def test_every_pair_counts(spark, monkeypatch, metric, block, k):
    """Copies, near copies that round alike, nulls, lists of other lengths, infinite and missing numbers; blocks and chunks."""
    monkeypatch.setattr(retrieval, "BLOCK", block)
    rng = np.random.default_rng(5)
    own = [(i, rng.normal(size=5).tolist()) for i in range(300)] + [(1000 + i, [0.25, 0.5, 0.0, 1.0, -1.0]) for i in range(120)]
    own += [(2000 + i, [0.25 + i * 1e-7, 0.5, 0.0, 1.0, -1.0]) for i in range(60)]
    inf, nan = float("inf"), float("nan")
    own += [(3000, None), (3001, [1.0, None, 1.0, 1.0, 1.0]), (3002, [1.0]), (3003, []), (3004, [nan] * 5), (3005, [inf, 0.0, 0.0, 0.0, 0.0]), (3006, [1e200] * 5), (3008, None), (3010, [0.0] * 5)]
    df = spark.createDataFrame([*own, (None, [1.0] * 5)], "vec_id long, embedding array<double>").repartition(3)
    queries = df.where("vec_id % 50 = 0 or vec_id >= 3000 or vec_id is null").select(F.col("vec_id").alias("query_id"), "embedding")
    found = retrieval.nearest(df, queries, "vec_id", "query_id", "embedding", k, metric).collect()
    wanted = {}
    for q, b in own:
        if q % 50 == 0 or q >= 3000:
            rows = sorted(((place(s, metric), i, s) for i, s in ((i, score(a, b, metric)) for i, a in own if i != q)), key=lambda r: r[:2])[:k]
            wanted |= {(q, n): (i, s) for n, (_, i, s) in enumerate(rows, 1)}
    assert len(found) == len(wanted)
    for r in found:
        i, s = wanted[r.query_id, r["rank"]]
        assert r.vec_id == i and (r.score == s or (s != s and r.score != r.score)), (r, i, s)


def test_few_pairs_are_scored(monkeypatch):
    """What is scored in order grows with k, not with the vectors."""
    import pyarrow as pa

    seen, plain = [], exact_search.scores
    monkeypatch.setattr(exact_search, "scores", lambda a, b, metric: seen.append(len(a)) or plain(a, b, metric))
    rng = np.random.default_rng(6)
    v = pa.array(list(rng.normal(size=(20_000, 8))), pa.list_(pa.float64()))
    block = exact_search.Block(np.arange(0, 1000, 50), v.take(pa.array(range(0, 1000, 50))), 10, "l2")
    hits = list(block.search([pa.RecordBatch.from_arrays([pa.array(range(20_000)), v], ["k", "v"])]))
    assert hits and sum(seen) < 20 * 20_000 / 20
