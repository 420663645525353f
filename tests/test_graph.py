"""The graph index against exact search."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from scholia.operators import graph_index as G
from scholia.plans import registry

LARGE = "/root/testdata/sf0.1"


def test_recall_and_share_visited(spark):
    exact = {(r.query_id, r.vec_id): r.score for r in registry.QUERIES["ret_vectors"](spark, LARGE).collect()}
    rows = registry.QUERIES["ret_graph"](spark, LARGE).collect()
    hits = {(r.query_id, r.vec_id): r.score for r in rows}
    assert len(hits) == len(rows) == len(exact)
    assert len(hits.keys() & exact.keys()) >= 0.9 * len(exact)
    assert all(abs(hits[x] - exact[x]) < 1e-5 for x in hits.keys() & exact.keys())
    visited = {r.query_id: r.visited for r in rows}
    assert 0 < np.mean(list(visited.values())) < 0.3 * spark.read.parquet(f"{LARGE}/embeddings.parquet").count()


@pytest.mark.parametrize("metric", ["inner", "l2"])
@pytest.mark.parametrize("shard_rows", [40, 8192])
def test_a_long_queue_is_exact(spark, monkeypatch, metric, shard_rows):
    """A shard's graph hangs together, so a queue as long as the shard sees all of it; equal vectors, hot ones too, all count."""
    monkeypatch.setattr(G, "SHARD_ROWS", shard_rows)
    rng = np.random.default_rng(2)
    vectors = [(i, (rng.normal(size=6) * (1 + i % 3)).tolist()) for i in range(150)] + [(200 + i, [0.5] * 6) for i in range(90)] + [(3, [0.5] * 6)]
    odd = [(900, None), (901, []), (902, [1.0, None] * 3), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in vectors + vectors[:5] + odd], "vec_id long, embedding array<double>, shard int, q int").repartition(3)
    queries = df.where("vec_id % 10 = 0 or vec_id > 899 or vec_id is null").select(F.col("vec_id").alias("query_id"), "embedding").dropDuplicates(["query_id"])
    rows = G.graph_nearest(G.build_graph(df, "vec_id", "embedding", metric), queries, "query_id", "embedding", "vec_id", 7, 500).orderBy("query_id", "rank").collect()
    own = sorted({(i, tuple(np.float32(v).tolist())) for i, v in vectors})
    wanted = []
    for q in sorted({i for i, _ in vectors if i % 10 == 0}):
        x = np.array(dict(vectors)[q])
        scores = [((float(np.dot(v, x)) if metric == "inner" else float(np.linalg.norm(np.array(v) - x))), i) for i, v in own if i != q]
        wanted += [(q, i) for _, i in sorted(scores, key=lambda s: (-s[0] if metric == "inner" else s[0], s[1]))[:7]]
    assert [(r.query_id, r.vec_id) for r in rows] == wanted and [r["rank"] for r in rows] == [1, 2, 3, 4, 5, 6, 7] * (len(rows) // 7)


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    some = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    graph = G.build_graph(none, "vec_id", "embedding")
    ask = lambda g, q: G.graph_nearest(g, q.select(F.col("vec_id").alias("query_id"), "embedding"), "query_id", "embedding", "vec_id", 3).collect()
    assert not ask(graph, some) and not ask(G.build_graph(some, "vec_id", "embedding"), none) and not ask(G.build_graph(some, "vec_id", "embedding"), some)
    with pytest.raises(ValueError):
        G.build_graph(some, "vec_id", "embedding", "cosine")
