"""A navigable small-world graph over vectors: built shard by shard, kept as Parquet adjacency lists, searched best-first."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Different keys of a shard, on average: what one task holds of the graph at a time.
SHARD_ROWS = 8192
#: Links of a node at most on the upper levels and on the lowest, and candidates they are chosen from.
LINKS, LOW_LINKS, CANDIDATES = 12, 32, 64
#: Queries that one pass over the shards answers.
QUERY_BLOCK = 4096
#: Vectors whose distances are computed at once when a shard is built.
CHUNK = 256
SHARD = "metric string, keys array<bigint>, key_starts array<int>, vectors array<float>, width int, levels array<int>, level_of_list array<int>, node_of_list array<int>, link_starts array<int>, links array<int>"


def _squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0)


def _diverse(points: np.ndarray, most: int) -> list[np.ndarray]:
    """Links of each point: of its nearest ones, those nearer to it than to any link chosen before, and the way back.

    Afterwards parts that don't hang together are joined by their nearest pair of a part's first point.
    """
    n = len(points)
    if n < 2:
        return [np.zeros(0, np.int32)] * n
    width = min(CANDIDATES, n - 1)
    pairs = []
    for a in range(0, n, CHUNK):
        far = _squared(points[a : a + CHUNK], points)
        rows = np.arange(len(far))
        far[rows, rows + a] = np.inf
        near = np.argpartition(far, width - 1, axis=1)[:, :width]
        d = np.take_along_axis(far, near, 1)
        order = np.argsort(d, axis=1, kind="stable")
        near, d = np.take_along_axis(near, order, 1), np.take_along_axis(d, order, 1)
        own = points[near]
        gram = own @ own.transpose(0, 2, 1)
        size = (own * own).sum(2)
        between = size[:, :, None] + size[:, None, :] - 2 * gram
        taken = np.zeros(near.shape, bool)
        for j in range(width):
            hidden = (taken[:, :j] & (between[:, j, :j] < d[:, j, None])).any(1) if j else np.zeros(len(near), bool)
            taken[:, j] = ~hidden & (taken.sum(1) < most)
        rows, at = np.nonzero(taken)
        pairs.append(np.stack([rows + a, near[rows, at]], 1))
    forth = np.concatenate(pairs)
    both = np.unique(np.concatenate([forth, forth[:, ::-1]]), axis=0)
    d = ((points[both[:, 0]] - points[both[:, 1]]) ** 2).sum(1)
    both = both[np.lexsort((d, both[:, 0]))]
    place = np.arange(len(both)) - np.searchsorted(both[:, 0], both[:, 0])
    both = both[place < 2 * most]
    links = [set(x.tolist()) for x in np.split(both[:, 1], np.searchsorted(both[:, 0], np.arange(1, n)))]
    reached, start = np.zeros(n, bool), 0
    while True:
        stack = [start]
        reached[start] = True
        while stack:
            for x in links[stack.pop()]:
                if not reached[x]:
                    reached[x] = True
                    stack.append(x)
        rest = np.flatnonzero(~reached)
        if not len(rest):
            return [np.fromiter(sorted(x), np.int32, len(x)) for x in links]
        start, inside = int(rest[0]), np.flatnonzero(reached)
        home = int(inside[_squared(points[start : start + 1], points[inside])[0].argmin()])
        links[home].add(start)
        links[start].add(home)


def _lengthened(vectors: np.ndarray, metric: str) -> np.ndarray:
    """For inner products one more dimension makes all vectors equally long, so that the nearest has the largest product."""
    own = vectors.astype(np.float64)
    if metric != "inner":
        return own
    size = (own * own).sum(1)
    return np.column_stack([own, np.sqrt(np.maximum(size.max(initial=0) - size, 0))])


def shard_row(keys: np.ndarray, vectors: np.ndarray, metric: str) -> dict:
    """The graph of one shard: equal vectors are one node with all their keys; a node is on a level with chance 1 / LINKS for each."""
    order = np.lexsort((keys, *vectors.T[::-1]))
    keys, vectors = keys[order], vectors[order]
    first = np.ones(len(keys), bool)
    first[1:] = (vectors[1:] != vectors[:-1]).any(1)
    starts = np.flatnonzero(first)
    points = _lengthened(vectors[starts], metric)
    chances = np.random.default_rng(len(starts)).random(len(starts))
    levels = np.floor(-np.log(np.maximum(chances, 1e-12)) / np.log(LINKS)).astype(np.int32)
    lists, level_of, node_of = [], [], []
    for level in range(int(levels.max(initial=0)) + 1):
        own = np.flatnonzero(levels >= level)
        for node, links in zip(own.tolist(), _diverse(points[own], LINKS if level else LOW_LINKS // 2)):
            lists.append(own[links].astype(np.int32))
            level_of.append(level)
            node_of.append(node)
    return {
        "metric": metric, "keys": keys, "key_starts": np.append(starts, len(keys)).astype(np.int32), "vectors": vectors[starts].astype(np.float32).ravel(), "width": vectors.shape[1], "levels": levels,
        "level_of_list": np.array(level_of, np.int32), "node_of_list": np.array(node_of, np.int32), "link_starts": np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32), "links": np.concatenate(lists) if lists else np.zeros(0, np.int32),
    }


class Shard:
    """A shard's graph in memory."""

    def __init__(self, batch: pa.RecordBatch, i: int):
        get = lambda name: batch.column(name)[i].values.to_numpy(zero_copy_only=False)
        self.metric = batch.column("metric")[i].as_py()
        self.keys, self.key_starts = get("keys"), get("key_starts")
        self.vectors = get("vectors").reshape(-1, batch.column("width")[i].as_py()).astype(np.float64)
        self.points = _lengthened(self.vectors, self.metric)
        starts, links = get("link_starts"), get("links")
        self.links: dict[tuple[int, int], np.ndarray] = {k: links[a:b] for k, a, b in zip(zip(get("level_of_list").tolist(), get("node_of_list").tolist()), starts, starts[1:])}
        levels = get("levels")
        self.top = int(levels.max(initial=0))
        self.entry = int(levels.argmax()) if len(levels) else 0

    def search(self, query: np.ndarray, queue: int) -> tuple[list[tuple[float, int]], int]:
        """(squared distance, node) of the best nodes found, by a walk down the levels and a queue of bounded length on the lowest; and
        how many distances were measured."""
        q = np.append(query, 0.0) if self.metric == "inner" else query
        seen = np.zeros(len(self.points), bool)
        far = lambda nodes: ((self.points[nodes] - q) ** 2).sum(1)
        best, measured = [(float(far([self.entry])[0]), self.entry)], 1
        for level in range(self.top, -1, -1):
            width = 1 if level else queue
            seen[:] = False
            seen[[x for _, x in best]] = True
            ahead = list(best)
            heapq.heapify(ahead)
            held = [(-d, x) for d, x in best]
            heapq.heapify(held)
            while ahead:
                d, node = heapq.heappop(ahead)
                if d > -held[0][0] and len(held) >= width:
                    break
                nodes = self.links[level, node]
                nodes = nodes[~seen[nodes]]
                if not len(nodes):
                    continue
                seen[nodes] = True
                measured += len(nodes)
                for d, x in zip(far(nodes).tolist(), nodes.tolist()):
                    if len(held) < width or d < -held[0][0]:
                        heapq.heappush(ahead, (d, x))
                        heapq.heappush(held, (-d, x))
                        if len(held) > width:
                            heapq.heappop(held)
            best = sorted((-d, x) for d, x in held)
        return best, measured

    def nearest(self, key: int, query: np.ndarray, k: int, queue: int) -> tuple[list[tuple[int, float]], int]:
        """The keys and scores of the k best but key itself; all keys of equal vectors count."""
        if not len(self.points):
            return [], 0
        found, measured = self.search(query, queue)
        out = []
        for _, node in found:
            own = self.vectors[node]
            score = float(own @ query) if self.metric == "inner" else float(np.sqrt(((own - query) ** 2).sum()))
            own_keys = self.keys[self.key_starts[node] : self.key_starts[node + 1]]
            out += [(x, score) for x in own_keys[own_keys != key][:k].tolist()]
        sign = -1 if self.metric == "inner" else 1
        return sorted(out, key=lambda x: (sign * x[1], x[0]))[:k], measured


def build_graph(vectors: DataFrame, key: str, column: str, metric: str = "inner") -> DataFrame:
    """One row (SHARD) for each shard of about SHARD_ROWS keys, written; a later search may read it from there.

    Shards are dealt by a hash of the key, so all distances of a shard, which its links are chosen by, are a bounded
    number for each vector. Rows with a null key, a null, empty or not finite vector take no part, nor do those whose length isn't
    the commonest (the longest of these); equal rows are one. No rows give no shards.
    """
    if metric not in ("inner", "l2"):
        raise ValueError(f"no such metric: {metric}")
    v = F.col(column).cast("array<float>")
    fine = F.col(key).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.where(fine).select(F.col(key).cast("long").alias("key"), v.alias("v"))
    sizes = rows.groupBy(F.size("v").alias("width")).agg(F.count("*").alias("n"))
    common = sizes.agg(F.max_by("width", F.struct("n", "width")).alias("width"), F.sum("n").alias("n")).head()
    width, n_shards = common.width or 0, max(1, -(-(common.n or 0) // SHARD_ROWS))
    rows = rows.where(F.size("v") == width).distinct().withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)))

    def build(own: pa.Table) -> pa.Table:
        values = own.column("v").combine_chunks()
        flat = values.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
        row = shard_row(own.column("key").to_numpy(), flat, metric)
        kinds = {"metric": pa.string(), "keys": pa.list_(pa.int64()), "vectors": pa.list_(pa.float32()), "width": pa.int32()}
        names = [c.split()[0] for c in SHARD.split(", ")]
        return pa.table({c: pa.array([row[c]], kinds.get(c, pa.list_(pa.int32()))) for c in names})

    return written(rows.groupBy("shard").applyInArrow(build, SHARD), "graph-shards")


def graph_nearest(graph: DataFrame, queries: DataFrame, query_key: str, column: str, key: str, k: int, queue: int = 0) -> DataFrame:
    """query_key, key, score, rank and visited (distances measured for the query, over all shards) of each query's k best.

    A pass over the shards answers QUERY_BLOCK queries; a shard answers with its k best of each, which are merged. queue (k + 1 at
    least) bounds the best-first search of a shard; longer finds more. Queries of another length than the vectors, and those with
    null or not finite numbers, have no rows; a query's own key is left out.
    """
    spark = graph.sparkSession
    v = F.col(column).cast("array<double>")
    own = queries.where(F.col(query_key).isNotNull() & (F.size(v) > 0) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    asked = written(own.select(F.col(query_key).cast("long").alias("q"), v.alias("v")), "graph-queries")
    n_blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    queue = max(queue, k + 1)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    found = None
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # a row is a shard
    try:
        for block in range(n_blocks):
            rows = asked.where(F.pmod(F.xxhash64("q"), F.lit(n_blocks)) == block).toArrow().to_pylist()
            block_queries = [(r["q"], np.array(r["v"])) for r in rows]

            def run(batches: Iterable[pa.RecordBatch], block_queries=block_queries) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for i in range(batch.num_rows):
                        shard, out = Shard(batch, i), []
                        for q, vector in block_queries:
                            if len(vector) == shard.vectors.shape[1]:
                                hits, measured = shard.nearest(q, vector, k, queue)
                                out += [(q, x, score, None) for x, score in hits]
                                out.append((q, None, None, measured))
                        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], t) for j, t in enumerate((pa.int64(), pa.int64(), pa.float64(), pa.int64()))], ["q", "x", "score", "visited"])

            hits = written(graph.mapInArrow(run, "q long, x long, score double, visited long"), "graph-hits")
            found = hits if found is None else found.unionByName(hits)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    metric = graph.select("metric").head()
    order = F.asc("score") if metric and metric[0] == "l2" else F.desc("score")
    place = F.row_number().over(Window.partitionBy("q").orderBy(order, "x"))
    measured = found.where("x is null").groupBy("q").agg(F.sum("visited").alias("visited"))
    best = found.where("x is not null").drop("visited").withColumn("rank", place).where(F.col("rank") <= k)
    return best.join(measured, "q").select(F.col("q").alias(query_key), F.col("x").alias(key), F.round("score", 6).alias("score"), "rank", "visited")
