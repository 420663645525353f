"""Approximate nearest neighbours by multiprobe p-stable hashing.

Each table rounds a few Gaussian projections of a vector to cells of one width. A query visits a table's buckets in the
order of the chance that a neighbour at the expected distance lies there (the product over projections of normal
masses of cells), until these chances sum up to the table's share of the wanted recall. Queries come in blocks: a block's
visits (bucket numbers and queries) are broadcast, and each task looks its vectors' buckets up in them, merges the
tables' candidates in one bit for each query and vector, and reranks these by exact distances, so that vectors are never
moved and a task gives k rows a query. Equal vectors are one vector with its smallest ids. The widths and the distance
come from a bounded sample; every vector is indexed.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from math import ceil, erf, log2, sqrt

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table, written

TABLES, WANTED, SEED = 12, 0.95, 4
#: Vectors that fit the widths and the distance; queries of a block (some 8 KB of visits each); vectors compared at a time.
SAMPLE, BLOCK, BATCH = 4096, 1024, 2048
#: Cells to either side of a query's own that probes may reach, probes of a table at most (a query that hits this limit
#: short of its share is searched exactly), and their mean at most.
REACH, PROBES, USUAL = 3, 256, 64


@dataclass
class Index:
    """Projections, offsets and cell width, with the distance at which neighbours are expected."""

    directions: np.ndarray  # tables x projections x dimensions
    offsets: np.ndarray
    width: float
    distance: float

    def places(self, x: np.ndarray) -> np.ndarray:
        """rows x tables x projections, in cells."""
        return np.einsum("nd,tpd->ntp", x, self.directions) / self.width + self.offsets

    def codes(self, cells: np.ndarray) -> np.ndarray:
        """One number for each table's cell; cells that share a number share a bucket."""
        code = np.zeros(cells.shape[:-1], np.uint64)
        for p in range(cells.shape[-1]):
            code = (code ^ cells[..., p].astype(np.int64).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        return code.astype(np.int64)

    def probes(self, place: np.ndarray, share: float) -> tuple[list[tuple[int, ...]], bool]:
        """Cells of one table, likeliest first, whose chances sum to share; whether they do."""
        spread = max(self.distance / self.width, 1e-9) * sqrt(2)
        choices = []
        for y in place:
            own = int(np.floor(y))
            mass = [(0.5 * (erf((c + 1 - y) / spread) - erf((c - y) / spread)), c) for c in range(own - REACH, own + REACH + 1)]
            choices.append(sorted(mass, reverse=True))
        heap, seen, found, total = [], {(0,) * len(place)}, [], 0.0
        heapq.heappush(heap, (-np.prod([c[0][0] for c in choices]), (0,) * len(place)))
        while heap and len(found) < PROBES:
            chance, at = heapq.heappop(heap)
            found.append(tuple(c[i][1] for c, i in zip(choices, at)))
            total -= chance
            if total >= share:
                return found, True
            for p in range(len(at)):
                if at[p] + 1 < len(choices[p]):
                    after = (*at[:p], at[p] + 1, *at[p + 1 :])
                    if after not in seen:
                        seen.add(after)
                        heapq.heappush(heap, (-np.prod([c[i][0] for c, i in zip(choices, after)]), after))
        return found, False


def usable(column: Column) -> Column:
    """Not null, not zero, and with finite components only."""
    return column.isNotNull() & F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(column, lambda x: x != 0)


def _matrix(column: Iterable[bytes], kind: type = np.float64) -> np.ndarray:
    rows = [np.frombuffer(x, "<f8") for x in column]
    return np.array(rows, kind).reshape(len(rows), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean, in double precision, of all rows of a to all of b."""
    out = np.empty((len(a), len(b)))
    for i, x in enumerate(a):
        d = b - x
        out[i] = np.sqrt(np.einsum("nd,nd->n", d, d))
    return out


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """vector (little-endian doubles) and its ids, the k + 1 smallest: enough for any query's k nearest."""

    def local(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list[int]] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.list_(pa.int64()))], ["vector", "ids"])

        for batch in batches:
            for vec_id, values in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist()):
                ids = seen.setdefault((np.array(values, "<f8") + 0.0).tobytes(), [])
                ids.append(vec_id)
                if len(ids) > 8 * k:
                    ids[:] = sorted(ids)[: k + 1]
            if len(seen) > 50_000:
                yield out()
                seen.clear()
        yield out()

    partial = rows.mapInArrow(local, "vector binary, ids array<long>").select("vector", F.slice(F.sort_array("ids"), 1, k + 1).alias("ids"))
    return partial.groupBy("vector").agg(F.slice(F.sort_array(F.flatten(F.collect_list("ids"))), 1, k + 1).alias("ids"))


def fit(vectors: DataFrame, n: int, k: int, seed: int = SEED) -> Index | None:
    """An index whose buckets hold some dozens to hundreds of the n vectors, from at most SAMPLE of them."""
    rows = vectors.select("vector").orderBy(F.xxhash64("vector", F.lit(seed))).limit(SAMPLE).collect()
    if not rows:
        return None
    x = _matrix(r[0] for r in rows)
    some = distances(x[:64], x)
    # The k-th neighbour among all rows is about as far as the one of that share in the sample, the first one at least.
    at = min(len(x) - 1, max(1, round(k * len(x) / max(n, 1))))
    distance = float(np.median(np.partition(some, at, axis=1)[:, at])) or 1e-9
    rng = np.random.default_rng(seed)
    share = 1 - (1 - WANTED) ** (1 / TABLES)
    # Finer buckets where there are more vectors, but no finer than what some dozen probes of a table can cover.
    for projections in range(max(2, min(12, round(log2(max(n, 4) / 100) / 1.6))), 1, -1):
        index = Index(rng.standard_normal((TABLES, projections, x.shape[1])), rng.uniform(0, 1, (TABLES, projections)), distance, distance)
        tried = [index.probes(place[0], share) for place in index.places(x[:32])]
        if all(enough for _, enough in tried) and np.mean([len(cells) for cells, _ in tried]) <= USUAL:
            break
    return index


FOUND = "query_id long, vec_id long, score double"


@dataclass
class Visits:
    """A block of queries and, of each table, the buckets they visit, sorted, with the queries that do; none: all."""

    ids: np.ndarray
    x: np.ndarray
    tables: list[tuple[np.ndarray, np.ndarray]] | None

    def candidates(self, codes: np.ndarray) -> np.ndarray:
        """rows of codes x queries: whether a table has the row's bucket among the query's visits."""
        found = np.zeros((len(codes), len(self.ids)), bool)
        for t, (buckets, queries) in enumerate(self.tables):
            low, high = np.searchsorted(buckets, codes[:, t]), np.searchsorted(buckets, codes[:, t], "right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            found[np.repeat(np.arange(len(codes)), n), queries[at]] = True
        return found


class Best:
    """Each query's k nearest ids so far."""

    def __init__(self, visits: Visits, k: int):
        self.visits, self.k, self.rows = visits, k, []
        self.limit = np.full(len(visits.ids), np.inf)  # no id farther than this is among the k

    def add(self, y: np.ndarray, ids: list[np.ndarray], codes: np.ndarray | None) -> None:
        x, k = self.visits.x, self.k
        mask = self.visits.candidates(codes) if codes is not None and self.visits.tables is not None else np.ones((len(y), len(x)), bool)
        # By inner products first, with more room than their rounding needs; what may be among the k is measured exactly.
        scale = (y * y).sum(1)[:, None] + (x * x).sum(1)[None]
        rough = np.where(mask, np.maximum(scale - 2 * (y @ x.T), 0) - 1e-9 * scale, np.inf)
        few = min(k, len(y) - 1)  # the own vector may be one of them
        bound = np.minimum(np.partition(rough, few, axis=0)[few] + 3e-9 * scale.max(0), self.limit**2)
        row, query = np.nonzero((rough <= bound) & mask)
        if not len(row):
            return
        gap = y[row] - x[query]
        far = np.sqrt(np.einsum("nd,nd->n", gap, gap))
        n = np.array([len(ids[i]) for i in row])
        own = pd.DataFrame({"query": np.repeat(query, n), "vec_id": np.concatenate([ids[i] for i in row]), "score": np.repeat(far, n)})
        self.rows.append(own[own["vec_id"] != self.visits.ids[own["query"]]])
        if sum(map(len, self.rows)) > 8 * k * len(x):
            self.settle()

    def settle(self) -> pd.DataFrame:
        """Keep the k nearest; of equal distances the smaller ids."""
        rows = pd.concat(self.rows) if self.rows else pd.DataFrame({"query": [], "vec_id": [], "score": []})
        rows = rows.drop_duplicates(["query", "vec_id", "score"]).sort_values(["query", "score", "vec_id"])
        rows = rows[rows.groupby("query").cumcount() < self.k]
        last = rows.groupby("query")["score"].agg(["size", "max"])
        full = last[last["size"] >= self.k]
        self.limit[full.index.to_numpy(int)] = full["max"] * (1 + 1e-9) + 1e-12
        self.rows = [rows]
        return rows


def scanned(vectors: DataFrame, visits: Visits, k: int) -> DataFrame:
    """FOUND rows: each task's k nearest of each query among what it visits of vectors (vector, ids, codes)."""
    shared = vectors.sparkSession.sparkContext.broadcast(visits)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held, size = Best(shared.value, k), [], 0

        def compare() -> None:
            rows = pa.Table.from_batches(held)
            codes = np.array(rows.column("codes").to_pylist(), np.int64).reshape(-1, TABLES)
            best.add(_matrix(rows.column("vector").to_pylist()), [np.array(i, np.int64) for i in rows.column("ids").to_pylist()], codes)

        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= BATCH:
                compare()
                held, size = [], 0
        if held:
            compare()
        rows = best.settle()
        ids = shared.value.ids[rows["query"].to_numpy(int)] if len(rows) else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows["vec_id"].to_numpy(np.int64)), pa.array(rows["score"].to_numpy(float))], ["query_id", "vec_id", "score"])

    return vectors.select("vector", "ids", "codes").mapInArrow(run, FOUND)


def in_blocks(queries: DataFrame, vectors: DataFrame, k: int, probes: DataFrame | None = None) -> DataFrame:
    """The k nearest found to each query (q, query_id, vector), block after block, each one pass over vectors.

    probes (q, t, code) has the visits; without it every vector is compared.
    """
    n = queries.count()
    found = queries.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    for block in range(ceil(n / BLOCK)):
        own = queries.where(F.pmod(F.xxhash64("q"), F.lit(ceil(n / BLOCK))) == block).orderBy("q").toPandas()  # some BLOCK rows
        if not len(own):
            continue
        tables = None
        if probes is not None:
            asked = probes.where(F.pmod(F.xxhash64("q"), F.lit(ceil(n / BLOCK))) == block).select("q", "t", "code").toPandas()
            asked["at"] = np.searchsorted(own["q"].to_numpy(), asked["q"].to_numpy())
            asked = asked.sort_values("code", kind="stable")
            tables = [(part["code"].to_numpy(), part["at"].to_numpy()) for part in (asked[asked["t"] == t] for t in range(TABLES))]
        visits = Visits(own["query_id"].to_numpy(), _matrix(own["vector"]), tables)
        found = found.unionByName(written(ranked(scanned(vectors, visits, k), k), "ann-block"))
    return found


def ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    found = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found to each row where is_query holds, itself left out.

    rows: vec_id and embedding. Vectors that are not usable, of a null id, or of another length than most take no part.
    Ties go to the smaller vec_id; a repeated vec_id counts once, with its smallest distance. Queries with fewer than
    k found, or whose probes hit their limit, are searched exactly, so fewer than k come only where there are fewer.
    """
    spark = rows.sparkSession
    prepare(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    length = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), "n").first()
    if length is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("embedding") == length[0])
    distinct = written(distinct_vectors(rows, k), "ann-vectors")
    n = distinct.count()
    index = fit(distinct, n, k)
    share = 1 - (1 - WANTED) ** (1 / TABLES)

    def in_tables(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = index.codes(np.floor(index.places(_matrix(batch.column("vector").to_pylist()))))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, codes.size + 1, TABLES, dtype=np.int32)), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], [*batch.schema.names, "codes"])

    def probing(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            places, out = index.places(_matrix(batch["vector"])), []
            for i, q in enumerate(batch["q"].tolist()):
                for t in range(TABLES):
                    cells, enough = index.probes(places[i, t], share)
                    out += [(q, t, code, enough) for code in set(index.codes(np.array(cells)).tolist())]
            yield pd.DataFrame(out, columns=["q", "t", "code", "enough"])

    vectors = written(distinct.mapInArrow(in_tables, "vector binary, ids array<long>, codes array<long>"), "ann-tables")
    queries = rows.where(is_query).select(F.col("vec_id").alias("query_id"), "embedding")

    def packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = [(np.array(x, "<f8") + 0.0).tobytes() for x in batch.column("embedding").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), pa.array(flat, pa.binary())], ["query_id", "vector"])

    queries = written(queries.mapInArrow(packed, "query_id long, vector binary").withColumn("q", F.monotonically_increasing_id()), "ann-queries")
    probes = written(queries.select("q", "vector").mapInPandas(probing, "q long, t int, code long, enough boolean"), "ann-probes")
    found = written(in_blocks(queries, vectors, k, probes), "ann-found")
    # n counts distinct vectors; with few of them, equal ones may still make up k.
    short = queries.select("query_id").distinct().join(found.groupBy("query_id").count().where(F.col("count") >= k), "query_id", "left_anti")
    short = short.union(probes.where("not enough").join(queries, "q").select("query_id")).distinct()
    left = written(queries.join(short, "query_id", "left_semi"), "ann-left")
    if left.isEmpty():
        return ranked(found, k)
    return ranked(found.join(left.select("query_id").distinct(), "query_id", "left_anti"), k).unionByName(ranked(in_blocks(left, vectors, k), k))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every hundredth vector of embeddings."""
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, 10)
