"""Retrieval: chunks, word statistics, BM25, exact vector search and rank fusion."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written
from .exact_search import Block
from .term_search import blocks


def fixed_chunks(docs: DataFrame, key: str, size: int = 1000, overlap: int = 200) -> DataFrame:
    """key, chunk (from 0), id and content: windows of size characters, overlap of them shared, over collapsed text.

    Windows are cut before they become rows, so no row carries the whole text.
    """
    text = F.trim(F.regexp_replace("text", r"\s+", " "))
    starts = F.sequence(F.lit(1), F.greatest(F.length("t") - overlap, F.lit(1)), F.lit(size - overlap))
    rows = docs.select(key, text.alias("t")).where("t <> ''")
    rows = rows.select(key, F.posexplode(F.transform(starts, lambda at: F.substring(F.col("t"), at, F.lit(size)))).alias("chunk", "content"))
    return rows.select(key, "chunk", F.concat_ws("_", F.col(key).cast("string"), F.col("chunk").cast("string")).alias("id"), "content")


def sharded_names(docs: DataFrame, key: str, size: int = 10_000) -> DataFrame:
    """key and shard: the name of the file of size documents each, in order of key, digits padded to six.

    Places come from counts of key ranges, so no task numbers more than its own range.
    """
    ranged = written(docs.select(key).repartitionByRange(key).withColumn("part", F.spark_partition_id()), "shard-keys")
    counts = ranged.groupBy("part").agg(F.count("*").alias("n"))
    base = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(Window.partitionBy("part").orderBy(key)) - 1
    rows = ranged.withColumn("place", place).join(F.broadcast(counts.select("part", base.alias("base"))), "part")  # one row a task
    return rows.select(key, F.lpad(F.floor((F.col("base") + F.col("place")) / size).cast("string"), 6, "0").alias("shard"))


#: Queries of one block of an exact search.
BLOCK = 4096


def bm25(docs: DataFrame, queries: DataFrame, key: str, query_key: str, k: int, k1: float = 0.9, b: float = 0.4) -> DataFrame:
    """query_key, key, score and rank of the k best documents of each query (query_key, text)."""
    return first_ranked([x.bm25(k, k1, b) for x in blocks(docs, queries, key, query_key)], docs, queries, key, query_key, k)


def bm25_and_counts(docs: DataFrame, queries: DataFrame, key: str, query_key: str, k: int, k1: float = 0.9, b: float = 0.4) -> list[DataFrame]:
    """As bm25, and the same with the occurrences of a query's terms as score, from one pass over the texts."""
    found = blocks(docs, queries, key, query_key)
    return [first_ranked(lists, docs, queries, key, query_key, k) for lists in ([x.bm25(k, k1, b) for x in found], [x.counts(k) for x in found])]


def first_ranked(lists: list[DataFrame], docs: DataFrame, queries: DataFrame, key: str, query_key: str, k: int) -> DataFrame:
    """query_key, key, score and rank of the k highest scores of a query, of lists with query_key, key and score."""
    rows = queries.limit(0).select(query_key, F.lit(None).cast(docs.schema[key].dataType).alias(key), F.lit(0.0).alias("score"))
    for own in lists:
        rows = rows.unionByName(own)
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), F.asc_nulls_last(key)))
    return rows.withColumn("score", F.round("score", 6)).withColumn("rank", rank).where(F.col("rank") <= k)


def similarity(a: Column, b: Column) -> Column:
    """Inner product of two lists, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0).cast("double"), lambda s, x: s + x)


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two lists, in double precision."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.aggregate(d, F.lit(0.0).cast("double"), lambda s, x: s + x * x))


def normalised(a: Column) -> Column:
    """A list by its Euclidean length; one of zeros stays."""
    size = F.sqrt(similarity(a, a))
    return F.when(size > 0, F.transform(a, lambda x: x.cast("double") / size)).otherwise(F.transform(a, lambda x: x.cast("double")))


def nearest(vectors: DataFrame, queries: DataFrame, key: str, query_key: str, column: str, k: int, metric: str = "inner", unit: bool = False) -> DataFrame:
    """query_key, key, score and rank of each query's k best vectors but the one of its own key, by exact search.

    metric: inner (largest inner product first) or l2 (smallest distance first); unit: queries are normalised first.
    Queries come in blocks of BLOCK, which every vector meets as a matrix; each task keeps what may be among the k best of
    a query. Lists that are null, hold nulls or differ in length have a null score, which comes last.
    """
    if metric not in ("inner", "l2"):
        raise ValueError(f"no such metric: {metric}")
    own = normalised(F.col(column)) if unit else F.col(column)
    n_blocks = max(1, -(-queries.count() // BLOCK))
    asked = written(queries.where(F.col(query_key).isNotNull()).select(F.col(query_key), own.alias("v"), F.pmod(F.xxhash64(query_key), F.lit(n_blocks)).alias("block")), "asked")
    others = vectors.where(F.col(key).isNotNull()).select(key, F.col(column).alias("v"))
    kinds = dict(vectors.dtypes)[key], dict(queries.dtypes)[query_key]
    out = None
    for block in range(n_blocks):
        one = asked.where(F.col("block") == block).select(query_key, "v").toArrow().combine_chunks()  # BLOCK rows
        if not one.num_rows:
            continue
        rows = others.mapInArrow(_searcher(one, k, metric, key, query_key), f"`{query_key}` {kinds[1]}, `{key}` {kinds[0]}, score double")
        rows = rows if n_blocks == 1 else written(rows, "nearest")
        out = rows if out is None else out.unionByName(rows)
    if out is None:
        return vectors.limit(0).select(F.col(key).alias(query_key), key, F.lit(0.0).alias("score"), F.lit(0).alias("rank"))
    order = F.desc_nulls_last("score") if metric == "inner" else F.asc_nulls_last("score")
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(order, key))
    return out.withColumn("score", F.round("score", 6)).withColumn("rank", rank).where(F.col("rank") <= k)


def _searcher(asked: pa.Table, k: int, metric: str, key: str, query_key: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """What a task does with its vectors and one block of queries."""
    keys, lists = (x.combine_chunks() for x in asked.columns)
    block, kind = Block(keys.to_numpy(zero_copy_only=False), lists, k, metric), keys.type

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for query, found, score in block.search(batches):
            yield pa.RecordBatch.from_arrays([pa.array(query, kind), pa.array(found), score], [query_key, key, "score"])

    return run


def over_fetched(k: int) -> int:
    """How many of each list are fetched to fuse k."""
    return max(2 * k, 100)


def context(passages: DataFrame, group: str, order: str, title: Column, content: Column, budget: int, tokens: Column | None = None) -> DataFrame:
    """group and context: `Document [i] (Title: t) c` lines in order, as many characters as budget tokens have.

    tokens: how many a passage has (words where not given). Whole passages are kept while they fit; the first that
    doesn't is cut at a word, the others go.
    """
    n = F.size(F.split(F.trim(content), r"\s+")) if tokens is None else tokens
    rows = passages.select(group, order, title.alias("title"), content.alias("content"), n.cast("long").alias("n"))
    rows = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, "title", "content", "n"))).alias("p"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<string>").alias("out"))

    def step(s, p):
        left = F.lit(budget) - s["used"]
        words = F.split(F.trim(p["content"]), r"\s+")
        text = F.when(p["n"] <= left, p["content"]).otherwise(F.array_join(F.slice(words, 1, F.greatest(left, F.lit(0)).cast("int")), " "))
        line = F.concat(F.lit("Document ["), F.size(s["out"]).cast("string"), F.lit("] (Title: "), p["title"], F.lit(") "), text)
        return F.struct((s["used"] + p["n"]).alias("used"), F.when(left > 0, F.array_append(s["out"], line)).otherwise(s["out"]).alias("out"))

    return rows.select(group, F.array_join(F.aggregate("p", start, step)["out"], "\n").alias("context"))


def looked_up(ids: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """ids with the columns of texts for their key; ids without one stay, with nulls. An empty list of ids gives none."""
    return ids.join(texts, key, "left")


def fused(lists: list[DataFrame], query_key: str, key: str, k: int, constant: int = 100) -> DataFrame:
    """Reciprocal rank fusion of lists with query_key, key and rank: the sum of 1 / (constant + rank)."""
    rows = lists[0].select(query_key, key, "rank")
    for other in lists[1:]:
        rows = rows.unionByName(other.select(query_key, key, "rank"))
    scores = rows.groupBy(query_key, key).agg(F.round(F.sum(1.0 / (constant + F.col("rank"))), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy(query_key).orderBy(F.desc("score"), key))
    return scores.withColumn("rank", rank).where(F.col("rank") <= k)
