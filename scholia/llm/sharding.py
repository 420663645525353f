"""Sharding by vector bin packing: bytes, tokens and rows balanced jointly.

Equal texts form a group, and a group lies whole in one shard unless its bytes, tokens or rows are more than a shard's
even share; then its rows are cut by a hash of doc_id into slices (SLICES to a shard). Every group goes where the dot
product of its vector with the free capacity is highest, the largest first. Groups of more than a slice are few (three
to a slice at most) and are packed together first; single moves then level what whole groups left uneven. All others
are packed in parts of some thousand groups, each part against its own share of the capacity that the large ones left.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

#: Slices to a shard; small groups of a part; weights of bytes, tokens and rows in the dot product.
SLICES, PART = 64, 20_000
WEIGHTS = (8.0, 1.0, 1.0)
#: Rows of a shard that are numbered in one task.
NUMBERED = 50_000


def pack(share: np.ndarray, free: np.ndarray, weights: tuple[float, ...] = WEIGHTS) -> tuple[np.ndarray, np.ndarray]:
    """A shard for each row of share: largest first, to the highest dot product with the free capacity; and what is free then."""
    free, place = free.copy(), np.zeros(len(share), np.int64)
    scale = np.array(weights)
    for i in np.lexsort((np.arange(len(share)), -share.max(1) - 1e-3 * share.sum(1))) if len(share) else []:
        place[i] = int(np.argmax(free @ (scale * share[i])))
        free[place[i]] -= share[i]
    return levelled(share, free, place, scale), free


def levelled(share: np.ndarray, free: np.ndarray, place: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """The places after moves from the fullest shard to the emptiest one in bytes, while the weighted squares of free fall."""
    for _ in range(len(share)):
        a, b = int(np.argmin(free[:, 0])), int(np.argmax(free[:, 0]))
        own = np.flatnonzero(place == a)
        gain = 2 * ((share[own] ** 2 + share[own] * (free[a] - free[b])) @ scale)
        if not len(own) or gain.min() >= -1e-9:
            break
        i = own[int(np.argmin(gain))]
        place[i] = b
        free[a] += share[i]
        free[b] -= share[i]
    return place


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each row of docs (null text: empty).

    size is the text's UTF-8 bytes and 16; tokens are words between white space. Slots of a shard run from 0 without
    gaps, by hash bucket and doc_id. Repeated rows are rows of their own, of one group; null ids are ids like others.
    No rows give no rows.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id",
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("tokens"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("g"),
        F.hash(F.reverse(text)).alias("g2"),
    )
    rows = written(rows, "shard-sizes")
    total = rows.agg(F.sum("size"), F.sum("tokens"), F.count("*")).first()
    if not total[2]:
        return rows.select("doc_id", "size", "text_crc32", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot"))
    quanta = [max(1.0, n / (shards * SLICES)) for n in total]
    groups = written(rows.groupBy("g", "g2").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")), "shard-groups")
    most = F.greatest(F.col("b") / quanta[0], F.col("t") / quanta[1], F.col("r") / quanta[2])
    slices = F.when(most > SLICES, F.ceil(most)).otherwise(1).cast("int")  # cut only beyond a whole shard
    # A large group holds over one quantum of something, so there are fewer than 3 * shards * SLICES of them.
    large = groups.where(most > 1).select("g", "g2", slices.alias("slices"))
    own = F.xxhash64("doc_id", "text_crc32")
    big = rows.join(F.broadcast(large), ["g", "g2"]).withColumn("slice", F.pmod(own, F.col("slices")).cast("int"))
    things = big.groupBy("g", "g2", "slice").agg(F.sum("size").alias("b"), F.sum("tokens").alias("t"), F.count("*").alias("r")).orderBy("g", "g2", "slice").collect()
    whole = np.maximum(np.array(total, float), 1) / shards
    place, free = pack(np.array([[x.b, x.t, x.r] for x in things], float).reshape(-1, 3) / whole, np.ones((shards, 3)))
    map_ = spark.createDataFrame([(x.g, x.g2, x["slice"], int(p)) for x, p in zip(things, place)], "g long, g2 int, slice int, shard int")
    columns = ["doc_id", "size", "text_crc32", "shard"]
    placed = big.join(F.broadcast(map_), ["g", "g2", "slice"]).select(*columns)

    small = groups.where(most <= 1)
    n, *sums = small.agg(F.count("*"), F.sum("b"), F.sum("t"), F.sum("r")).first()
    sums = np.maximum(np.array([x or 0 for x in sums], float), 1)

    def pack_part(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["g", "g2"])
        vectors = own[["b", "t", "r"]].to_numpy(float)
        found, _ = pack(vectors / whole, np.maximum(free, 0) * (vectors.sum(0) / sums))
        return own[["g", "g2"]].assign(shard=found.astype(np.int32))

    part = F.pmod(F.xxhash64("g", "g2"), F.lit(max(1, -(-n // PART)))).alias("part")
    small = written(small.select("g", "g2", "b", "t", "r", part).groupBy("part").applyInPandas(pack_part, "g long, g2 int, shard int"), "shard-small")
    placed = placed.unionByName(rows.join(small, ["g", "g2"]).select(*columns))
    buckets = max(1, -(-total[2] // (shards * NUMBERED)))
    return numbered(placed.withColumn("bucket", F.pmod(own, F.lit(buckets))))


def numbered(rows: DataFrame) -> DataFrame:
    """Slots from the rows' places in their bucket and the rows of earlier buckets of the shard."""
    counts = rows.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    place = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")) - 1
    rows = rows.withColumn("place", place).join(counts, ["shard", "bucket"])
    return rows.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("place")).alias("slot"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards of nearly equal bytes."""
    rows = sharded(table(spark, sf_dir, "documents"), 40)
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
