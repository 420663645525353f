"""Mixing sources to target weights by pivotal dependent rounding of copy counts.

Each document of a source starts with the same expected number of copies, target over size of its source. The whole
part is certain; the fractions are rounded in duels of two documents: a duel moves mass, counted in words, from one
fraction to the other until one is 0 or 1, and the direction is random with the odds that leave both expectations as
they were. Large documents go first, each in one series of duels with all smaller ones of its block, whose direction is drawn
once; so small ones are left for the end. The words of a source are kept exactly until one open fraction is left, so what
it takes is within one document of its target: a small one, unless a document is larger than the rest of its source can
make good. Duels run in blocks of some thousand documents, then among the blocks' open ends, and so on up a tree.
"""

from __future__ import annotations

import struct
from collections.abc import Sequence

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh, table, written

#: Documents of a block, and open ends that meet in one task of the tree above.
BLOCK, FAN_IN = 4096, 1024
EDGE = 1e-12


def targets_of(sizes: Sequence[int], weights: Sequence[float], cap: float) -> list[float]:
    """Shares of the sum of sizes by weight; no share above cap times its own size, the excess reshared by weight."""
    total, shares, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        per = left / sum(weights[i] for i in open_)
        full = {i for i in open_ if per * weights[i] > cap * sizes[i]}
        if not full:
            for i in open_:
                shares[i] = per * weights[i]
            break
        for i in full:
            shares[i] = float(cap * sizes[i])
        open_ -= full
        left = total - sum(shares[i] for i in range(len(sizes)) if i not in open_)
    return shares


def _chance(seed: int, a: int, b: int) -> float:
    return xxhash.xxh3_64_intdigest(struct.pack("<qqq", seed, a, b)) / 2.0**64


def _moved(f: float, w: float, g: float, v: float, chance: float) -> tuple[float, float]:
    """Fractions f and g of w and v words after one duel: one of them is 0 or 1, and f * w + g * v is as before."""
    up, down = min((1 - f) * w, g * v), min(f * w, (1 - g) * v)
    move = up if chance * (up + down) < down else -down
    return tuple(float(round(x)) if x < EDGE or x > 1 - EDGE else x for x in (f + move / w, g - move / v))


def open_(f: float) -> bool:
    return EDGE < f < 1 - EDGE


def _against_smaller(f: np.ndarray, w: np.ndarray, chances: np.ndarray) -> None:
    """Round documents, largest first, each by a series of duels with all open smaller ones, whose direction is drawn once.

    Up has the chance f. A smaller one gives (1 - f) of its stake in up, or gets f of it in down, so its expectation
    stays; a stake is what neither breaks, and all are scaled to the words of the large one. One whose smaller ones
    haven't stakes enough stays open.
    """
    for i in range(len(f) - 1):
        own = f[i]
        if not open_(own):
            continue
        g, v = f[i + 1 :], w[i + 1 :]
        stakes = np.where((g > EDGE) & (g < 1 - EDGE), np.minimum(g * v / (1 - own), (1 - g) * v / own), 0.0)
        total = stakes.sum()
        if total < w[i]:
            continue
        stakes *= w[i] / total
        up = chances[i] < own
        g += (-(1 - own) * stakes if up else own * stakes) / v
        g[g < EDGE], g[g > 1 - EDGE] = 0.0, 1.0
        f[i] = float(up)


def duels(keys: Sequence[int], words: Sequence[int], fractions: Sequence[float], seed: int) -> list[float]:
    """Round open fractions; at most one is left open, the smallest unless larger ones found no stakes enough.

    Large documents go first, each against the smaller ones together; what is open then is rounded pair by pair, the largest
    first, and what a duel leaves open meets the next document. Documents without words give and take nothing; their
    fractions are 0.
    """
    found, at = [f if w else 0.0 for f, w in zip(fractions, words)], None
    order = sorted((i for i, f in enumerate(found) if open_(f)), key=lambda i: (-words[i], keys[i]))
    f = np.array([found[i] for i in order])
    _against_smaller(f, np.array([words[i] for i in order], float), np.array([_chance(seed, keys[i], -1) for i in order]))
    for i, x in zip(order, f.tolist()):
        found[i] = x
    for i in (i for i in order if open_(found[i])):
        if at is not None:
            found[i], found[at] = _moved(found[i], words[i], found[at], words[at], _chance(seed, keys[i], keys[at]))
        at = i if open_(found[i]) else at if at is not None and open_(found[at]) else None
    return found


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, a key of the row's content and the number of words of each whole text (null: 0)."""
    return docs.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("key"), F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"))


def mixed(docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3, seed: int = 5) -> DataFrame:
    """doc_id, source, key, size, source_size, target and copies of each row of docs.

    Sources by code point, null last, take the weights in turn. A document gets the whole part of its expected copies
    or one more, so at most cap copies. Rows without words get the whole part. Repeated rows are rows of their own.
    Copies of one row are dealt to blocks of their own number, so a row may be repeated any number of times. The
    outcome hangs on the rows alone, not on partitions: reruns agree. No rows give no rows.
    """
    spark = docs.sparkSession
    rows = written(sized(docs), "mix-sizes")
    # One row per source is gathered here: sources are names of collections, not documents.
    sums = sorted(rows.groupBy("source").agg(F.sum("size").alias("n")).collect(), key=lambda r: (r[0] is None, (r[0] or "").encode()))
    shares = targets_of([r[1] for r in sums], [weights[i % len(weights)] for i in range(len(sums))], cap)
    plan = spark.createDataFrame([(i, r[0], r[1], t) for i, (r, t) in enumerate(zip(sums, shares))], "s int, source string, source_size long, target double")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rows = rows.join(F.broadcast(plan), rows.source.eqNullSafe(plan.source)).select("doc_id", rows.source, "key", "size", "source_size", "target", "s", rate.alias("rate"))
    n_blocks = max(1, -(-rows.count() // BLOCK))
    rows = rows.withColumn("whole", F.floor("rate")).withColumn("f", F.col("rate") - F.floor("rate"))
    # Alike rows are counted, numbered in chunks of BLOCK, and each chunk has its own key and node.
    alike = rows.groupBy(*rows.columns).agg(F.count("*").alias("m"))
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("m") - 1) / BLOCK).cast("long"))).alias("chunk")
    alike = alike.select("*", chunk).withColumn("name", F.when(F.col("chunk") == 0, F.col("key")).otherwise(F.xxhash64("key", "chunk")))
    own = F.least(F.lit(BLOCK), F.col("m") - F.col("chunk") * BLOCK).cast("int")
    rows = alike.select(*rows.columns, "name", F.pmod("name", F.lit(n_blocks)).alias("node"), F.explode(F.sequence(F.lit(1), own)).alias("twin"))

    def round_node(_: tuple, own: pd.DataFrame) -> pd.DataFrame:
        keys = [xxhash.xxh3_64_intdigest(struct.pack("<qq", *x)) >> 1 for x in zip(own["name"].tolist(), own["twin"].tolist())]
        own["f"] = duels(keys, own["size"].tolist(), own["f"].tolist(), seed)
        return own

    still = (F.col("f") > EDGE) & (F.col("f") < 1 - EDGE)
    level, nodes = written(rows.groupBy("s", "node").applyInPandas(round_node, _schema(rows)), "mix-blocks"), n_blocks
    done, ends = level.where(~still), level.where(still)
    while nodes > 1:
        nodes = -(-nodes // FAN_IN)
        ends = ends.withColumn("node", F.col("node") % F.lit(nodes))
        level = written(ends.groupBy("s", "node").applyInPandas(round_node, _schema(ends)), "mix-ends")
        done, ends = done.unionByName(level.where(~still)), level.where(still)

    last = ends.withColumn("f", F.when(_uniform(seed) < F.col("f"), 1.0).otherwise(0.0))
    done = done.unionByName(last)
    return done.select("doc_id", "source", "key", "size", "source_size", "target", (F.col("whole") + F.round("f")).cast("long").alias("copies"))


def _uniform(seed: int) -> F.Column:
    return F.pmod(F.xxhash64("name", "twin", F.lit(seed + 1)), F.lit(1 << 52)) / float(1 << 52)


def _schema(df: DataFrame) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in df.dtypes)


def mix_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the same columns.

    Rows of equal doc_id, source and text share out their counts in any order. Null ids, sources and texts are values
    like others; no rows give no rows.
    """
    key, low, more, m, place, n, copy = fresh(docs, "mix_key", "mix_low", "mix_more", "mix_rows", "mix_place", "mix_n", "mix_copy")
    plan = mixed(docs).groupBy("key").agg(F.min("copies").alias(low), (F.sum("copies") - F.min("copies") * F.count("*")).alias(more), F.count("*").alias(m)).withColumnRenamed("key", key)
    plan = written(plan, "mix-plan")
    rows = docs.withColumn(key, F.xxhash64("doc_id", "source", "text")).join(plan, key)
    taken = rows.where(F.col(m) == 1).withColumn(n, F.col(low) + F.col(more))
    if not plan.where(F.col(m) > 1).isEmpty():
        # Twins are numbered task by task, each task after the counts of those before.
        twins = written(rows.where(F.col(m) > 1).withColumn(place, F.spark_partition_id()), "mix-twins")
        before = F.sum(n).over(Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
        counts = twins.groupBy(key, place).agg(F.count("*").alias(n)).select(key, place, F.coalesce(before, F.lit(0)).alias(copy))
        number = F.row_number().over(Window.partitionBy(key, place).orderBy(F.lit(0))) + F.col(copy)
        twins = twins.join(counts, [key, place]).withColumn(n, F.col(low) + (number <= F.col(more)).cast("long"))
        taken = taken.unionByName(twins.select(*taken.columns))
    taken = taken.where(F.col(n) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n).cast("int")))).select(*docs.columns)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each row of documents."""
    rows = mixed(table(spark, sf_dir, "documents"))
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))
