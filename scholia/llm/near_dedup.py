"""MinHash near-duplicates with an LSH forest.

A document's set is hashed to a signature; documents of equal sets are one class. Each tree takes the signature rotated
to its own start and orders the classes by it: a hash of the first DEPTH values deals the order's stretches, the
regions, to tasks, and a task sorts its own. There, neighbours in the order are compared first, those with the longest
common prefixes before others. What is then left in several components is compared over a prefix index of the region's
sets (two sets that are alike enough share one of their rarest members), so that no pair of a region is left out.

The depth is each region's own: one with too many or too large sets is split by twice as many values, and so on, and the parts'
first classes form a region of their own, which connects most of it; what its largest component then lacks is compared
with all of the region, block against block. Trees come in rounds, and a region whose classes are connected by earlier
rounds needs no work, so full sets are moved only where something may be new, and a region gives at most as many links
as it has classes. Pairs that met in an earlier tree aren't compared again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, prepare, table, texts, written
from .graph import components
from .wordcache import Bounded

WORDS, SIMILAR = 5, (75, 100)
#: Trees of each round; depth of a region; values of a signature. A pair at similarity 0.75 shares no region of any
#: tree with probability (1 - 0.75 ** 3) ** 24 = 2e-6.
ROUNDS, DEPTH = (3, 9, 12), 3
VALUES = sum(ROUNDS) * DEPTH
#: Classes, and shingles of all of them together, of a region that one task takes.
MOST, MOST_SHINGLES = 4000, 6_000_000
#: Ids whose texts are read again that are broadcast at most (8 bytes each).
BROADCAST_IDS = 2_000_000

_rng = np.random.default_rng(9)
_odd = _rng.integers(0, 1 << 63, VALUES, np.uint64) * np.uint64(2) + np.uint64(1)
_xor = _rng.integers(0, 1 << 63, VALUES, np.uint64)


class _WordHashes(Bounded):
    bound, stay = 300_000, 150_000

    def __missing__(self, word: bytes) -> int:
        self[word] = found = xxhash.xxh3_64_intdigest(word)
        return found


_hashes = _WordHashes()


def shingles(text: str) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; the whole sequence is one where there are fewer words."""
    words = text.encode().lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    _hashes.room()
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = len(h) - WORDS + 1
    if n < 1:
        return np.array([xxhash.xxh3_64_intdigest(h.tobytes())], np.uint64) if len(h) else h
    out = h[:n].copy()
    for i in range(1, WORDS):
        out = (out ^ (out >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return np.unique(out)


def signature(own: np.ndarray) -> np.ndarray:
    low = np.full(VALUES, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(own), 512):
        part = own[i : i + 512, None] ^ _xor
        part *= _odd
        low = np.minimum(low, part.min(0))
    return (low >> np.uint64(32)).astype("<u4")


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, set_key (null: empty set) and sig of every whole text, in one map."""
    prepare(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x) for x in batch.column("text").to_pylist()]
            keys = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            sigs = [signature(s).tobytes() if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(map(len, sets), pa.int64()), pa.array(keys, pa.binary()), pa.array(sigs, pa.binary())], ["doc_id", "n_shingles", "set_key", "sig"])

    return texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, sig binary")


def prefixes(classes: DataFrame, trees: range, depth: int) -> DataFrame:
    """rep, n_shingles, tree and region: a hash of the tree's first depth values."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), "<u4").reshape(-1, VALUES).astype(np.uint64)
            for tree in trees:
                key = np.full(len(sigs), tree + 1, np.uint64)
                for d in range(depth):
                    key = (key ^ sigs[:, (tree * DEPTH + d) % VALUES]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(31)
                yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("n_shingles"), pa.array(np.full(len(key), tree, np.int32)), pa.array(key.view(np.int64))], ["rep", "n_shingles", "tree", "region"])

    return classes.select("rep", "n_shingles", "sig").mapInArrow(run, "rep long, n_shingles long, tree int, region long")


def regions(classes: DataFrame, trees: range) -> tuple[DataFrame, DataFrame | None]:
    """tree, region and rep of every region that has several classes, dense ones split by further values; and what is dense.

    The second (tree, region, rep, n_shingles) has the dense regions before any split, or is None.
    """
    out, whole, depth, rows = None, None, DEPTH, written(prefixes(classes, trees, DEPTH), "forest")
    while True:
        sizes = rows.groupBy("region").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).where("n > 1")
        sizes = sizes.withColumn("dense", (F.col("n") > MOST) | (F.col("s") > MOST_SHINGLES) & (F.col("n") > 2))
        sizes = written(sizes.select("region", "dense"), "forest-sizes")
        fit_ = rows.join(sizes.where("not dense").select("region"), "region").select("tree", "region", "rep")
        out = fit_ if out is None else out.union(fit_)
        if sizes.where("dense").isEmpty():
            return out, whole
        if whole is None:
            whole = rows.join(sizes.where("dense").select("region"), "region").select("tree", "region", "rep", "n_shingles")
        dense = rows.join(sizes.where("dense").select("region"), "region").select("rep", "n_shingles", "tree", F.col("region").alias("top"))
        split, depth = depth < VALUES, min(max(2 * depth, 1), VALUES) if depth < VALUES else depth + 1
        if split:
            deeper = prefixes(classes.join(dense.select("rep").distinct(), "rep", "left_semi"), trees, depth).select("rep", "tree", F.col("region").alias("deep"))
            rows = dense.join(deeper, ["rep", "tree"])
        else:  # equal signatures: any parts will do
            rows = dense.withColumn("deep", F.pmod(F.xxhash64("rep", F.lit(depth)), F.lit(16)))
        rows = written(rows.select("rep", "n_shingles", "tree", "top", F.xxhash64("top", "deep").alias("region")), "forest-deeper")
        heads = rows.groupBy("tree", "top", "region").agg(F.min_by(F.struct("rep", "n_shingles"), "rep").alias("h")).select("tree", "top", "h.*")
        heads = heads.join(heads.groupBy("top").agg(_blocks(MOST, MOST_SHINGLES).alias("blocks")), "top")
        out = out.union(heads.select("tree", F.xxhash64("top", F.lit(depth), _block("blocks")).alias("region"), "rep"))
        rows = rows.drop("top")


def _blocks(most: int, most_shingles: int) -> Column:
    return F.ceil(F.greatest(F.count("*") / F.lit(max(1, most)), F.sum("n_shingles") / F.lit(max(1, most_shingles)))).cast("int")


def _block(blocks: str) -> Column:
    return F.pmod(F.xxhash64("rep"), F.greatest(F.col(blocks), F.lit(1))).cast("int")


def blocks(whole: DataFrame, labels: DataFrame) -> DataFrame:
    """tree, region, i, j, rep, component and asked: pairs of blocks that hold every pair yet unconnected of dense regions.

    Block i is of the classes outside the region's largest component (asked), block j of all its classes; so every
    pair of classes of different components is in some (i, j), with one of the two asked.
    """
    rows = whole.join(labels, whole.rep == labels.node, "left").select("tree", "region", "rep", "n_shingles", F.coalesce("component", "rep").alias("component"))
    parts = rows.groupBy("region", "component").agg(F.count("*").alias("n"))
    main = parts.groupBy("region").agg(F.max_by("component", F.struct("n", -F.col("component"))).alias("main"), F.count("*").alias("parts")).where("parts > 1")
    rows = written(rows.join(main.select("region", "main"), "region"), "dense")
    rest = rows.where("component <> main")
    # Half a region's bounds for each of the two.
    counts = rows.groupBy("region").agg(_blocks(MOST // 2, MOST_SHINGLES // 2).alias("js")).join(rest.groupBy("region").agg(_blocks(MOST // 2, MOST_SHINGLES // 2).alias("is")), "region")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1))
    own = ["tree", "region", "rep", "component"]
    a = rest.join(counts, "region").select(*own, _block("is").alias("i"), every("js").alias("j"), F.lit(True).alias("asked"))
    b = rows.join(counts, "region").select(*own, every("is").alias("i"), _block("js").alias("j"), F.lit(False).alias("asked"))
    return a.union(b).groupBy("tree", "region", "i", "j", "rep", "component").agg(F.max("asked").alias("asked"))


def _sets_by_key(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """As _sets, where an id has several texts: reps has rep and set_key, and each set is taken from a text of that key."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in own], pa.binary()), pa.array([x.tobytes() for x in own], pa.binary())], ["set_key", "set"])

    # A key's sets are equal; one for each is kept by an aggregate, before and after the exchange.
    found = texts(docs).mapInArrow(run, "set_key binary, set binary").join(reps, "set_key").select("rep", "set")
    return found.groupBy("rep").agg(F.any_value("set").alias("set"))


def _sets(docs: DataFrame, reps: DataFrame) -> DataFrame:
    """rep and its set (sorted little-endian 64-bit hashes), from the texts of reps only."""
    reps = F.broadcast(reps) if reps.count() <= BROADCAST_IDS else reps

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingles(x).tobytes() for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(own, pa.binary())], ["rep", "set"])

    return texts(docs).join(reps.withColumnRenamed("rep", "doc_id"), "doc_id", "left_semi").mapInArrow(run, "rep long, set binary")


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    if 100 * min(len(a), len(b)) < SIMILAR[0] * max(len(a), len(b)):
        return False
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    common = int((b[at] == a).sum())
    return 100 * common >= SIMILAR[0] * (len(a) + len(b) - common)


def rarest(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Postings of an index of each set's rarest members, as many as it can lack of a set it is linked to, and one more.

    Owners in the order of members; each member's first place (and the end); and each set's own members.
    """
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, member, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.lexsort((member, counts[member], owner))
    place = np.arange(len(order)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    most = sizes - -(-SIMILAR[0] * sizes // SIMILAR[1]) + 1
    order = order[(place < most[owner]) & (counts[member[order]] > 1)]  # owner is sorted: order keeps its owners
    own = np.split(member[order], np.searchsorted(owner[order], np.arange(1, len(sets))))
    by_member = np.argsort(member[order], kind="stable")
    starts = np.searchsorted(member[order][by_member], np.arange(len(counts) + 1))
    return owner[order][by_member], starts, own


def met(sigs: np.ndarray, own: np.ndarray, tree: int) -> np.ndarray:
    """Which signatures share a region of an earlier tree with own."""
    return (sigs[:, : tree * DEPTH] == own[: tree * DEPTH]).reshape(len(sigs), tree, DEPTH).all(2).any(1)


def completed(sets: list[np.ndarray], sigs: np.ndarray, labels: np.ndarray, asked: np.ndarray, tree: int) -> list[tuple[int, int]]:
    """Links that connect asked sets with any, where labels differ and no earlier tree had both; labels are joined.

    All pairs that the index doesn't rule out are compared, so no link is missed between what stays apart.
    """
    found: list[tuple[int, int]] = []
    if not len(asked) or (labels == labels[0]).all():
        return found
    owners, starts, own = rarest(sets)
    for i in asked.tolist():
        lists = [owners[starts[k] : starts[k + 1]] for k in own[i].tolist()]
        near = np.unique(np.concatenate(lists)) if lists else np.zeros(0, np.int64)
        near = near[labels[near] != labels[i]]
        if len(near):
            near = near[~met(sigs[near], sigs[i], tree)]
        for j in near.tolist():
            if labels[j] != labels[i] and similar(sets[i], sets[j]):
                found.append((i, j))
                labels[labels == labels[j]] = labels[i]
        if (labels == labels[0]).all():
            break
    return found


def linked(own: pd.DataFrame) -> list[tuple[int, int]]:
    """Links that connect what one region's classes (tree, rep, component, sig, set) can be connected by."""
    reps, labels, tree = own["rep"].to_numpy(), own["component"].to_numpy().copy(), int(own["tree"].iloc[0])
    if (labels == labels[0]).all():
        return []
    sigs = np.frombuffer(b"".join(own["sig"]), "<u4").reshape(-1, VALUES)
    sets = [np.frombuffer(x, "<u8") for x in own["set"]]
    rotated = np.roll(sigs, -tree * DEPTH, 1)
    raw = rotated.astype(">u4")
    order = sorted(range(len(own)), key=lambda i: (raw[i].tobytes(), reps[i]))
    differ = rotated[order[1:]] != rotated[order[:-1]]
    common = np.where(differ.any(1), differ.argmax(1), VALUES)
    found = []
    for k in np.argsort(-common, kind="stable").tolist():
        i, j = order[k], order[k + 1]
        if labels[i] != labels[j] and similar(sets[i], sets[j]):
            found.append((i, j))
            labels[labels == labels[j]] = labels[i]
    if len(own) > 2:
        values, counts = np.unique(labels, return_counts=True)
        found += completed(sets, sigs, labels, np.flatnonzero(labels != values[np.argmax(counts)]), tree)
    return [(int(reps[i]), int(reps[j])) for i, j in found]


def linked_blocks(own: pd.DataFrame) -> list[tuple[int, int]]:
    """As linked, of a pair of blocks: what is asked against all."""
    reps, labels = own["rep"].to_numpy(), own["component"].to_numpy().copy()
    sigs, sets = np.frombuffer(b"".join(own["sig"]), "<u4").reshape(-1, VALUES), [np.frombuffer(x, "<u8") for x in own["set"]]
    found = completed(sets, sigs, labels, np.flatnonzero(own["asked"]), int(own["tree"].iloc[0]))
    return [(int(reps[i]), int(reps[j])) for i, j in found]


def dense_links(whole: DataFrame, labels: DataFrame, sigs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) that connect what dense regions still lack."""

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(linked_blocks(rows), columns=["a", "b"], dtype="int64")

    return blocks(whole, labels).join(sigs, "rep").join(sets, "rep").groupBy("region", "i", "j").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of docs (null text: empty).

    Links join documents with 100 * intersection >= 75 * union of their sets of distinct 5-word shingles; a component
    is named by its smallest doc_id, which is kept. Empty sets are linked with nothing. A null doc_id is alone, with a
    null component, and kept. Rows that share a doc_id count as one document with all their sets: each is a class of its
    own, and the classes of one doc_id are linked. No rows give no rows.
    """
    spark = docs.sparkSession
    marks = written(signatures(docs), "minhash")
    known = marks.where("doc_id is not null and set_key is not null")
    classes = written(known.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_shingles").alias("n_shingles"), F.first("sig").alias("sig")), "minhash-classes")
    links = spark.createDataFrame([], "a long, b long")
    repeated = _repeated(marks)
    if repeated:  # an id may have several sets, so classes go by numbers of their own
        classes = written(classes.withColumnRenamed("rep", "low").withColumn("rep", F.monotonically_increasing_id()), "numbered-classes")
        links = written(_own_links(known, classes), "own-links")
    labels, first, sets = None, 0, None
    forest, dense = [], []
    for trees in ROUNDS:
        found, whole = regions(classes, range(first, first + trees))
        forest.append(written(found, "regions"))
        dense += [] if whole is None else [whole]
        first += trees
    wanted = forest[0].select("rep")
    for found in forest[1:]:
        wanted = wanted.union(found.select("rep"))
    for whole in dense:
        wanted = wanted.union(whole.select("rep"))
    wanted = written(wanted.distinct(), "region-reps")
    sets = written(_sets_by_key(docs, classes.join(wanted, "rep").select("rep", "set_key")) if repeated else _sets(docs, wanted), "region-sets")
    sigs = classes.select("rep", "sig")
    if repeated:
        labels = written(components(links), "near-labels")
    for found in forest:
        if labels is None:
            placed = found.withColumn("component", F.col("rep"))
        else:
            placed = found.join(labels, found.rep == labels.node, "left").select("tree", "region", "rep", F.coalesce("component", "rep").alias("component"))
        open_ = placed.groupBy("region").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("region")
        todo = placed.join(open_, "region").join(sigs, "rep").join(sets, "rep")

        def link(own: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame(linked(own), columns=["a", "b"], dtype="int64")

        links = written(links.union(todo.groupBy("region").applyInPandas(link, "a long, b long")), "near-links")
        labels = written(components(links), "near-labels")
    if dense:
        links = written(links.union(dense_links(reduce(DataFrame.union, dense), labels, sigs, sets)), "near-links")
        labels = written(components(links), "near-labels")
    if repeated:
        lows = labels.join(classes.select("rep", "low"), labels.node == F.col("rep")).groupBy("component").agg(F.min("low").alias("low_of"))
        labels = labels.join(lows, "component").select("node", F.col("low_of").alias("component"))
        classes = classes.select("set_key", "n", "rep", "low").join(labels, F.col("rep") == F.col("node"), "left").select("set_key", "n", "rep", F.coalesce("component", "low").alias("low"))
        labels = classes.select(F.col("rep").alias("node"), F.col("low").alias("component"))
        classes = classes.drop("low")
    # Classes of one document that is linked with nothing need no join.
    by_class = classes.join(labels, classes.rep == labels.node, "left").where("n > 1 or component is not null")
    by_class = by_class.select("set_key", F.coalesce("component", "rep").alias("component_id"))
    rows = marks.select("doc_id", "n_shingles", "set_key").join(by_class, "set_key", "left")
    rows = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
    return rows.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _repeated(marks: DataFrame) -> bool:
    return not marks.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty()


def _own_links(known: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between all classes of one doc_id and the first of them."""
    of = written(known.select("doc_id", "set_key").distinct().join(classes.select("set_key", "rep"), "set_key").select("doc_id", "rep"), "classes-of-ids")
    first = of.groupBy("doc_id").agg(F.min("rep").alias("b"))
    return of.join(first, "doc_id").where("rep <> b").select(F.col("rep").alias("a"), "b")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps, one for each doc_id, with the same columns.

    Rows with a null id stay; of repeated ids one row stays, with any of their texts. No rows give no rows.
    """
    marks = written(near_duplicates(docs), "near-kept")
    (own,) = fresh(docs, "gone_id")
    gone = marks.where("not kept").select(F.col("doc_id").alias(own)).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    rows = docs.join(gone, F.col("doc_id") == F.col(own), "left_anti")
    if _repeated(marks):
        rows = rows.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(rows.where("doc_id is null"))
    return rows


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


#: The same by a join of all shingles, for DuckDB and small tables.
OP9_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS root, doc_id AS node FROM documents UNION SELECT root, e.b FROM r JOIN e ON e.a = r.node)
SELECT root AS doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(node) AS component_id, root = min(node) AS kept FROM r LEFT JOIN n ON n.doc_id = root GROUP BY root"""
