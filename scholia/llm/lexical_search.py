"""Ranked lexical search over a two-level quantised index.

Documents are cut into segments, one Parquet row each. The first level of a segment has its terms and, for each posting, a
byte: the term's impact in the document over STEP, rounded up. Bytes alone bound every score from above, and, as no byte
is more than STEP - 1 too high for its impact, from below. The second level has the exact numbers: the term's occurrences in the
document and the document's length norm. A search reads the first level and finds each item's kth highest lower bound over
all documents; then every document whose upper bound reaches it is rescored in integers from the second level.

Segments are built where the texts are, without an exchange of postings. Items come in blocks of a bounded number of
terms, so what tasks get of them is bounded; a task keeps k rows an item, and those meet in one window over items.
"""

from __future__ import annotations

import string
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import BATCH_ROWS, prepare, table, texts, written

#: Impacts are below a million; 255 steps reach it.
STEP = 3922
#: Postings and documents of a segment, at which it is closed (a document's own terms aren't parted).
SEGMENT_POSTINGS, SEGMENT_DOCS = 400_000, 60_000
#: Different terms of a block of items, on average; an item's own terms aren't parted.
BLOCK_TERMS = 200_000
#: Segments handed to Python at once, and bytes of a row group of the index.
SEGMENT_ROWS, GROUP_BYTES = 8, 16 << 20
#: How Parquet keeps GROUP_BYTES: it looks at the size of a group after each row, where it would after a hundred; readers
#: hold a whole group, and a segment is megabytes.
GROUPS = {"parquet.block.size": str(GROUP_BYTES), "parquet.page.size.row.check.min": "1", "parquet.page.size.row.check.max": "1"}
#: Characters of terms; the contract's.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEGMENT = "doc_ids array<bigint>, norms array<bigint>, n_docs int, terms array<string>, sizes array<int>, ordinals binary, impacts binary, tfs binary"

_KEPT = set(string.ascii_letters + string.digits)
#: Every byte of a character that ends terms becomes a space, A to Z become small; bytes of longer characters stay.
_FOLD = bytes(ord(chr(b).lower()) if b >= 0x80 or chr(b) in _KEPT else 0x20 for b in range(0x80)) + bytes(range(0x80, 0x100))


@dataclass
class Index:
    """A table of segments with the statistics that impacts and weights need."""

    segments: DataFrame
    n_docs: int
    n_terms: int


def folded(column: pa.StringArray) -> pa.StringArray:
    """The texts with small letters and spaces around terms; lengths in bytes stay."""
    _, offsets, data = column.buffers()
    return pa.StringArray.from_buffers(len(column), offsets, pa.py_buffer((data.to_pybytes() if data else b"").translate(_FOLD)), offset=column.offset)


def term_counts(column: pa.StringArray) -> np.ndarray:
    """Terms of each text, with repeats."""
    own = folded(column)
    data = np.frombuffer(own.buffers()[2], np.uint8)
    offsets = np.frombuffer(own.buffers()[1], np.int32)[own.offset : own.offset + len(own) + 1]
    inside = data != 0x20
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    starts[firsts] = inside[firsts]
    return np.diff(np.concatenate([[0], np.cumsum(starts)])[offsets])


def statistics(docs: DataFrame) -> tuple[int, int]:
    """How many documents have terms, and all their terms."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = term_counts(batch.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array([np.count_nonzero(n)], pa.int64()), pa.array([n.sum()], pa.int64())], ["n_docs", "n_terms"])

    found = texts(docs).select("text").mapInArrow(run, "n_docs long, n_terms long").agg(F.sum("n_docs"), F.sum("n_terms")).head()
    return found[0] or 0, found[1] or 0


class Segment:
    """A segment while it grows."""

    def __init__(self, n_docs: int, n_terms: int):
        self.n_docs, self.n_terms = n_docs, n_terms
        self.rows: dict[str, int] = {}
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []
        self.docs, self.own, self.tfs = [], [], []
        self.postings = 0

    def add(self, doc_ids: list[int | None], column: pa.StringArray) -> None:
        """Texts with terms become documents of the segment."""
        split = pc.ascii_split_whitespace(folded(column))
        words = split.flatten().dictionary_encode()
        codes = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        doc = np.repeat(np.arange(len(column)), np.diff(split.offsets.to_numpy()))
        plain = words.dictionary.to_pylist()
        if "" in plain:
            real = codes != plain.index("")
            codes, doc = codes[real], doc[real]
        n = np.bincount(doc, minlength=len(column))
        keys, tfs = np.unique(doc << 32 | codes, return_counts=True)
        used = np.flatnonzero(n)
        ordinal = np.zeros(len(column), np.int64)
        ordinal[used] = len(self.doc_ids) + np.arange(len(used))
        rows = np.fromiter((self.rows.setdefault(w, len(self.rows)) if w else 0 for w in plain), np.int64, len(plain))
        self.docs.append(ordinal[keys >> 32])
        self.own.append(rows[keys & 0xFFFFFFFF])
        self.tfs.append(tfs)
        self.doc_ids += [doc_ids[i] for i in used.tolist()]
        self.lengths += n[used].tolist()
        self.postings += len(keys)

    def full(self) -> bool:
        return self.postings >= SEGMENT_POSTINGS or len(self.doc_ids) >= SEGMENT_DOCS

    def row(self) -> pa.RecordBatch:
        docs, own, tfs = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (self.docs, self.own, self.tfs))
        order = np.argsort(own, kind="stable")  # documents ascend within a term
        docs, own, tfs = docs[order], own[order], tfs[order]
        norms = 25 + 75 * np.array(self.lengths, np.int64) * self.n_docs // max(self.n_terms, 1)
        impacts = -(-exact_impacts(tfs, norms[docs]) // STEP)
        columns = [[self.doc_ids], [norms], [len(norms)], [list(self.rows)], [np.bincount(own, minlength=len(self.rows))], [docs.astype("<u2").tobytes()], [impacts.astype(np.uint8).tobytes()], [tfs.astype("<u4").tobytes()]]
        kinds = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], [c.split()[0] for c in SEGMENT.split(", ")])


def exact_impacts(tfs: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """A term's share of a score, over its weight, in 64-bit integers."""
    return 1_000_000_000 * tfs // (1000 * tfs + 8 * norms)


def build_index(docs: DataFrame) -> Index:
    """The index of every whole text of docs (doc_id, text); null texts and texts without terms have no postings.

    Two passes over the texts: the statistics, then segments with final impacts. Null and repeated doc_ids stay documents of
    their own. No rows give an index without segments.
    """
    prepare(docs.sparkSession)
    n_docs, n_terms = statistics(docs)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment = Segment(n_docs, n_terms)
        for batch in batches:
            segment.add(batch.column("doc_id").to_pylist(), batch.column("text"))
            if segment.full():
                yield segment.row()
                segment = Segment(n_docs, n_terms)
        if segment.doc_ids:
            yield segment.row()

    rows = texts(docs).withColumn("doc_id", F.col("doc_id").cast("long")).mapInArrow(run, SEGMENT)
    return Index(written(rows, "lexical-index", compression="zstd", **GROUPS), n_docs, n_terms)


def item_terms(items: DataFrame) -> DataFrame:
    """item_id, term and n, how often the item has it; rows of one item_id (null too) are one item, null texts have none."""
    lower = F.translate(F.col("text"), string.ascii_uppercase, string.ascii_lowercase)
    each = items.select("item_id", F.explode(F.regexp_extract_all(lower, F.lit(TERM), 0)).alias("term"))
    return each.groupBy("item_id", "term").agg(F.count("*").alias("n"))


class Bounds:
    """Sums of weighted bytes of a segment's documents, item by item."""

    def __init__(self, vocabulary: pa.StringArray, items: list[tuple[np.ndarray, np.ndarray]]):
        self.vocabulary, self.items = vocabulary, items

    def __call__(self, batch: pa.RecordBatch, i: int) -> Iterator[tuple[int, np.ndarray, dict[int, tuple[int, int]]]]:
        """Of row i: each item that meets a document, the sums, and its terms' places among the postings."""
        found = pc.index_in(batch.column("terms")[i].values, value_set=self.vocabulary).to_numpy(zero_copy_only=False)
        ends = np.cumsum(batch.column("sizes")[i].values.to_numpy())
        own = np.flatnonzero(found == found)  # nulls are nan
        at = {int(found[j]): (int(ends[j - 1]) if j else 0, int(ends[j])) for j in own.tolist()}
        ordinals = np.frombuffer(batch.column("ordinals")[i].as_buffer(), "<u2")
        impacts = np.frombuffer(batch.column("impacts")[i].as_buffer(), np.uint8)
        lists = {t: (ordinals[a:b].astype(np.intp), impacts[a:b].astype(np.int64)) for t, (a, b) in at.items()}
        n = batch.column("n_docs")[i].as_py()
        for k, (terms, weights) in enumerate(self.items):
            sums = np.zeros(n, np.int64)
            for t, w in zip(terms.tolist(), weights.tolist()):
                if t in lists:
                    docs, bytes_ = lists[t]
                    sums[docs] += w * bytes_
            if sums.any():
                yield k, sums, at


def _search_block(index: Index, block: DataFrame, k: int) -> DataFrame | None:
    """item_id, doc_id and score of each task's k best documents of each item of a block."""
    spark = block.sparkSession
    words = F.broadcast(block.select("term").distinct())
    sizes = index.segments.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).select(F.col("x.terms").alias("term"), F.col("x.sizes").alias("size"))
    df = sizes.join(words, "term").groupBy("term").agg(F.sum("size").alias("df"))
    weight = F.floor(1000 * F.log((2 * F.lit(index.n_docs) + 2) / (2 * F.col("df") + 1))).cast("long")
    rows = block.join(df, "term").select("item_id", "term", (weight * F.col("n")).alias("w")).toPandas().sort_values(["term"])
    if rows.empty:
        return None
    vocabulary = rows["term"].drop_duplicates().tolist()
    places = dict(zip(vocabulary, range(len(vocabulary))))
    names, items = [], []
    for name, own in rows.groupby("item_id", dropna=False):
        names.append(None if name != name else int(name))
        items.append((own["term"].map(places).to_numpy(np.int64), own["w"].to_numpy(np.int64)))
    bounds = Bounds(pa.array(vocabulary, pa.string()), items)
    # A lower bound is a sum of bytes times STEP less (STEP - 1) for all weights.
    slack = np.array([(STEP - 1) * int(w.sum()) for _, w in items], np.int64)

    def highest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, np.ndarray] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                for item, sums, _ in bounds(batch, i):
                    top = np.partition(sums, len(sums) - k)[-k:] if len(sums) > k else sums
                    held = np.concatenate([best.get(item, sums[:0]), top])
                    best[item] = np.sort(held)[-k:]
        flat = [(item, x) for item, own in best.items() for x in own.tolist()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in flat], pa.int32()), pa.array([x[1] for x in flat], pa.int64())], ["item", "sums"])

    level1 = ["n_docs", "terms", "sizes", "ordinals", "impacts"]
    tops = index.segments.select(*level1).mapInArrow(highest, "item int, sums long")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("sums")))
    kth = tops.withColumn("place", place).where(F.col("place") == k).select("item", "sums").collect()  # one row an item
    least = np.ones(len(items), np.int64)
    for item, sums in kth:
        least[item] = max(1, sums * STEP - slack[item])

    def rescored(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                ordinals = np.frombuffer(batch.column("ordinals")[i].as_buffer(), "<u2")
                tfs = np.frombuffer(batch.column("tfs")[i].as_buffer(), "<u4")
                norms, ids = batch.column("norms")[i].values.to_numpy(), batch.column("doc_ids")[i].values
                for item, sums, at in bounds(batch, i):
                    docs = np.flatnonzero((sums * STEP >= least[item]) & (sums > 0))
                    if not len(docs):
                        continue
                    scores = np.zeros(len(docs), np.int64)
                    for t, w in zip(*(x.tolist() for x in items[item])):
                        if t in at:
                            a, b = at[t]
                            place = np.minimum(np.searchsorted(ordinals[a:b], docs), b - a - 1)
                            held = ordinals[a:b][place] == docs
                            scores[held] += w * exact_impacts(tfs[a:b][place[held]].astype(np.int64), norms[docs[held]])
                    kth = np.partition(scores, len(scores) - k)[-k] if len(scores) > k else 1
                    own = np.flatnonzero(scores >= max(1, kth))
                    found = zip(scores[own].tolist(), ids.take(pa.array(docs[own])).to_pylist())
                    best[item] = sorted([*best.get(item, []), *((-s, d is None, d or 0) for s, d in found)])[:k]
        flat = [(item, None if null else d, -s) for item, own in best.items() for s, null, d in own]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in flat], t) for j, t in enumerate((pa.int32(), pa.int64(), pa.int64()))], ["item", "doc_id", "score"])

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SEGMENT_ROWS))
    found = written(index.segments.mapInArrow(rescored, "item int, doc_id long, score long"), "lexical-hits")
    named = spark.createDataFrame(list(enumerate(names)), "item int, item_id long")
    return found.join(F.broadcast(named), "item").select("item_id", "doc_id", "score")  # as many rows as the block has items


def search(index: Index, items: DataFrame, k: int) -> DataFrame:
    """item_id, rank, doc_id and score of each item's k best documents with a score above 0, ties by doc_id (nulls last).

    items has item_id and text. Items are taken in blocks of about BLOCK_TERMS terms; a block costs three scans of the
    index: its terms' counts, first level, both levels. Items without terms or hits have no rows.
    """
    spark = items.sparkSession
    terms = written(item_terms(items.select(F.col("item_id").cast("long"), "text")), "item-terms")
    empty = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    n_blocks = -(-terms.count() // BLOCK_TERMS)
    if not n_blocks or not index.n_docs:
        return empty
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(SEGMENT_ROWS))
    blocks = [_search_block(index, terms.where(F.pmod(F.xxhash64("item_id"), F.lit(n_blocks)) == b), k) for b in range(n_blocks)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    hits = None
    for found in blocks:
        if found is not None:
            hits = found if hits is None else hits.unionByName(found)
    if hits is None:
        return empty
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's ten highest-scoring documents."""
    return search(build_index(table(spark, sf_dir, "documents")), table(spark, sf_dir, "benchmark"), 10)


OP11_SQL = r"""
WITH words AS (
  SELECT row_number() OVER () AS d, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts
  FROM documents),
lengths AS (SELECT d, doc_id, len(ts) AS n, ts FROM words WHERE len(ts) > 0),
totals AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM lengths),
posts AS (SELECT d, term, count(*) AS tf FROM (SELECT d, unnest(ts) AS term FROM lengths) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM posts, totals GROUP BY term),
items AS (
  SELECT item_id, term, count(*) AS c
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY ALL),
scored AS (
  SELECT item_id, d, any_value(doc_id) AS doc_id, sum(c * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nn) // ll))))::BIGINT AS score
  FROM items JOIN weights USING (term) JOIN posts USING (term) JOIN lengths USING (d), totals
  GROUP BY item_id, d)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0)
WHERE rank <= 10
"""
