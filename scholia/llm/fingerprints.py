"""Canonical exact fingerprints of texts, and groups of texts that are canonically equal.

The canonical form is Unicode NFKC, case folding, NFKC again, and one space for each run of white space, none at the
ends. Its fingerprint is the 128-bit xxhash (XXH3) in hexadecimal. Texts count as equal if their canonical bytes are.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, table, texts, written

#: Ids of rows in buckets of several that are broadcast at most (8 MB).
BROADCAST_IDS = 1_000_000


def canonical(text: str) -> bytes:
    """The bytes of which the fingerprint is taken."""
    folded = text.casefold() if text.isascii() else unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    return " ".join(folded.split()).encode()


def fingerprint(data: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(data)


def likeness(a: bytes, b: bytes) -> float:
    """1 if the fingerprints and then the bytes are equal, else 0."""
    return float(fingerprint(a) == fingerprint(b) and a == b)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points) and fingerprint of every whole text (null: empty), in one map."""
    prepare(docs.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("text").to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(map(len, own), pa.int64()), pa.array([fingerprint(canonical(x)) for x in own])], ["doc_id", "n_chars", "fingerprint"])

    return texts(docs).mapInArrow(run, "doc_id long, n_chars long, fingerprint string")


def equal_groups(docs: DataFrame, marks: DataFrame | None = None) -> DataFrame:
    """fingerprint and group_id (the group's smallest doc_id) of every row of docs, with doc_id and marks' columns.

    marks (doc_id, fingerprint and any others) may be given where they are known. Fingerprints are grouped without
    texts; only rows of buckets with several rows go through the byte comparison, and equal bytes meet by map-side
    aggregation, so a bucket may hold any share of the rows. Ids and buckets are broadcast up to BROADCAST_IDS, else
    joined. Rows with a null id are alone, with a null group. No rows give no rows.
    """
    marks = written(fingerprints(docs), "fingerprints") if marks is None else marks
    own = marks.where("doc_id is not null").select("doc_id", "fingerprint")
    # Tables of their own, so that the joins with them are broadcasts, or such that skewed partitions can be split.
    several = written(own.groupBy("fingerprint").agg(F.count("*").alias("n")).where("n > 1").select("fingerprint"), "several-marks")
    several = F.broadcast(several) if several.count() <= BROADCAST_IDS // 4 else several
    ids = written(own.join(several, "fingerprint", "left_semi").select("doc_id").distinct(), "several-ids")
    few = ids.count() <= BROADCAST_IDS

    def canon(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [canonical(x) for x in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array([fingerprint(x) for x in own]), pa.array(own, pa.binary())], ["doc_id", "fingerprint", "bytes"])

    full = texts(docs).join(F.broadcast(ids) if few else ids, "doc_id", "left_semi").mapInArrow(canon, "doc_id long, fingerprint string, bytes binary")
    classes = written(full.groupBy("fingerprint", "bytes").agg(F.min("doc_id").alias("group_id")).select("fingerprint", F.sha2("bytes", 256).alias("check"), "group_id"), "equal-classes")
    # Nearly all buckets hold one kind of bytes; rows of any other bucket find their kind by their own bytes.
    kinds = classes.groupBy("fingerprint").agg(F.count("*").alias("kinds"), F.min("group_id").alias("group_id"))
    odd = kinds.where("kinds > 1").select("fingerprint")
    by_bucket = kinds.select("fingerprint", F.when(F.col("kinds") == 1, F.col("group_id")).alias("same"))
    out = marks.join(F.broadcast(by_bucket) if few else by_bucket, "fingerprint", "left")
    by_row = F.lit(None).cast("long")
    if not odd.isEmpty():
        rows = full.join(odd, "fingerprint", "left_semi").select("doc_id", "fingerprint", F.sha2("bytes", 256).alias("check"))
        rows = rows.join(classes, ["fingerprint", "check"]).groupBy("doc_id").agg(F.min("group_id").alias("odd_group"))
        out, by_row = out.join(rows, "doc_id", "left"), F.col("odd_group")
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce(by_row, "same", "doc_id"))
    return out.select(*marks.columns, group.alias("group_id"))


def compared(text: str, canon: bytes, after: str, after_canon: bytes) -> tuple:
    """What COMPARED names, of a text and the next one."""
    half = len(text) // 2
    edited = text[: len(text) - half] + after[:half]
    edited_canon = canonical(edited)
    return len(text), hashlib.sha256(edited.encode()).hexdigest(), fingerprint(canon), fingerprint(edited_canon), likeness(canon, edited_canon), likeness(canon, after_canon)


def _compared_rows(rows: list[tuple]) -> pa.RecordBatch:
    """Of (doc_id, text, canonical, next text, its canonical)."""
    columns = list(zip(*[(doc_id, *compared(*rest)) for doc_id, *rest in rows])) or [[]] * (1 + len(COMPARED))
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["doc_id", *COMPARED])


def compared_with_next(docs: DataFrame) -> DataFrame:
    """Each text, its edited text and the next text in descending doc_id, by their fingerprints.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next text. One
    range exchange sorts the texts (null ids last, equal ids by a hash of the text; after the last row comes the first)
    and a task pairs its rows as they stream by. A task's last row meets the first row of the next task that has rows: those
    two texts of each task are joined afterwards. No rows give no rows.
    """
    prepare(docs.sparkSession)
    order = [F.col("doc_id").desc(), F.col("h")]
    ordered = texts(docs).withColumn("h", F.xxhash64("text")).repartitionByRange(*order).sortWithinPartitions(*order, "text").select("doc_id", "text")
    names = ", ".join(f"{k} {v}" for k, v in COMPARED.items())

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, head, held = TaskContext.get().partitionId(), None, None
        ends = [pa.field("part", pa.int32()), pa.field("head", pa.string()), pa.field("tail", pa.string())]

        def full(batch: pa.RecordBatch, *more: str | int | None) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([x] * batch.num_rows, f.type) for x, f in zip(more or [None] * 3, ends))], [*batch.schema.names, *(f.name for f in ends)])

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                canon = canonical(text)
                if held is None:
                    head = text
                else:
                    rows.append((*held, text, canon))
                held = (doc_id, text, canon)
            yield full(_compared_rows(rows))
        if held is not None:  # the tail's own columns but doc_id are made when its next text is there
            yield full(_compared_rows([(*held, "", b"")]), part, head, held[1])

    rows = written(ordered.mapInArrow(pairs, f"doc_id long, {names}, part int, head string, tail string"), "next-pairs")
    ends = rows.where("part is not null").select("doc_id", "part", "head", "tail")
    order = Window.orderBy("part")  # over one number for each task
    after = ends.select("part").select("part", F.coalesce(F.lead("part").over(order), F.first("part").over(order)).alias("after"))
    joined = ends.select("doc_id", "part", "tail").join(after, "part").join(ends.select(F.col("part").alias("after"), "head"), "after")

    def close(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield _compared_rows([(d, a, canonical(a), b, canonical(b)) for d, a, b in zip(*(batch.column(i).to_pylist() for i in range(3)))])

    return rows.where("part is null").select("doc_id", *COMPARED).unionByName(joined.select("doc_id", "tail", "head").mapInArrow(close, f"doc_id long, {names}"))


#: What a document and the next one give.
COMPARED = {"n_chars": "long", "edited_sha256": "string", "fingerprint": "string", "edited_fingerprint": "string", "near_edited": "double", "near_next": "double"}


def op10_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents, compared with those of edited and next texts, and their groups."""
    docs = table(spark, sf_dir, "documents")
    return equal_groups(docs, written(compared_with_next(docs), "fingerprint-rows"))
