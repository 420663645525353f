"""Removal of repeated byte strings with suffixes sorted block by block.

A string of LENGTH bytes that starts twice is found by suffixes that agree in LENGTH bytes. Suffixes are dealt to
buckets by content: each window of LENGTH bytes has an anchor, the leftmost of its substrings of GRAM bytes with the
smallest hash, and equal windows have equal anchors at equal places. An anchor that occurs once can't be of a repeated
window, so only runs of windows (with the bytes they cover) whose anchor occurs again go to the buckets. Where an
anchor's distinct runs are more than a bucket holds, they are dealt by further bytes: the windows of each half of the
places that the anchor can have share a stretch next to it, whose digest names their own bucket, and so on by halves.

Buckets are sorted one at a time, in memory that their size bounds: the positions whose distance from the anchor is in
the difference cover {0, 1, 3} mod 7 are ranked first, by doubling; then every suffix has a cover position at most 3
bytes on, whose rank stands for all that follows, however long the tie. Equal texts are one text, removed as a whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, prepare, table, texts, written

LENGTH, GRAM = 200, 32
SPAN = LENGTH - GRAM + 1
COVER, PERIOD = (0, 1, 3), 7
#: Bytes from a suffix to the next cover position, by the suffix's residue.
SHIFT = np.array([min(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])
#: Length of the cover's ranked strings: a multiple of the period that leaves 4 bytes of a window.
RANKED = (LENGTH - 4) // PERIOD * PERIOD
#: Bytes hashed at a time; bytes of a bucket (its sort takes some 40 times as many); ids or hashes broadcast at most
#: (8 bytes each).
PIECE, BUCKET, BROADCAST_IDS = 1 << 20, 2 << 20, 1_000_000
assert RANKED + 4 == LENGTH


def _gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of each substring of GRAM bytes."""
    h, n = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    while n < GRAM:
        right = h[n:] ^ (h[n:] >> np.uint64(29))
        right *= np.uint64(0xA0761D6478BD642F)
        left = h[:-n] * np.uint64(0x9E3779B97F4A7C15)
        left += right
        h, n = left, 2 * n
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xE7037ED1A0B428DB)
    return h


def runs(pieces: list[tuple[int, int, bytes]]) -> tuple[np.ndarray, ...]:
    """Of pieces (document, place of its first byte, bytes): document, first window, last window, anchor and hash of each
    run of windows with one anchor. Windows don't cross pieces."""
    flat = np.frombuffer(b"".join(p[2] for p in pieces), np.uint8)
    none = np.zeros(0, np.int64)
    if len(flat) < LENGTH:
        return none, none, none, none, none.astype(np.uint64)
    h = _gram_hashes(flat)
    low = (h & ~np.uint64(0xFFFFFFFF)) | np.arange(len(h), dtype=np.uint64)
    n = 1
    while 2 * n <= SPAN:
        low, n = np.minimum(low[:-n], low[n:]), 2 * n
    low = np.minimum(low[: len(flat) - LENGTH + 1], low[SPAN - n : SPAN - n + len(flat) - LENGTH + 1])
    anchor = (low & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.array([len(p[2]) for p in pieces])
    starts = np.cumsum(sizes) - sizes
    piece = np.repeat(np.arange(len(pieces)), np.maximum(sizes - LENGTH + 1, 0))
    window = np.arange(len(piece)) - np.repeat(np.cumsum(np.maximum(sizes - LENGTH + 1, 0)) - np.maximum(sizes - LENGTH + 1, 0), np.maximum(sizes - LENGTH + 1, 0)) + starts[piece]
    if not len(window):
        return none, none, none, none, none.astype(np.uint64)
    at = anchor[window]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (piece[1:] != piece[:-1])]))
    last = np.concatenate([new[1:], [len(window)]]) - 1
    own, place = piece[new], np.array([p[1] for p in pieces])
    docs, back = np.array([p[0] for p in pieces]), place - starts
    return docs[own], window[new] + back[own], window[last] + back[own], at[new] + back[own], h[at[new]]


def _pieces(batch: Iterable[tuple[int, bytes]]) -> Iterator[list[tuple[int, int, bytes]]]:
    held, size = [], 0
    for doc, data in batch:
        for at in range(0, max(len(data) - LENGTH + 1, 0), PIECE):
            held.append((doc, at, data[at : at + PIECE + LENGTH - 1]))
            size += len(held[-1][2])
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchored(docs: DataFrame) -> DataFrame:
    """doc_id, a, b (first and last window), p (anchor) and h of every run of windows of docs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(batch.column("doc_id").to_pylist(), (x.encode() for x in batch.column("text").to_pylist()))
            for pieces in _pieces(rows):
                d, a, b, p, h = runs(pieces)
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a), pa.array((b - a).astype(np.int32)), pa.array((p - a).astype(np.int32)), pa.array(h.view(np.int64))], ["doc_id", "a", "b", "p", "h"])

    return docs.mapInArrow(run, "doc_id long, a long, b int, p int, h long")


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Of each key its place among the distinct ones, in order."""
    order = np.argsort(keys)
    ordered = keys[order]
    place = np.zeros(len(keys), np.int32)
    np.cumsum(ordered[1:] != ordered[:-1], out=place[1:] if len(keys) else place)
    new = np.empty(len(keys), np.int32)
    new[order] = place
    return new


def sorted_windows(blocks: list[bytes], anchors: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Windows of all blocks, numbered through, in the order of (residue, LENGTH bytes); and whether each equals the one before.

    anchors: the place of each block's anchor; all its windows hold it, so equal windows have equal residues.
    """
    sizes = np.array([len(x) for x in blocks], np.int32)
    starts = (np.cumsum(sizes) - sizes).astype(np.int32)
    text = np.frombuffer(b"".join(blocks) + bytes(8), np.uint8)
    n = len(text) - 8
    at = np.arange(n, dtype=np.int32)
    residue = ((at - np.repeat(starts + np.array(anchors, np.int32), sizes)) % PERIOD).astype(np.int8)
    left = np.repeat(starts + sizes, sizes) - at  # bytes to the block's end
    # Ranks of the cover's positions: of 7 bytes first, then of twice as many by the ranks of both halves.
    length = PERIOD
    keep = np.flatnonzero(np.isin(residue, COVER) & (left >= length)).astype(np.int32)
    wide = np.zeros(len(keep), np.uint64)
    for i in range(PERIOD):
        wide <<= np.uint64(8)
        wide |= text[keep + i]
    rank = at
    rank.fill(-1)
    rank[keep] = _ranks(wide)
    while length < RANKED:
        step = min(length, RANKED - length)
        length += step
        keep = keep[left[keep] >= length]
        wide = rank[keep].astype(np.uint64)
        wide <<= np.uint64(32)
        wide |= rank[keep + step].astype(np.uint64)
        rank[keep] = _ranks(wide)
    del wide, keep
    window = np.flatnonzero(left >= LENGTH).astype(np.int32)
    del left
    # A window is the bytes before its cover position, the ranked string from there, and what it has after that.
    residue = residue[window]
    shift = SHIFT[residue].astype(np.int32)
    key = residue.astype(np.uint64)
    for i in range(max(SHIFT)):
        before = np.flatnonzero(i < shift)
        key[before] = (key[before] << np.uint64(8)) | text[window[before] + i]
    key = (key << np.uint64(28)) | rank[window + shift].astype(np.uint64)
    for i in range(4):
        after = np.flatnonzero(i >= shift)
        key[after] = (key[after] << np.uint64(8)) | text[window[after] + RANKED + i]
    order = np.argsort(key)
    ordered = key[order]
    return order, np.concatenate([[False], ordered[1:] == ordered[:-1]])


def repeated_windows(blocks: list[bytes], anchors: list[int]) -> list[np.ndarray]:
    """Which windows of each block are equal to another window of the same bucket."""
    order, same = sorted_windows(blocks, anchors)
    twice = np.zeros(len(order), bool)
    twice[order[same]] = True
    twice[order[:-1][same[1:]]] = True
    return np.split(twice, np.cumsum([max(len(x) - LENGTH + 1, 0) for x in blocks])[:-1])


def halves(p: int, block: bytes, least: int, most: int) -> list[tuple[int, int, int, bytes, bytes]]:
    """A block's windows in two: those whose anchor is at most halfway from least to most, and the others.

    Of each that is there: least, most, the anchor's place in the own block, what all its windows share besides what
    all of the block share, and the own block.
    """
    middle, out = (least + most) // 2, []
    for low, high in ((least, middle), (middle + 1, most)):
        first, last = max(p - high, 0), min(p - low, len(block) - LENGTH)
        if first <= last:
            own = block[first : last + LENGTH]
            # All windows have the bytes from low before the anchor up to LENGTH - high after it.
            out.append((low, high, p - first, block[p - low : p - low + LENGTH - (high - low)], own))
    return out


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of true flags."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edges[::2].tolist(), (edges[1::2] - 1).tolist()))


def _of(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """Texts whose doc_id is (or is not) among ids, which are broadcast up to BROADCAST_IDS."""
    return texts(docs).join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", how)


def repeated_spans(docs: DataFrame) -> DataFrame:
    """doc_id and spans, an array of (first, last) windows of LENGTH bytes that start elsewhere too.

    docs: doc_id (unique, not null) and text, no two texts equal. Documents without such a window have no row.
    """
    spark = docs.sparkSession
    prepare(spark)
    anchors = written(anchored(docs), "suffix-anchors")
    # A table of its own: the join with it is a broadcast, or one whose skewed partitions can be split.
    again = written(anchors.groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h"), "suffix-again")
    again = F.broadcast(again) if again.count() <= BROADCAST_IDS else again
    lists = anchors.join(again, "h").groupBy("doc_id").agg(F.collect_list(F.struct("a", "b", "p", "h")).alias("runs"))
    lists = written(lists, "suffix-runs")
    own = _of(docs, lists.select("doc_id"), "left_semi").join(lists, "doc_id")

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            size = 0
            for doc, text, found in zip(*(batch.column(x).to_pylist() for x in ("doc_id", "text", "runs"))):
                data = text.encode()
                for r in found:
                    block = data[r["a"] : r["a"] + r["b"] + LENGTH]
                    out.append((doc, r["a"], r["p"], r["h"], hashlib.blake2b(block, digest_size=16).digest(), block))
                    size += len(block)
                    if size > 8 << 20:
                        yield blocks_of(out)
                        out, size = [], 0
            yield blocks_of(out)

    def blocks_of(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        columns = list(zip(*rows)) or [[]] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], ["doc_id", "a", "p", "h", "key", "block"])

    placed = written(own.mapInArrow(cut, "doc_id long, a long, p int, h long, key binary, block binary"), "suffix-blocks")
    # Equal blocks meet once; a passage in any number of documents is a few blocks here.
    whole = written(placed.groupBy("h", "p", "key").agg(F.first("block").alias("block"), F.count("*").alias("n")), "suffix-distinct")
    found = None
    for blocks in _buckets(whole):
        own = blocks.groupBy("bucket").applyInPandas(_sort_bucket, FOUND) if "bucket" in blocks.columns else blocks
        found = own if found is None else found.unionByName(own)
    found = written(found, "suffix-found")
    found = placed.select("doc_id", "a", "h", "p", "key").join(found, ["h", "p", "key"])
    found = found.select("doc_id", F.struct((F.col("a") + F.col("first")).alias("first"), (F.col("a") + F.col("last")).alias("last")).alias("span"))
    return written(found.groupBy("doc_id").agg(F.sort_array(F.collect_list("span")).alias("spans")), "suffix-spans")


#: Runs of repeated windows of a block (h, p, key).
FOUND = "h long, p int, key binary, first long, last long"


def _sort_bucket(own: pd.DataFrame) -> pd.DataFrame:
    """The runs of repeated windows of the bucket's blocks, in places of the blocks they are cut from."""
    flags = repeated_windows(own["block"].tolist(), own["place"].tolist())
    out = [(h, p, key, at + a, at + b) for h, p, key, at, single, f in zip(own["h"], own["p"], own["key"], own["at"], own["single"], flags) if single for a, b in _spans(f)]
    return pd.DataFrame(out, columns=["h", "p", "key", "first", "last"])


#: Blocks by name: the anchor's places that they are for, its place in the block, what they are cut from and where, and
#: whether they stand for themselves alone (and not for several equal ones, whose windows are known to be repeated).
BLOCKS = "name binary, least int, most int, place int, mark binary, block binary, h long, p int, key binary, at int, single boolean"


def _buckets(whole: DataFrame) -> list[DataFrame]:
    """Blocks of whole (h, p, key, block, n) dealt to buckets, and FOUND rows of those that are known to be repeated.

    Every two equal windows of different blocks, or of one, are in one bucket. An anchor's blocks of more than BUCKET
    bytes are cut in halves, whose windows share more bytes; equal halves are one from there on. Each round halves the
    places that an anchor can have, so there are eight at most, and what is left then is one window a name.
    """
    names = [x.split()[0] for x in BLOCKS.split(", ")]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.bool_()]
        for batch in batches:
            out: list[tuple] = []
            for name, least, most, place, _, block, *own, at, single in zip(*(batch.column(x).to_pylist() for x in names)):
                for low, high, at_part, shared, part in halves(place, block, least, most):
                    half = hashlib.blake2b(name + low.to_bytes(2, "little") + shared, digest_size=16).digest()
                    mark = hashlib.blake2b(half + at_part.to_bytes(2, "little") + part, digest_size=16).digest()
                    out.append((half, low, high, at_part, mark, part, *own, at + place - at_part, single))
            columns = list(zip(*out)) or [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds)], names)

    def repeated(rows: DataFrame) -> DataFrame:
        return rows.where("single").select("h", "p", "key", F.col("at").cast("long").alias("first"), (F.col("at") + F.length("block") - LENGTH).cast("long").alias("last"))

    rows = whole.select(F.col("h").cast("string").cast("binary").alias("name"), F.lit(0).alias("least"), F.lit(LENGTH - GRAM).alias("most"), F.col("p").alias("place"), F.col("key").alias("mark"), "block", "h", "p", "key", F.lit(0).alias("at"), (F.col("n") == 1).alias("single"))
    out = [repeated(rows.withColumn("single", ~F.col("single")))]
    while True:
        sizes = written(rows.groupBy("name").agg(F.sum(F.length("block")).alias("size")), "suffix-sizes")
        hot = written(sizes.where((F.col("size") > BUCKET)).select("name"), "suffix-hot")
        n_hot = hot.count()
        total = sizes.agg(F.sum("size")).first()[0] or 0
        hot = F.broadcast(hot) if n_hot <= BROADCAST_IDS else hot
        cool = rows.join(hot, "name", "left_anti") if n_hot else rows
        out.append(cool.withColumn("bucket", F.pmod(F.xxhash64("name"), F.lit(max(1, -(-2 * total // BUCKET))))))
        if not n_hot:
            return out
        parts = written(rows.join(hot, "name", "left_semi").select(*names).mapInArrow(cut, BLOCKS), "suffix-halves")
        once = [F.min(x).alias(x) for x in names if x != "mark"]
        rows = written(parts.groupBy("mark").agg(*once, F.count("*").alias("n")).withColumn("single", F.col("single") & (F.col("n") == 1)), "suffix-parts")
        again = rows.where("n > 1").select("mark")
        out.append(repeated(parts.join(again, "mark", "left_semi")))
        rows = rows.select(*names)


def covered(spans: list[dict]) -> list[tuple[int, int]]:
    """Maximal runs of bytes (first, end) that the sorted windows cover."""
    out: list[list[int]] = []
    for s in spans:
        if out and s["first"] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s["last"] + LENGTH)
        else:
            out.append([s["first"], s["last"] + LENGTH])
    return [(a, b) for a, b in out]


EMPTY = hashlib.sha256(b"").hexdigest()


def removals(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What to remove of each row of docs (null text: empty).

    First: one row for each row of docs with doc_id, key, n_bytes, sha (of the text), whole (all of it goes, as other
    rows have the same text of LENGTH bytes or more) and spans (null: nothing goes, or all). Second: texts by key (as
    doc_id). Keys are the ids; where an id is null or repeated, numbers of the distinct texts (by their SHA-256).
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    sha = F.sha2(text.cast("binary"), 256)
    marks = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), sha.alias("sha"))
    marks = written(marks, "suffix-marks")
    by_text = not marks.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()
    several = written(marks.groupBy("sha").agg(F.count("*").alias("n"), F.min("doc_id").alias("rep")).where("n > 1").select("sha", "rep", F.lit(True).alias("several")), "suffix-classes")
    rows = marks.join(several, "sha", "left")
    if by_text:
        numbers = written(marks.select("sha").distinct().withColumn("key", F.monotonically_increasing_id()), "suffix-numbers")
        keyed = texts(docs).select("text", F.sha2(F.col("text").cast("binary"), 256).alias("sha")).join(numbers, "sha").select(F.col("key").alias("doc_id"), "text")
        keyed = unique = written(keyed.groupBy("doc_id").agg(F.first("text").alias("text")), "suffix-texts")
        rows = rows.join(numbers, "sha")
    else:
        keyed = texts(docs)
        copies = written(rows.where("doc_id <> rep").select("doc_id"), "suffix-copies")
        unique = _of(keyed, copies, "left_anti")
        rows = rows.withColumn("key", F.col("doc_id"))
    spans = repeated_spans(unique).withColumnRenamed("doc_id", "key")
    rows = rows.select("doc_id", "key", "n_bytes", "sha", (F.coalesce("several", F.lit(False)) & (F.col("n_bytes") >= LENGTH)).alias("whole"))
    return rows.join(spans, "key", "left"), keyed


def _cut(rows: DataFrame, keyed: DataFrame, make, schema: str) -> DataFrame:
    """make(bytes, runs to remove) of each row of rows that has spans, with its doc_id."""
    rows = written(rows.where("spans is not null and not whole").select("doc_id", "key", "spans"), "suffix-cuts")
    own = _of(keyed, rows.select("key").distinct().withColumnRenamed("key", "doc_id"), "left_semi").withColumnRenamed("doc_id", "key")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [make(t.encode(), covered(s)) for t, s in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist())]
            frame = pd.DataFrame(out, columns=[x.split()[0] for x in schema.split(", ")])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), *(pa.array(frame[c]) for c in frame)], ["doc_id", "key", *frame])

    kinds = dict(rows.dtypes)
    return own.join(rows, "key").select("doc_id", "key", "text", "spans").mapInArrow(run, f"doc_id {kinds['doc_id']}, key long, {schema}")


def kept_bytes(data: bytes, cuts: list[tuple[int, int]]) -> bytes:
    ends = [0, *(b for _, b in cuts)]
    return b"".join(data[e:a] for e, a in zip(ends, [*(a for a, _ in cuts), len(data)]))


def removal_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of each row of docs.

    Null ids and repeated ids or rows are told apart by their texts; equal texts of LENGTH bytes or more go whole. No
    rows give no rows.
    """
    rows, keyed = removals(docs)
    rows = written(rows, "suffix-rows")

    def report(data: bytes, cuts: list[tuple[int, int]]) -> tuple:
        return len(data), sum(b - a for a, b in cuts), len(cuts), hashlib.sha256(kept_bytes(data, cuts)).hexdigest()

    cut = _cut(rows, keyed, report, "n_bytes long, n_removed long, n_spans long, kept_sha256 string").drop("key")
    gone = F.when(F.col("whole"), F.col("n_bytes")).otherwise(F.lit(0).cast("long"))
    rest = rows.where("whole or spans is null").select("doc_id", "n_bytes", gone.alias("n_removed"), F.col("whole").cast("long").alias("n_spans"), F.when(F.col("whole"), EMPTY).otherwise(F.col("sha")).alias("kept_sha256"))
    return rest.unionByName(cut)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of docs with the same columns, texts without their repeated bytes.

    Bytes of a character that is cut in two go as well. Texts without removals, null ones too, stay as they are, and
    rows with null or repeated ids are treated by their texts. Repeated rows stay repeated. No rows give no rows.
    """
    rows, keyed = removals(docs)
    rows = written(rows, "suffix-rows")
    cut = _cut(rows, keyed, lambda data, cuts: (kept_bytes(data, cuts).decode("utf-8", "ignore"),), "kept string")
    own, key, kept = fresh(docs, "own_text", "key_text", "kept_text")
    # By id, or by text where ids don't tell rows apart: the same choice as that of removals.
    by_text = not rows.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null").isEmpty()
    changed = cut.select("doc_id", "kept").unionByName(rows.where("whole").select("doc_id", F.lit("").alias("kept")))
    if by_text:
        changed = cut.select("key", "kept").dropDuplicates(["key"]).join(rows.groupBy("key").agg(F.first("sha").alias("sha")), "key").select("sha", "kept")
        changed = changed.unionByName(rows.where("whole").select("sha", F.lit("").alias("kept")).distinct())
    changed = written(changed.toDF(key, kept), "suffix-kept")
    name = F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256) if by_text else F.col("doc_id")
    joined = docs.withColumn(own, name).join(changed, F.col(own) == F.col(key), "left")
    return joined.select(*[F.coalesce(F.col(kept), F.col("text")).alias("text") if c == "text" else F.col(c) for c in docs.columns])


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is removed of all documents."""
    rows = removal_report(table(spark, sf_dir, "documents"))
    return rows.withColumn("doc_id", F.col("doc_id").cast("long"))
