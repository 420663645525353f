"""Token ids in Parquet files, in ascending doc_id order, and selective reads of them."""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import prepare, shared_folder, table, texts
from .wordcache import WordEncoder

SCHEMA = "part int, doc_id long, local_start long, n_tokens int, ids array<int>"
#: Delta-packed ids without a dictionary (a vocabulary fills it at once), row groups of 32 MB, pages of 128 KB with
#: the column and offset indexes that Parquet's writer adds; doc_id and the counts keep their dictionaries or deltas.
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "PARQUET_2_0",
    "parquet.enable.dictionary#ids.list.element": "false",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(128 << 10),
    "parquet.page.row.count.limit": "2000",
}
#: Files whose first places are broadcast at most (12 bytes each).
FILES = 1_000_000
_encoders: dict[str, WordEncoder] = {}


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Encode every whole text (null: empty), append end_id, and write the ids to folder.

    Files hold doc_id ranges in ascending order (null ids first, equal ids in the order of a hash of their texts), and
    every row its place within its file, so that places in the whole corpus need one number per file. Repeated rows are
    rows of their own. No rows give files without rows.
    """
    prepare(docs.sparkSession)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, start = _encoder(tokenizer), TaskContext.get().partitionId(), 0
        for batch in batches:
            flat, at = encoder.encode(batch.column("text"))
            at = at + np.arange(len(at))  # one end id after each text
            ids = np.full(at[-1], end_id, np.int32)
            own = np.ones(len(ids), bool)
            own[at[1:] - 1] = False
            ids[own] = flat.view(np.int32)
            n = np.diff(at)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(n), part, np.int32)), batch.column("doc_id").cast(pa.int64()), pa.array(start + at[:-1]), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))],
                ["part", "doc_id", "local_start", "n_tokens", "ids"],
            )
            start += int(at[-1])

    # Rows of one id are many at most where ids are null or repeated; the texts' hash parts them.
    ordered = texts(docs).withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    ordered.select("doc_id", "text").mapInArrow(encode, SCHEMA).write.options(**LAYOUT).parquet(folder)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of each document; columns and rows that aren't asked for aren't read.

    The files' first places are the running total of one row per file, broadcast up to FILES of them. Null ids are
    read as they were written; a folder without rows gives no rows.
    """
    rows = spark.read.schema(SCHEMA).parquet(folder)
    files = rows.groupBy("part").agg(F.sum(F.col("n_tokens").cast("long")).alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    files = F.broadcast(files) if rows.select("part").distinct().count() <= FILES else files
    return rows.join(files, "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def checksums(rows: DataFrame) -> DataFrame:
    """Replace ids by the unsigned crc32 of them as little-endian unsigned 32-bit integers."""

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            flat, at = memoryview(ids.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B"), (ids.offsets.to_numpy().astype(np.int64) * 4).tolist()
            crc = pa.array([zlib.crc32(flat[a:b]) for a, b in zip(at, at[1:])], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), batch.column("n_tokens"), crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of documents to word_bpe_49k ids and end id 2, written, read back and summed up."""
    import public_tokenizers

    folder = shared_folder(spark, "token-ids")
    write_tokens(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    return checksums(read_tokens(spark, folder))
