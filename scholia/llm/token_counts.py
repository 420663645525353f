"""Token counts from a broadcast table of frequent pre-token lengths and worker caches, without a shuffle."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, texts
from .wordcache import LengthCounter

#: The table's entries, and the documents (spread over the corpus) whose parts are counted to choose them. Both only
#: steer speed: a part that isn't in the table is encoded, so every count is that of the library.
FREQUENT, SAMPLE_DOCS = 50_000, 3_000
_counters: dict[tuple[str, int], LengthCounter] = {}


def frequent_lengths(docs: DataFrame, tokenizer: str, entries: int = FREQUENT, sample_docs: int = SAMPLE_DOCS) -> dict[str, int]:
    """At most so many parts of sampled documents, the most frequent first, with their token counts."""
    total = docs.count()
    sample = docs.select("text").where(F.col("text").isNotNull()).sample(min(1.0, sample_docs / max(1, total)), seed=8)

    def tally(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(LengthCounter.parts(text))
            if len(seen) > 8 * entries:
                seen = Counter(dict(seen.most_common(2 * entries)))
        best = seen.most_common(entries)
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in best], pa.string()), pa.array([v for _, v in best], pa.int64())], ["part", "n"])

    merged: Counter[str] = Counter()
    for row in sample.mapInArrow(tally, "part string, n long").toLocalIterator():
        merged[row[0]] += row[1]
        if len(merged) > 8 * entries:
            merged = Counter(dict(merged.most_common(2 * entries)))
    lengths = LengthCounter(tokenizer, {})
    return {part: lengths[part] for part, _ in merged.most_common(entries) if not lengths.odd.search(part)}


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit of every whole text (null: empty, which has no tokens).

    The tokenizers library's counts, without added special tokens; its special strings inside a text count as it
    takes them. Rows keep their partitions: the pass is one map over the table. Null and repeated ids and repeated rows
    stay as they are; no rows give no rows.
    """
    prepare(docs.sparkSession)
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, tokenizer))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (tokenizer, id(frequent.value))
        if key not in _counters:
            _counters.clear()
            _counters[key] = LengthCounter(tokenizer, frequent.value)
        counter = _counters[key]
        for batch in batches:
            parts = batch.column("text").to_pylist()
            n = np.array([counter.count(text) for text in parts], np.int64)
            n_bytes = pa.array([len(text.encode()) for text in parts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), n_bytes, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of every text of documents by byte_bpe_50k."""
    import public_tokenizers

    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
