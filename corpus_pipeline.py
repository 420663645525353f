"""The corpus pipeline: stages over documents, each written as Parquet and read again as the next one's input.

Documents that the quality classifier rejects go; one document of each group of near-duplicates stays; byte strings of
200 and more that occur again are cut out; sources are mixed to their target weights, a document as often as the mix
takes it; the last stage gives each remaining row's SentencePiece ids.

Every stage keeps all columns of documents, by whatever names, and gives no rows for no rows. Null texts count as empty;
what nulls, repeated ids and repeated rows mean is said at each stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from scholia.llm import mixing, near_dedup, quality, sentencepiece_fst, suffix_dedup
from scholia.llm.common import table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, learnt from labels, accepts; each row by its own text, so null and repeated ids stay."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near-duplicates, and one of each repeated id; rows with a null id stay."""
    return near_dedup.one_of_each(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated byte strings; null texts stay null, rows with null or repeated ids are told apart by their texts."""
    return suffix_dedup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them; a null source is one, repeated rows count each, rows without words stay as often as the whole part of their rate says."""
    return mixing.mix_documents(docs)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and piece_ids of each row (none for a null or empty text)."""
    return sentencepiece_fst.encoded(docs, public_tokenizers.path("piece_bpe_32k.model"), "source", "lang")


STAGES = [
    ("quality classifier", keep_quality),
    ("near-duplicates", drop_near_duplicates),
    ("repeated strings", cut_repeats),
    ("source mix", mix_sources),
    ("SentencePiece ids", encode_pieces),
]
#: SQL can't express the classifier, the hashed rounding or the merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, applied to documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
