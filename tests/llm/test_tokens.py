"""Token files, token counts and the transducer against the libraries."""

import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from scholia.llm import sentencepiece_fst, token_counts, token_output
from scholia.llm.registry import QUERIES
from scholia.llm.wordcache import LengthCounter, WordEncoder

from .conftest import SF, texts_of

WORD, BYTE, PIECE = (public_tokenizers.path(x) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
SOME = st.lists(st.sampled_from(list("abehinorst.,'!?|#0129 \n\t\x1cÀéßΣİ中▁ ") + ["́", "\U0001f600", "the ", "The", "<|endoftext|>", "<0x0A>"]), max_size=60).map("".join)


WORDS = Tokenizer.from_file(WORD)


def ids_of(text):
    return WORDS.encode(text, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(WORD), WordEncoder(WORD), Tokenizer.from_file(BYTE), LengthCounter(BYTE, {}), sentencepiece.SentencePieceProcessor(model_file=PIECE), sentencepiece_fst.Transducer(PIECE)


@settings(max_examples=400, deadline=None)
@given(text=SOME)
def test_caches_are_exact(libraries, text):
    word, own_word, byte, own_byte, piece, own_piece = libraries
    flat, at = own_word.encode(pa.array(["a, B.", text, ""]))
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [word.encode(t, add_special_tokens=False).ids for t in ("a, B.", text, "")]
    assert own_byte.count(text) == len(byte.encode(text, add_special_tokens=False).ids)
    ids = piece.encode(text)
    assert np.frombuffer(own_piece.encode(text), "<u4").tolist() == ids
    assert own_piece.decode(ids) == piece.decode(ids)


def made_model(path, kind, bytes_, charsmap, fold, prefix=True):
    """A small model made by hand: no training, just pieces and scores."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if bytes_ else [])
    names = ["▁", "a", "b", "e", "t", "h", "▁t", "th", "he", "the", "▁the", "ab", "ba", "aba", "▁a", "▁ab", "É", "é", "1", "fi", "bab"]
    pieces += [(x, -1.0 - 0.37 * i % 3 - len(names) / (10 + len(x)), 1) for i, x in enumerate(names)]
    for name, score, type_ in pieces:
        model.pieces.add(piece=name, score=score, type=type_)
    model.trainer_spec.model_type, model.trainer_spec.byte_fallback, model.trainer_spec.vocab_size = kind, bytes_, len(pieces)
    spec = model.normalizer_spec
    spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, spec.name = prefix, fold, True, "own"
    if charsmap:
        rules = sentencepiece_model_pb2.ModelProto.FromString(sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc_cf").serialized_model_proto())
        spec.precompiled_charsmap = rules.normalizer_spec.precompiled_charsmap
    path.write_bytes(model.SerializeToString())
    return str(path)


ODD = st.lists(st.sampled_from(list("abthe 1ÉéßΣ中▁ﬁＡ①\t\n　") + ["́", "\U0001f600", "the ", "  "]), max_size=25).map("".join)


@pytest.mark.parametrize(("kind", "bytes_", "charsmap", "fold"), [(1, True, True, True), (1, False, False, False), (1, False, True, False), (1, True, False, True), (2, True, True, True)])
def test_machines_of_other_models(tmp_path, kind, bytes_, charsmap, fold):
    """Unigram weights, character maps, folded spaces and unknown characters, against the library."""
    path = made_model(tmp_path / "m.model", kind, bytes_, charsmap, fold)
    library, own = sentencepiece.SentencePieceProcessor(model_file=path), sentencepiece_fst.Transducer(path)

    @settings(max_examples=300, deadline=None)
    @given(text=ODD)
    def same(text):
        assert np.frombuffer(own.encode(text), "<u4").tolist() == library.encode(text)

    same()


def test_shortest_path_is_the_least_sum(tmp_path):
    """Against all segmentations of short inputs."""
    own = sentencepiece_fst.Transducer(made_model(tmp_path / "m.model", 1, False, False, False))

    def all_ways(text):
        if not text:
            yield []
        for k in range(1, len(text) + 1):
            if text[:k] in own.weights or k == 1:
                yield from ([text[:k], *rest] for rest in all_ways(text[k:]))

    for text in ("▁thetheab", "babaabab", "▁▁ab中aba", "hehethe"):
        cost = lambda way: sum(float(own.weights.get(x, own.unknown_weight)) for x in way)
        assert cost(own.shortest(text)) == pytest.approx(min(map(cost, all_ways(text))), abs=1e-4)


def test_cache_forgets(libraries):
    small = WordEncoder(WORD, most_bytes=150_000)
    texts = [f"w{i} x{i * 7} the Stem{'abcdefghij'[i % 10] * (i % 7)}. stem, ." for i in range(2000)]
    for i in range(0, 2000, 20):
        flat, at = small.encode(pa.array(texts[i : i + 20]))
        assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [libraries[0].encode(t, add_special_tokens=False).ids for t in texts[i : i + 20]]
    assert small.held() < 400_000


def test_white_space_is_that_of_split():
    codes = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    split = pc.utf8_split_whitespace(pa.array([f"a{chr(c)}b" for c in codes])).to_pylist()
    assert all(own == f"a{chr(c)}b".split() for c, own in zip(codes, split))


def test_token_query(spark):
    """The registered query against the library, place by place."""
    rows = {r.doc_id: r for r in QUERIES["op1_token_output"](spark, SF).collect()}
    start = 0
    for doc_id, text in sorted(texts_of(spark.read.parquet(f"{SF}/documents.parquet"))):
        ids = ids_of(text) + [2]
        assert (rows[doc_id].start, rows[doc_id].n_tokens, rows[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_count_query(spark):
    library = Tokenizer.from_file(BYTE)
    texts = dict(texts_of(spark.read.parquet(f"{SF}/documents.parquet")))
    rows = QUERIES["op8_token_counts"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


def check_files(spark, docs, tmp_path):
    folder = str(tmp_path / "ids")
    token_output.write_tokens(docs, folder, WORD, 2)
    rows = token_output.checksums(token_output.read_tokens(spark, folder)).orderBy("start").collect()
    hashed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("h", F.xxhash64("text")).collect()
    own = sorted(hashed, key=lambda r: (r[0] is not None, r[0] or 0, r.h, r.text))
    start = 0
    assert len(rows) == len(own)
    for r, (doc_id, text, _) in zip(rows, own):
        ids = ids_of(text) + [2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return folder


def test_token_files(spark, odd_docs, tmp_path):
    folder = check_files(spark, odd_docs, tmp_path)
    plan = token_output.read_tokens(spark, folder).select("doc_id", "n_tokens")._jdf.queryExecution().executedPlan().toString()
    assert "ids" not in plan.split("ReadSchema")[1].splitlines()[0]


def test_token_files_layout(spark, tmp_path):
    import glob

    import pyarrow.parquet as pq

    folder = check_files(spark, spark.read.parquet(f"{SF}/documents.parquet"), tmp_path)
    meta = pq.ParquetFile(glob.glob(f"{folder}/*.parquet")[0]).metadata
    column = next(meta.row_group(0).column(i) for i in range(meta.num_columns) if meta.row_group(0).column(i).path_in_schema.startswith("ids"))
    assert "DELTA_BINARY_PACKED" in column.encodings and column.has_offset_index


def test_token_files_empty(spark, no_docs, tmp_path):
    check_files(spark, no_docs, tmp_path)


def test_token_counts(spark, odd_docs, no_docs):
    library = Tokenizer.from_file(BYTE)
    for docs in (odd_docs, no_docs, spark.read.parquet(f"{SF}/documents.parquet")):
        rows = sorted(map(tuple, token_counts.token_counts(docs, BYTE).collect()), key=str)
        own = [(i, len(t.encode()), n := len(library.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts_of(docs)]
        assert rows == sorted(own, key=str)


def test_pieces(spark, odd_docs, no_docs):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    for docs in (odd_docs, no_docs):
        rows = sentencepiece_fst.encoded(docs, PIECE)
        assert sorted(([r.doc_id, r.piece_ids] for r in rows.collect()), key=str) == sorted(([i, library.encode(t)] for i, t in texts_of(docs)), key=str)
        back = sorted(map(tuple, sentencepiece_fst.decoded(rows, PIECE).collect()), key=str)
        assert back == sorted(((i, library.decode(library.encode(t))) for i, t in texts_of(docs)), key=str)


def test_pieces_query(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    texts = dict(texts_of(spark.read.parquet(f"{SF}/documents.parquet")))
    for r in QUERIES["op3_sentencepiece"](spark, SF).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_pieces, r.ids_crc32, r.round_trip) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), True)
