"""SentencePiece encoding and decoding with a weighted finite-state transducer.

The model file gives three machines. The normaliser rewrites the longest match of its character map at each place (an
identity where there is none), drops or folds spaces as the model says, and marks the start and each space with the word
mark. The piece machine is a trie that reads characters and writes pieces. The byte machine reads a character that no
piece covers and writes its bytes, or the unknown piece. Composed with an input, the two give a lattice of its places,
whose tropical shortest path (the least sum of weights; of equals the one found first) is the outcome.

Weights of a unigram model are the pieces' negative scores, with a penalty for unknown characters. A merge (BPE) model
isn't a sum of scores: its outcome is decided by the order of merges. There the machine's states are the piece last
written, and the arc from piece a to piece b weighs 0 where merging a's and b's characters together gives a and b again,
and infinity otherwise; the only path of finite weight is the merges' own outcome, and it is searched depth first. Arcs
are compiled when an input first needs them and kept. No piece goes on after a word mark that follows other characters,
so a text is the concatenation of its words' inputs, and words that were composed before are taken from a bounded cache.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import prepare, table, texts
from .wordcache import Bounded

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, MERGES = 1, 2
#: What an unknown character costs beyond the worst piece.
PENALTY = 10.0
_machines: dict[str, "Transducer"] = {}


class Charsmap:
    """The normaliser's character map: a double array trie of byte strings, and what they are rewritten to."""

    def __init__(self, blob: bytes):
        n = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + n], "<u4").tolist()
        self.texts = blob[4 + n :]
        self.known: dict[bytes, bytes | None] = {}

    @staticmethod
    def _offset(unit: int) -> int:
        return (unit >> 10) << ((unit & 512) >> 6)

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """The longest match at a place: how many bytes it reads, and what it writes."""
        found, node = None, self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node] if node < len(self.units) else 0
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.texts[found[1] : self.texts.index(b"\0", found[1])]

    def rewritten(self, text: str) -> str:
        """The text with the longest match at each place rewritten, characters without one as they are."""
        data, out, at = text.encode(), [], 0
        while at < len(data):
            match = self.longest(data, at)
            if match is None:
                first = data[at]
                size = 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                match = size, data[at : at + size]
            out.append(match[1])
            at += match[0]
        return b"".join(out).decode("utf-8", "replace")


class Transducer(Bounded):
    """Little-endian unsigned 32-bit ids of each word (a run of word marks and what follows up to the next)."""

    bound, stay = 500_000, 100_000
    most_arcs = 1_000_000

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        self.kind = model.trainer_spec.model_type
        if self.kind not in (UNIGRAM, MERGES) or model.trainer_spec.treat_whitespace_as_suffix or not model.normalizer_spec.escape_whitespaces or any(p.type == DEFINED for p in model.pieces):
            raise ValueError("a unigram or merge model with word marks before words and no pieces of the user's is needed")
        self.prefix = model.normalizer_spec.add_dummy_prefix
        self.fold = model.normalizer_spec.remove_extra_whitespaces
        self.charsmap = Charsmap(model.normalizer_spec.precompiled_charsmap) if model.normalizer_spec.precompiled_charsmap else None
        self.names = [p.piece for p in model.pieces]
        self.kinds = [p.type for p in model.pieces]
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.order = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        if any(MARK in name.lstrip(MARK) for name in self.ids):
            raise ValueError("a piece goes on after an inner word mark")
        self.weights = {piece: np.float32(-score) for piece, score in self.order.items()}
        self.unknown_weight = np.float32(-min(self.order.values(), default=0.0)) + np.float32(PENALTY)
        self.unknown = self.kinds.index(UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.byte_ids = frozenset(self.bytes.values())
        self.shown = [{UNKNOWN: " ⁇ ", CONTROL: ""}.get(kind, name) for name, kind in zip(self.names, self.kinds)]
        self.raw = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        # Of each string that a piece is or begins with: 1 for a piece, 2 if a longer one begins with it.
        self.table = dict.fromkeys(self.ids, 1)
        for piece in self.ids:
            for k in range(1, len(piece)):
                self.table[piece[:k]] = self.table.get(piece[:k], 0) | 2
        self.arcs: dict[str, dict[str, bool]] = {}  # whether a piece agrees with the one before it, by that one
        self.n_arcs = 0
        self.words = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")

    def normalise(self, text: str) -> str:
        """What the normaliser writes for a text."""
        text = self.charsmap.rewritten(text) if self.charsmap else text
        if self.fold:
            text = re.sub(" +", " ", text).strip(" ")
        text = (MARK if self.prefix and text else "") + text.replace(" ", MARK)
        return text.rstrip(MARK) if self.fold else text  # marks at the end count as spaces there

    def lattice(self, text: str, i: int) -> Iterator[tuple[str, np.float32]]:
        """The arcs that leave place i of the composition: what they read, shortest first, and their weights.

        A character that is no piece has the arc of the byte machine, after the others.
        """
        j, whole = i, False
        while j < len(text):
            j += 1
            piece = text[i:j]
            kind = self.table.get(piece, 0)
            if kind & 1:
                whole |= j == i + 1
                yield piece, self.weights[piece]
            if kind < 2:
                break
        if not whole:
            yield text[i], self.unknown_weight

    def shortest(self, text: str) -> list[str]:
        """The pieces of the tropical shortest path, in single precision as the model's own weights are.

        Sums start anew with each word; paths that differ by rounding alone may be told apart otherwise than by the library.
        """
        best: list[np.float32 | None] = [np.float32(0)] + [None] * len(text)
        back = [0] * (len(text) + 1)
        for i in range(len(text)):
            if best[i] is None:
                continue
            for piece, weight in self.lattice(text, i):
                j, total = i + len(piece), best[i] + weight
                if best[j] is None or total < best[j]:
                    best[j], back[j] = total, i
        out, j = [], len(text)
        while j:
            out.append(text[back[j] : j])
            j = back[j]
        return out[::-1]

    def merged(self, text: str) -> list[str]:
        """The pieces that the merge order makes of a short text: best score first, leftmost of equals."""
        parts = list(text)
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.order.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def agrees(self, last: str, piece: str) -> bool:
        """Whether merging the characters of both gives both again; after "", whether a piece's own give it."""
        row = self.arcs.get(last)
        found = None if row is None else row.get(piece)
        if found is None:
            found = self.merged(last + piece) == ([last, piece] if last else [piece])
            if self.n_arcs >= self.most_arcs:
                self.arcs.clear()
                self.n_arcs = 0
            self.arcs.setdefault(last, {})[piece] = found
            self.n_arcs += 1
        return found

    def path(self, word: str) -> list[str]:
        """The shortest path through the composition of word with the piece machine, as its pieces.

        All finite arcs weigh 0 and one path is finite, so states are visited depth first, the longest piece first, and
        only as far as needed; a place has one piece that can end there, so a place left once isn't entered again.
        """
        n, table, agrees = len(word), self.table, self.agrees
        found: list[str] = []
        untried: list[list[str]] = []  # pieces that start at the end of found[:k], longest last
        left, i, last = set(), 0, ""
        while i < n:
            if len(untried) == len(found):
                ways, j = [], i
                while j < n:
                    j += 1
                    piece = word[i:j]
                    kind = table.get(piece, 0)
                    if kind & 1 or j == i + 1:
                        ways.append(piece)
                    if kind < 2:
                        break
                untried.append(ways)
            ways, row = untried[-1], self.arcs.get(last) or {}
            while ways:
                piece = ways.pop()
                if i + len(piece) in left:
                    continue
                known = row.get(piece)
                if agrees(last, piece) if known is None else known:
                    found.append(piece)
                    i, last = i + len(piece), piece
                    break
            else:
                left.add(i)
                untried.pop()
                i -= len(found.pop())
                last = found[-1] if found else ""
        return found

    def __missing__(self, word: str) -> bytes:
        if len(word) > 64:
            return self.composed(word)
        found = None
        if self.kind == MERGES and len(word) > 2 and word[-1] in ".," and word[-2] != MARK:
            # The path to the last character is the stem's own, and the mark as a rule agrees with its end.
            stem = self[word[:-1]]
            last = int.from_bytes(stem[-4:], "little")
            if self.kinds[last] == NORMAL and word[-1] in self.raw and self.agrees(self.names[last], word[-1]):
                found = stem + self.raw[word[-1]]
        self[word] = found = self.composed(word) if found is None else found
        return found

    def composed(self, word: str) -> bytes:
        """The ids that the composition of the machines with a word writes along its shortest path."""
        pieces, raw = self.shortest(word) if self.kind == UNIGRAM else self.path(word), self.raw
        try:
            return b"".join([raw[piece] for piece in pieces])
        except KeyError:  # characters without a piece
            own: list[int] = []
            for piece in pieces:
                if piece in self.ids:
                    own.append(self.ids[piece])
                elif self.bytes:
                    own += [self.bytes[b] for b in piece.encode()]
                elif not own or own[-1] != self.unknown:  # a run of unknown characters is one piece
                    own.append(self.unknown)
            return np.array(own, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        self.room()
        return b"".join(map(self.__getitem__, self.words.findall(self.normalise(text))))

    def decode(self, ids: Iterable[int]) -> str:
        """The inverse machine: pieces and bytes to characters, word marks to spaces, without the mark at the start."""
        if self.byte_ids.isdisjoint(ids):
            text = "".join(map(self.shown.__getitem__, ids))
            return (text[1:] if self.prefix and text.startswith(MARK) else text).replace(MARK, " ")
        out: list[str] = []
        held = bytearray()
        for i in ids:
            kind = self.kinds[i]
            if kind == BYTE:
                held.append(int(self.names[i][3:5], 16))
                continue
            if held:
                out.append(held.decode("utf-8", "replace"))
                held.clear()
            out.append(self.shown[i])
        if held:
            out.append(held.decode("utf-8", "replace"))
        text = "".join(out)
        return (text[1:] if self.prefix and text.startswith(MARK) else text).replace(MARK, " ")


def _machine(path: str) -> Transducer:
    if path not in _machines:
        _machines[path] = Transducer(path)
    return _machines[path]


def encoded(docs: DataFrame, model: str, *keep: str) -> DataFrame:
    """doc_id, the columns keep and piece_ids (array of int) of every whole text (null: empty, no pieces), in one map.

    Null and repeated ids and repeated rows stay as they are; no rows give no rows.
    """
    prepare(docs.sparkSession)
    rows = texts(docs, *keep).select("doc_id", *keep, "text")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model)
        for batch in batches:
            flat = [machine.encode(x) for x in batch.column("text").to_pylist()]
            at = np.concatenate([[0], np.cumsum([len(x) // 4 for x in flat])]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(at), pa.array(np.frombuffer(b"".join(flat), "<u4").view(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*batch.schema.names[:-1], "piece_ids"])

    return rows.mapInArrow(run, f"{kinds}, piece_ids array<int>")


def decoded(rows: DataFrame, model: str) -> DataFrame:
    """doc_id and text of rows with piece_ids (null: null); null and repeated ids stay, no rows give no rows."""
    prepare(rows.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x is None else machine.decode(x) for x in batch.column("piece_ids").to_pylist()], pa.string())], ["doc_id", "text"])

    return rows.select("doc_id", "piece_ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: pieces, the ids' crc32 (little-endian unsigned 32-bit), the decoded text's bytes and whether it is
    the document's text (a word mark in a text comes back as a space)."""
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = encoded(table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce("text", F.lit("")).alias("own")), path, "own")

    def digest(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = _machine(path)
        for batch in batches:
            lists, own = batch.column("piece_ids"), batch.column("own").to_pylist()
            flat, at = lists.values.to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy()
            parts = [flat[a:b] for a, b in zip(at, at[1:])]
            back = [machine.decode(x.tolist()) for x in parts]
            crc = [zlib.crc32(x.tobytes()) for x in parts]
            columns = [pa.array(map(len, parts), pa.int64()), pa.array(crc, pa.int64()), pa.array([len(x.encode()) for x in back], pa.int64()), pa.array([a == b for a, b in zip(back, own)])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), *columns], ["doc_id", "n_pieces", "ids_crc32", "n_bytes", "round_trip"])

    return rows.mapInArrow(digest, "doc_id long, n_pieces long, ids_crc32 long, n_bytes long, round_trip boolean")
