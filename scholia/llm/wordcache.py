"""Bounded caches of what a public tokenizer gives for parts of a text that it always treats alone."""

from __future__ import annotations

import os
import re
from itertools import islice, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Entries of one worker's cache, and how many of the first seen (the most frequent, mostly) outlive a clearing.
BOUND, STAY = 1_200_000, 200_000
#: Bytes that one worker's stems take at most, with the columns they are kept in.
WORD_BYTES = 96 << 20
#: Letters that have lower-case forms of one letter and are in normal form C.
PLAIN = re.compile("[A-Za-zªµºÀ-ÖØ-öø-\u012f]+")


class Bounded(dict):
    """A dict that forgets its later entries when full."""

    bound, stay = BOUND, STAY

    def room(self) -> None:
        if len(self) >= self.bound:
            for key in list(islice(self, self.stay, None)):
                del self[key]


class WordEncoder:
    """Ids of white-space-delimited words, for tokenizers with word ends, kept in columns.

    The tokenizer drops white space, lower-cases, and lets no match cross white space or go from letters to
    punctuation, so words are encoded alone and joined, a word of letters in lower case and without the stop or comma
    at its end (its stem). Texts with the special strings or with separators on which libraries differ are encoded
    whole. Stems are bounded in bytes; when they are full, the first half stays, which has the frequent ones.
    """

    def __init__(self, path: str, most_bytes: int = WORD_BYTES):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        # The same merges for stems that are normal already and hold letters only.
        self.stems = Tokenizer(self.tokenizer.model)
        self.stems.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for piece, i in vocabulary.items() if piece.endswith("</w>")]] = True
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join(["[\x1c-\x1fΣ]", *map(re.escape, special)])
        self.tails = {tail: np.frombuffer(self.whole(tail), "<u4") for tail in ".,"}
        self.most_bytes = most_bytes
        self.rows: dict[str, int] = {"": 0}
        self.starts, self.sizes, self.ids = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), np.zeros(1 << 14, "<u4")
        self.n_ids = self.text_bytes = 0

    def held(self) -> int:
        """About how many bytes the stems take."""
        return self.text_bytes + 170 * len(self.rows) + self.ids.nbytes + self.starts.nbytes + self.sizes.nbytes

    def room(self) -> None:
        if self.held() > self.most_bytes:
            self.rows = dict(islice(self.rows.items(), 1 + len(self.rows) // 2))
            self.text_bytes = sum(map(len, self.rows))
            self.n_ids = int(self.starts[len(self.rows) - 1] + self.sizes[len(self.rows) - 1])
            self.starts, self.sizes, self.ids = self.starts[: len(self.rows)].copy(), self.sizes[: len(self.rows)].copy(), self.ids[: self.n_ids].copy()

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, stems: list[str]) -> None:
        """Enter new stems, those of letters encoded together."""
        letters = [stem for stem in stems if PLAIN.fullmatch(stem)]
        known: dict[str, bytes] = {}
        if letters:
            ids = np.array(self.stems.encode_batch_fast([" ".join(letters)], add_special_tokens=False)[0].ids, "<u4")
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) == len(letters):
                flat, at = ids.tobytes(), [0, *(4 * cuts).tolist()]
                known = {stem: flat[a:b] for stem, a, b in zip(letters, at, at[1:])}
        found = [known[stem] if stem in known else self.whole(stem) for stem in stems]
        first, last = len(self.rows), len(self.rows) + len(stems)
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        flat = np.frombuffer(b"".join(found), "<u4")
        if last > len(self.starts):
            more = last + last // 4 - len(self.starts)
            self.starts, self.sizes = np.pad(self.starts, (0, more)), np.pad(self.sizes, (0, more))
        if self.n_ids + len(flat) > len(self.ids):
            self.ids = np.pad(self.ids, (0, self.n_ids + 2 * len(flat) - len(self.ids)))
        self.starts[first:last] = self.n_ids + np.cumsum(sizes) - sizes
        self.sizes[first:last] = sizes
        self.ids[self.n_ids : self.n_ids + len(flat)] = flat
        self.n_ids += len(flat)
        self.rows.update(zip(stems, range(first, last)))
        self.text_bytes += sum(map(len, stems))

    def encode(self, column: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a column in a row, and where each text's own ids start (and the last one's end)."""
        self.room()
        odd = pc.match_substring_regex(column, self.odd)
        some_odd = pc.any(odd).as_py()
        split = pc.utf8_split_whitespace(pc.if_else(odd, "", column) if some_odd else column)
        words = split.flatten().dictionary_encode()
        plain = words.dictionary
        tailed = pc.match_substring_regex(plain, f"{PLAIN.pattern[:-1]}[.,]$")
        stems = pc.if_else(tailed, pc.utf8_slice_codeunits(plain, 0, -1), plain)
        coded = pc.if_else(pc.match_substring_regex(stems, f"^{PLAIN.pattern}$"), pc.utf8_lower(stems), stems).dictionary_encode()
        own = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        rows = np.fromiter(map(self.rows.get, own, repeat(-1)), np.int64, len(own))
        new = np.flatnonzero(rows < 0)
        if len(new):
            first = len(self.rows)
            self.learn([own[i] for i in new.tolist()])
            rows[new] = np.arange(first, first + len(new))
        at_word = words.indices.to_numpy()
        row = rows[coded.indices.to_numpy()][at_word]
        stop = np.where(tailed.to_numpy(zero_copy_only=False), np.where(pc.ends_with(plain, ".").to_numpy(zero_copy_only=False), 1, 2), 0)[at_word]
        n = self.sizes[row].astype(np.int64)
        ends = np.cumsum(n)
        flat = self.ids[np.repeat(self.starts[row] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]
        flat, ends = self.with_tails(flat, ends, stop)
        at = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        if some_odd:
            parts = [flat[a:b] for a, b in zip(at, at[1:])]
            for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)).tolist():
                parts[i] = np.frombuffer(self.whole(column[i].as_py()), "<u4")
            flat, at = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return flat, at

    def with_tails(self, flat: np.ndarray, ends: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words' ids with those of a stop (1) or comma (2) after them, and the words' new ends."""
        sizes = np.array([0, len(self.tails["."]), len(self.tails[","])])[stop]
        more = np.cumsum(sizes)
        out = np.empty(len(flat) + (more[-1] if len(more) else 0), "<u4")
        own = np.ones(len(out), bool)
        for kind, tail in enumerate((".", ","), 1):
            last = (ends + more)[stop == kind]
            for k, i in enumerate(self.tails[tail][::-1].tolist(), 1):
                out[last - k] = i
                own[last - k] = False
        out[own] = flat
        return out, ends + more


class LengthCounter(Bounded):
    """Token counts of the parts of a text between single spaces, for byte-level tokenizers.

    Every match starts at a space before a non-space or ends before one, so a cut before such a space changes
    nothing. Texts where a space follows and precedes white space, and those with special strings, are
    encoded whole.
    """

    def __init__(self, path: str, frequent: dict[str, int]):
        from tokenizers import Tokenizer

        super().__init__(frequent)
        self.stay = max(STAY, len(frequent))
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([r"\s (?:\s|\Z)", *map(re.escape, special)]))

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def __missing__(self, part: str) -> int:
        if len(part) > 2 and part[-1] in ".," and PLAIN.match(part[-2]):
            n = self[part[:-1]] + 1
        else:
            n = self.whole(part)
        self[part] = n
        return n

    @staticmethod
    def parts(text: str) -> list[str]:
        head, *rest = text.split(" ")
        return [*([head] if head else []), *map(" ".__add__, rest)]

    def count(self, text: str) -> int:
        self.room()
        if self.odd.search(text):
            return self.whole(text)
        return sum(map(self.__getitem__, self.parts(text)))
