"""Whole texts to token ids with a public tokenizer file, each distinct word being encoded once per worker process.

The tokenizer drops white space before it merges, so a text's ids are those of its white-space-separated words, in
order. A word of Latin letters with at most one mark after it is one or two token groups by the tokenizer's own rule, so
its groups go straight to the library's model; other words go through the whole library in one long text, set apart by a
number character, which that tokenizer always makes a group of its own; words that hold the character itself, or ``<|``,
are encoded alone. A tokenizer for which the short way doesn't give the library's own ids takes the long way always.

Words that were met are remembered in two generations: when the younger one is full the older one is forgotten, so words
that come again stay and words that come once go.
"""

from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from sluicework.llm.common import dictionary, pieces, ranges, remembered, split_words

MARK = "௰"
#: Words of a generation that a worker process remembers; bytes of text that are encoded at once.
CACHE_WORDS, PIECE = 250_000, 8 << 20
_SHORT = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?]?)")
_PROBES = ["a", "Hello,", "StraßE!", "Éàÿ", "ÀÖØÞ;", "zürichsee.", "onoff?", "internationalisation:", "ñandú"]


def _byte_letters() -> dict[int, int]:
    """How byte-level tokenizers write bytes: printable ones as themselves, the others from U+0100 on, in order."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: 256 + i for i, b in enumerate(others)}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.mark = np.array(self._ids(MARK), np.uint32)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.letters, self.tails = _byte_letters(), {c: self._ids(c) for c in ".,;:!?"}
        self.short = True
        self.short = all((got := self._short_ids(w)) is not None and list(got) == self._ids(w) for w in _PROBES)

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _short_ids(self, word: str) -> array | None:
        parts = _SHORT.fullmatch(word) if self.short else None
        if parts is None:
            return None
        stem = parts[1].lower()
        if not stem.isascii():
            stem = stem.encode().decode("latin-1").translate(self.letters)
        ids = array("I", [t.id for t in self.tokenizer.model.tokenize(stem)])
        if parts[2]:
            ids.extend(self.tails[parts[2]])
        return ids

    def _encode_words(self, words: list[str]) -> None:
        others = []
        for w in words:
            if (ids := self._short_ids(w)) is not None:
                self.young[w] = ids.tobytes()
            elif MARK in w or "<|" in w:
                self.young[w] = np.array(self._ids(w), np.uint32).tobytes()
            else:
                others.append(w)
        for k in range(0, len(others), 2000):
            part = others[k : k + 2000]
            ids = np.array(self._ids(f" {MARK} ".join([*part, ""])), np.uint32)
            m = len(self.mark)
            hit = np.ones(max(len(ids) - m + 1, 0), bool)
            for j, x in enumerate(self.mark):
                hit &= ids[j : len(hit) + j] == x
            ends = np.flatnonzero(hit)
            start, raw = 0, ids.tobytes()
            if len(ends) != len(part):
                raise ValueError("the tokenizer doesn't keep the mark apart")
            for w, end in zip(part, ends.tolist(), strict=True):
                self.young[w] = raw[4 * start : 4 * end]
                start = end + m

    def _blobs(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes."""
        if len(self.young) > CACHE_WORDS:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        new = []
        for w in words:
            if w not in young:
                if (known := old.get(w)) is None:
                    new.append(w)
                else:
                    young[w] = known
        self._encode_words(new)
        return [young[w] for w in words]

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids, each text's followed by ``end_id``, and the offsets of each text."""
        ids, offsets, last = [np.zeros(0, np.uint32)], [np.zeros(1, np.int64)], 0
        for a, b in pieces(texts, PIECE):
            part, ends = self._encode_piece(texts.slice(a, b - a), end_id)
            ids.append(part)
            offsets.append(ends[1:] + last)
            last += len(part)
        return np.concatenate(ids), np.concatenate(offsets)

    def _encode_piece(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        words, offsets = split_words(texts)
        distinct, index = dictionary(words)
        blobs = self._blobs(distinct)
        lengths = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        table = np.frombuffer(b"".join(blobs), np.uint32)
        starts = np.cumsum(lengths) - lengths
        del distinct, blobs, words
        n = lengths[index]
        ends = np.concatenate([[0], np.cumsum(n)])[offsets[1:]] + np.arange(1, len(texts) + 1)
        out = np.empty(int(n.sum()) + len(texts), np.uint32)
        body = np.ones(len(out), bool)
        body[ends - 1] = False
        out[body] = table[ranges(starts[index], n)]
        out[~body] = end_id
        return out, np.concatenate([[0], ends])


@remembered
def encoder(path: str) -> WordEncoder:
    """One per worker process."""
    return WordEncoder(path)


def ids_crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4", copy=False).tobytes())
