"""BPE encoding and decoding, long unsplit text being encoded in halves that are then joined.

A tokenizer splits a text into pretokens and merges letters within each. A long pretoken (a run of letters or marks
without a split) is cut into halves, down to leaves of ``LEAF`` letters; leaves are encoded on their own and joined
pairwise up the tree. A join encodes a window of ``w`` tokens on each side anew and doubles ``w`` until the window's first
token is the left side's and its last token the right side's, or that side is used up. That is exact: where merges are ordered (no merge
makes a part of an earlier one, which is checked when a tokenizer is loaded), a sequence of tokens is the encoding of its
text exactly if every two neighbours are the encoding of theirs, and with both ends of the window agreed, every two neighbours
come out of one encoding. A tokenizer without that property is given its pretokens whole.

Texts of up to ``LONG`` characters are encoded where they lie, without a shuffle; each distinct word is encoded once per worker
process where the tokenizer drops white space. Longer texts are cut into units (whole words, lists of pretokens, leaves of a
long pretoken of ``BLOCK`` letters) that any task may encode, and a document's units are joined again in one row.

Cases: null or empty text -> no ids, decoded to the empty text; texts of any length are whole; repeated rows keep their
number; null and equal ids are kept; an empty table gives an empty one; extra columns are ignored. Unknown ids decode to nothing, a null list to
null.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from sluicework.llm.common import give_back, pieces, ranges, remembered, text_array
from sluicework.llm.tokens import PIECE, WordEncoder, _byte_letters, default_tokenizer

#: Letters of a leaf; letters of a unit that travels; characters of a text that is cut into units; tokens of the first window.
LEAF, BLOCK, LONG, WINDOW = 2048, 1 << 16, 1 << 20, 4
#: Kinds of unit.
TEXT, PRETOKENS, OPEN, CLOSE, SPECIAL = range(5)


def ordered_merges(path: str) -> bool:
    """Whether no merge makes a part of an earlier merge."""
    with open(path, encoding="utf-8") as f:
        merges = json.load(f)["model"].get("merges", [])
    made: dict[str, int] = {}
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in merges]
    for rank, (a, b) in enumerate(pairs):
        made[a + b] = rank
    return all(made.get(a, -1) < rank and made.get(b, -1) < rank for rank, (a, b) in enumerate(pairs))


class TreeEncoder(WordEncoder):
    def __init__(self, path: str, leaf: int = LEAF):
        super().__init__(path)
        self.leaf = leaf
        self.model, self.bare = self.tokenizer.model, Tokenizer.from_file(path).model
        self.suffix = self.bare.end_of_word_suffix or ""
        self.bare.end_of_word_suffix = None
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.names: list[str | None] = [None] * (max(vocabulary.values(), default=-1) + 1)
        for name, i in vocabulary.items():
            self.names[i] = name
        self.alphabet = {chr(c) for c in (set(range(256)) - set(_byte_letters())) | set(_byte_letters().values())}
        added = list(self.tokenizer.get_added_tokens_decoder().values())
        self.special = re.compile("(" + "|".join(re.escape(t.content) for t in sorted(added, key=lambda t: -len(t.content))) + ")") if added else None
        # Added tokens that take white space or look at the normal form need the library's own search.
        self.splits = not any(t.single_word or t.lstrip or t.rstrip or t.normalized for t in added)
        known = all(c in vocabulary and c + self.suffix in vocabulary for c in self.alphabet)
        self.joins = known and self.splits and not self.bare.continuing_subword_prefix and not self.bare.dropout and ordered_merges(path)
        self.by_word = self._ids("a \t\nB. ") == self._ids("a") + self._ids("B.") and not self._ids(" \n")

    def pretokens(self, text: str) -> Iterator[str | int]:
        """The library's own pretokens of ``text``, and the ids of added tokens between them."""
        for part in self.special.split(text) if self.special else [text]:
            if self.special and self.special.fullmatch(part):
                yield self.tokenizer.token_to_id(part)
            elif part:
                normal = self.tokenizer.normalizer.normalize_str(part) if self.tokenizer.normalizer else part
                yield from (p for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal)) if self.tokenizer.pre_tokenizer else [normal]

    def leaf_ids(self, letters: str, last: bool) -> list[int]:
        return [t.id for t in (self.model if last else self.bare).tokenize(letters)]

    def join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """The ids of two neighbouring parts of a pretoken; ``last`` where the right one ends it."""
        w = WINDOW
        while left and right:
            a, b = left[-w:], right[:w]
            ends = last and w >= len(right)
            letters = "".join(self.names[i] for i in a + b)
            got = self.leaf_ids(letters[: len(letters) - len(self.suffix)] if ends else letters, ends)
            if (w >= len(left) or got[0] == a[0]) and (w >= len(right) or got[-1] == b[-1]):
                return left[: max(len(left) - w, 0)] + got + right[w:]
            w *= 2
        return left or right

    def tree(self, letters: str, last: bool = True) -> list[int]:
        """The ids of a pretoken, or of a part of one that ends it only if ``last``."""
        if len(letters) <= self.leaf:
            return self.leaf_ids(letters, last)
        half = len(letters) // 2
        return self.join(self.tree(letters[:half], False), self.tree(letters[half:], last), last)

    def concatenated(self, parts: list[list[int]], last: bool = True) -> list[int]:
        """The ids of a pretoken from those of its parts in order."""
        while len(parts) > 1:
            parts = [self.join(parts[i], parts[i + 1], last and i + 2 >= len(parts)) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
        return parts[0] if parts else []

    def may_join(self, letters: str) -> bool:
        return self.joins and self.alphabet.issuperset(letters)

    def pretoken_ids(self, letters: str) -> list[int]:
        return self.tree(letters) if len(letters) > self.leaf and self.may_join(letters) else self.leaf_ids(letters, True)

    def text_ids(self, text: str) -> list[int]:
        if not self.splits:
            return self._ids(text)
        out: list[int] = []
        for p in self.pretokens(text):
            if isinstance(p, int):
                out.append(p)
            else:
                out += self.pretoken_ids(p)
        return out

    def _blobs(self, words: list[str]) -> list[bytes]:
        """The ids of each word, as bytes; long words are not remembered."""
        short = iter(super()._blobs([w for w in words if len(w) <= self.leaf]))
        return [np.array(self.text_ids(w), np.uint32).tobytes() if len(w) > self.leaf else next(short) for w in words]

    def lists(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and the offsets of each text's."""
        if self.by_word:
            ids, offsets = self._encode_piece(texts, 0)
            body = np.ones(len(ids), bool)
            body[offsets[1:] - 1] = False
            return ids[body], offsets - np.arange(len(offsets))
        found = [self.text_ids(t) for t in texts.to_pylist()]
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in found], dtype=np.int64)]).astype(np.int64)
        return np.array([i for x in found for i in x], np.uint32), offsets

    def units(self, text: str, block: int) -> Iterator[tuple[int, list[str]]]:
        """``text`` as units that are encoded apart, in order."""
        if not self.splits:
            yield TEXT, [text]
            return
        start, size = 0, len(text)
        space = re.compile(r"[\x20\x09-\x0D]+")
        while start < size and self.by_word:
            # As many whole words as fit, or the one word that does not.
            cut = start + block if start + block >= size or text[start + block] in " \t\n\v\f\r" else max(text.rfind(c, start, start + block) for c in " \t\n\v\f\r")
            if cut > start:
                yield TEXT, [text[start:cut]]
                start = cut
                continue
            end = found.start() if (found := space.search(text, start + 1)) else size
            yield from self._word_units(text[start:end], block)
            start = end
        if not self.by_word:
            yield from self._word_units(text, block)

    def _word_units(self, text: str, block: int) -> Iterator[tuple[int, list[str]]]:
        waiting, n = [], 0
        for p in self.pretokens(text):
            long = isinstance(p, str) and len(p) > block and self.may_join(p)
            if waiting and (isinstance(p, int) or long or n > block):
                yield PRETOKENS, waiting
                waiting, n = [], 0
            if isinstance(p, int):
                yield SPECIAL, [self.names[p]]
            elif long:
                cuts = list(range(0, len(p), block))
                yield from ((CLOSE if c == cuts[-1] else OPEN, [p[c : c + block]]) for c in cuts)
            else:
                waiting.append(p)
                n += len(p)
        if waiting:
            yield PRETOKENS, waiting

    def unit_ids(self, kind: int, unit: list[str]) -> list[int]:
        if kind == TEXT:
            return self.lists(pa.array(unit, pa.large_string()))[0].tolist()
        if kind == PRETOKENS:
            return [i for p in unit for i in self.pretoken_ids(p)]
        if kind == SPECIAL:
            return [self.tokenizer.token_to_id(unit[0])]
        return self.tree(unit[0], kind == CLOSE)


@remembered
def tree_encoder(path: str) -> TreeEncoder:
    return TreeEncoder(path)


class Decoder:
    """Ids to text. Without a decoder of its own, a tokenizer puts one blank between the names of the ids."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        names = [b""] * (max(vocabulary.values(), default=-1) + 2)
        for name, i in vocabulary.items():
            names[i] = name.encode() + b" "
        self.lengths = np.array([len(n) for n in names], np.int64)
        self.starts, self.table = np.cumsum(self.lengths) - self.lengths, np.frombuffer(b"".join(names), np.uint8)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> pa.Array:
        if self.tokenizer.decoder is not None:
            known = [[i for i in ids[a:b].tolist() if i < len(self.lengths)] for a, b in zip(offsets, offsets[1:], strict=False)]
            return pa.array(self.tokenizer.decode_batch(known, skip_special_tokens=False), pa.large_string())
        at = np.minimum(ids.astype(np.int64), len(self.lengths) - 1)
        n = self.lengths[at]
        text = self.table[ranges(self.starts[at], n)]
        ends = np.concatenate([[0], np.cumsum(n)])[offsets]
        # The blank after a text's last name goes.
        keep = np.ones(len(text), bool)
        some = ends[1:] > ends[:-1]
        keep[ends[1:][some] - 1] = False
        ends = ends - np.concatenate([[0], np.cumsum(some)])
        return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(text[keep]))


@remembered
def decoder(path: str) -> Decoder:
    return Decoder(path)


def _row_batch(doc_ids: pa.Array, ids: np.ndarray, offsets: np.ndarray, text: pa.Array | None) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
    columns = {"doc_id": doc_ids, "ids": lists} | ({} if text is None else {"decoded": text.cast(pa.string())})
    return pa.RecordBatch.from_pydict(columns)


def _encoded(docs: DataFrame, tokenizer: str, decoded: bool, long: int, block: int) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, ids array<int>" + (", decoded string" if decoded else "")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    is_long = F.char_length("text") > long

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back(keep=tree_encoder)
        encoder, names = tree_encoder(tokenizer), decoder(tokenizer) if decoded else None
        for batch in batches:
            texts = text_array(batch.column("text"))
            for a, b in pieces(texts, PIECE):
                ids, offsets = encoder.lists(texts.slice(a, b - a))
                yield _row_batch(batch.column("doc_id").slice(a, b - a), ids, offsets, names.decode(ids, offsets) if names else None)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tree_encoder(tokenizer)
        names = ["doc_id", "digest", "copies", "place", "kind", "unit"]
        for batch in batches:
            for r in range(batch.num_rows):
                text = batch.column("text")[r].as_py()
                digest, (doc_id, copies) = hashlib.sha256(text.encode()).digest(), (batch.column(c).slice(r, 1) for c in ("doc_id", "copies"))
                for place, (k, unit) in enumerate(encoder.units(text, block)):
                    columns = [doc_id, pa.array([digest], pa.binary()), copies, pa.array([place], pa.int64()), pa.array([k], pa.int32()), pa.array([unit], pa.list_(pa.string()))]
                    yield pa.RecordBatch.from_arrays(columns, names)

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tree_encoder(tokenizer)
        for batch in batches:
            found = [np.array(encoder.unit_ids(k, u), np.uint32).tobytes() for k, u in zip(batch.column("kind").to_pylist(), batch.column("unit").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "digest", "copies", "place", "kind")), pa.array(found, pa.binary())], ["doc_id", "digest", "copies", "place", "kind", "ids"])

    def joined(table: pa.Table) -> pa.Table:
        encoder = tree_encoder(tokenizer)
        table = table.sort_by("place")
        out, parts = [], []
        for k, blob in zip(table["kind"].to_pylist(), table["ids"].to_pylist(), strict=True):
            ids = np.frombuffer(blob, np.uint32)
            if k in (OPEN, CLOSE):
                parts.append(ids.tolist())
                if k == CLOSE:
                    out.append(np.array(encoder.concatenated(parts), np.uint32))
                    parts = []
            else:
                out.append(ids)
        ids = np.concatenate([*out, np.zeros(0, np.uint32)])
        offsets = np.array([0, len(ids)])
        one = _row_batch(table["doc_id"].combine_chunks().slice(0, 1), ids, offsets, decoder(tokenizer).decode(ids, offsets) if decoded else None)
        return pa.Table.from_batches([one] * table["copies"][0].as_py())

    # Equal rows are worked on once, so the key of a text is its id and its digest.
    alone = rows.where(is_long).groupBy("doc_id", "text").agg(F.count(F.lit(1)).alias("copies"))
    units = alone.mapInArrow(cut, f"doc_id {kind}, digest binary, copies long, place long, kind int, unit array<string>")
    ids = units.repartition("doc_id", "digest", "place").mapInArrow(coded, f"doc_id {kind}, digest binary, copies long, place long, kind int, ids binary")
    return rows.where(~is_long).mapInArrow(near, schema).unionByName(ids.groupBy("doc_id", "digest").applyInArrow(joined, schema))


def encode(docs: DataFrame, tokenizer: str, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids array<int>) of every text, as the library's ``encode(text, add_special_tokens=False)`` gives them."""
    return _encoded(docs, tokenizer, False, long, block)


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """``encoded`` with ``decoded`` in place of ``ids``, as the library's ``decode(ids, skip_special_tokens=False)`` gives it."""
    fields = [f for f in encoded.schema.fields if f.name not in ("ids", "decoded")]
    # Any name may come, also one that a function of batches could not refer to.
    others = [f"c{i}" for i in range(len(fields))]
    schema = T.StructType([*(T.StructField(c, f.dataType) for c, f in zip(others, fields, strict=True)), T.StructField("decoded", T.StringType())])
    rows = encoded.select(*[F.col("`" + f.name.replace("`", "``") + "`").alias(c) for c, f in zip(others, fields, strict=True)], "ids")

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = decoder(tokenizer)
        for batch in batches:
            lists = batch.column("ids")
            ids, offsets = lists.values.fill_null(-1).to_numpy(), lists.offsets.to_numpy().astype(np.int64)
            ids = np.where(ids < 0, len(names.lengths) - 1, ids)
            text = names.decode(ids[offsets[0] : offsets[-1]], offsets - offsets[0]).to_pylist()
            text = pa.array([t if ok else None for t, ok in zip(text, lists.is_valid().to_pylist(), strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in others), text], [*others, "decoded"])

    return rows.mapInArrow(apply, schema).toDF(*(f.name for f in fields), "decoded")


def encode_and_decode(docs: DataFrame, tokenizer: str, long: int = LONG, block: int = BLOCK) -> DataFrame:
    """(doc_id, ids, decoded): both ways in one pass over the texts."""
    return _encoded(docs, tokenizer, True, long, block)


def op11_bpe_tree(spark, sf_dir: str) -> DataFrame:
    """Digests of the ids of every document and of the text that they decode to."""
    rows = encode_and_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    listed = F.translate(F.to_json("ids"), ",[]", " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
