"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups of documents.

Texts are dealt to groups at random; a group's texts are encoded where they land. Each document
is cut into whole sequences and one remainder; the remainders are packed by first fit in decreasing length, the first
bin with room being found in a tournament tree over the bins' free space. Since documents may be cut anywhere, the
least filled bins are then emptied into the gaps that remain, so that at most one sequence of a group needs padding.

Cases: null or empty text -> one piece with the end id; a very long text fills whole sequences and leaves one remainder;
remainders of equal length are packed by id, then text; repeated rows are packed once each, in any number of groups; an
empty table gives no piece; extra columns are ignored. A rerun over the same files gives the same sequences.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sluicework.llm.common import give_back, in_chunks, text_array
from sluicework.llm.tokens import default_tokenizer, encoder, ids_crc32

GROUP_BYTES = 8 << 20
#: A group's sequences are numbered from group * SPAN.
SPAN = 1 << 32
COLUMNS = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())]


class Tournament:
    """Free space of bins as leaves; each inner node holds the larger of its children."""

    def __init__(self, bins: int, capacity: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.tree = [capacity] * (2 * self.size)

    def first_with(self, need: int) -> int:
        node = 1
        while node < self.size:
            node *= 2
            if self.tree[node] < need:
                node += 1
        return node - self.size

    def take(self, bin_: int, amount: int) -> None:
        node = bin_ + self.size
        self.tree[node] -= amount
        while node > 1:
            node //= 2
            self.tree[node] = max(self.tree[2 * node], self.tree[2 * node + 1])


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Indices of the items of each bin; every item must fit a bin."""
    order = np.argsort(-lengths, kind="stable")
    tree, bins = Tournament(max(1, len(lengths)), capacity), []
    for i in order.tolist():
        at = tree.first_with(int(lengths[i]))
        tree.take(at, int(lengths[i]))
        if at == len(bins):
            bins.append([])
        bins[at].append(i)
    return bins


def fill_gaps(bins: list[list[tuple[int, int, int]]], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Pieces (document, start, length) of the emptiest bins go, cut where needed, into the gaps of the others."""
    bins = sorted(bins, key=lambda b: -sum(p[2] for p in b))
    fill = [sum(p[2] for p in b) for b in bins]
    to, last = 0, len(bins) - 1
    while to < last:
        if fill[to] == capacity:
            to += 1
            continue
        doc, start, length = bins[last].pop()
        part = min(length, capacity - fill[to])
        bins[to].append((doc, start, part))
        fill[to] += part
        fill[last] -= part
        if part < length:
            bins[last].append((doc, start + part, length - part))
        if not bins[last]:
            last -= 1
    return bins[: last + 1]


def pack_group(lengths: np.ndarray, capacity: int) -> list[list[tuple[int, int, int]]]:
    """Sequences as lists of (document, start, length)."""
    whole, rest = lengths // capacity, lengths % capacity
    out = [[(d, k * capacity, capacity)] for d in np.flatnonzero(whole).tolist() for k in range(int(whole[d]))]
    some = np.flatnonzero(rest)
    bins = first_fit_decreasing(rest[some], capacity)
    pieces = [[(int(some[i]), int(whole[some[i]]) * capacity, int(rest[some[i]])) for i in b] for b in bins]
    return out + fill_gaps(pieces, capacity)


def pack(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, group_bytes: int = GROUP_BYTES) -> DataFrame:
    chunks, n, _ = in_chunks(docs, group_bytes)

    def apply(key: tuple, table: pa.Table) -> pa.Table:
        give_back(keep=encoder)
        table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
        ids, offsets = encoder(tokenizer).encode(text_array(table["text"]), end_id)
        doc_ids, lengths = table["doc_id"].to_pylist(), np.diff(offsets)
        first, out = int(key[0].as_py()) * SPAN, []
        for s, sequence in enumerate(pack_group(lengths, capacity)):
            at = 0
            for doc, start, length in sequence:
                a = int(offsets[doc]) + start
                out.append((doc_ids[doc], start, length, ids_crc32(ids[a : a + length]), int(lengths[doc]), first + s, at))
                at += length
        columns = zip(*out, strict=True) if out else [[]] * len(COLUMNS)
        return pa.Table.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, COLUMNS, strict=True)], schema=pa.schema(COLUMNS))

    schema = ", ".join(f"`{name}` long" for name, _ in COLUMNS)
    return chunks.repartition(n, "chunk").groupBy("chunk").applyInArrow(apply, schema)


def op9_packing(spark, sf_dir: str) -> DataFrame:
    """Every piece of every document of ``documents``, with its place in a sequence."""
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer(), 1)
