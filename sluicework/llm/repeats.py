"""Substring dedup: suffix trees partitioned by variable-length prefixes, cut at the depth that makes a repeat.

Every position of every text is a suffix of words. Suffixes go to memory-sized groups by the hash of their first p
words, p being the smallest length whose prefix is not too frequent for a group (a bounded sample of texts fixes which
prefixes those are; it affects balance only, never the result). In a group the suffixes are sorted by prefix and by the
64-bit fingerprint of their first ``width`` words, which brings the leaves below each internal node of depth ``width``
together: a node with leaves of several documents is a repeat, kept in the smallest document and flagged in the others.
Deeper nodes need no look, since a longer repeat is a run of repeats of that depth. A chunk of documents sends one leaf
per distinct fingerprint, the one of its smallest document, so a passage that a third of all documents hold sends one
leaf a chunk. Within a group, fingerprints of different windows meet with probability below 1e-6.

Cases: null or empty text, or fewer words than ``width`` -> nothing removed; windows that only repeat inside one document
stay; a very long text is read whole, as one row of its chunk; rows with one id, repeated rows among them, never remove
each other's words; a null id counts as the largest id there is (2^63 - 1); an empty table gives no row; extra columns are
ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import dictionary, hash64, in_chunks, in_order, mix64, ranges, round_trip, split_words, text_array

#: Suffixes of a group, about; texts of the balance sample and the longest of them; bytes of a chunk.
GROUP_SUFFIXES, SAMPLE_TEXTS, SAMPLE_CHARS, CHUNK_BYTES = 2_000_000, 2_000, 20_000, 8 << 20
_M = np.uint64(0x9E3779B97F4A7C15)
_LAST = np.iinfo(np.int64).max


def prefix_hashes(h: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of the ``length`` words from each start."""
    fp = np.zeros(len(starts), np.uint64)
    for i in range(length):
        fp = (fp + h[starts + i]) * _M
    return mix64(fp)


def window_starts(offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Index of the first word, and of the text, of every window."""
    n = np.maximum(np.diff(offsets) - width + 1, 0)
    return ranges(offsets[:-1], n), np.repeat(np.arange(len(n)), n)


def frequent_prefixes(docs: DataFrame, width: int, groups: int) -> list[np.ndarray]:
    """For p = 1..width-1, the sorted hashes of the p-word prefixes with over 1/(2 groups) of the sampled suffixes; each list
    has at most 2 * groups values."""
    table = docs.where(F.length("text").between(1, SAMPLE_CHARS)).orderBy(F.xxhash64("doc_id", F.length("text"))).limit(SAMPLE_TEXTS).select("text").toArrow()
    words, offsets = split_words(text_array(table["text"]))
    distinct, index = dictionary(words)
    h = hash64(distinct)[index] if distinct else np.zeros(0, np.uint64)
    starts, _ = window_starts(offsets, width)
    total, out = len(starts), []
    for p in range(1, width):
        values, counts = np.unique(prefix_hashes(h, starts, p), return_counts=True)
        out.append(values[counts > max(20, total / (2 * groups))])
        starts = starts[np.isin(prefix_hashes(h, starts, p), out[-1])]
    return out


class Windows:
    """The distinct windows of a chunk, in an order that depends on its rows only."""

    def __init__(self, table: pa.Table, width: int, frequent: list[np.ndarray], groups: int):
        self.ids = np.array([_LAST if x is None else x for x in table["doc_id"].to_pylist()], np.int64)
        self.words, self.offsets = split_words(text_array(table["text"]))
        distinct, index = dictionary(self.words)
        h = hash64(distinct)[index] if distinct else np.zeros(0, np.uint64)
        self.starts, doc = window_starts(self.offsets, width)
        fp = prefix_hashes(h, self.starts, width)
        order = np.argsort(fp, kind="stable")
        new = np.ones(len(fp), bool)
        new[1:] = fp[order[1:]] != fp[order[:-1]]
        self.inverse = np.empty(len(fp), np.int64)
        self.inverse[order] = np.cumsum(new) - 1
        first = order[new]  # rows are in the order of ids: the smallest comes first
        self.local = self.ids[doc] > self.ids[doc[first]][self.inverse]
        self.fp, self.doc = fp[first], doc[first]
        group, live = np.zeros(len(first), np.uint64), np.arange(len(first))
        for p in range(1, width + 1):
            key = prefix_hashes(h, self.starts[first[live]], p)
            group[live] = key
            if p == width or not len(live):
                break
            live = live[np.isin(key, frequent[p - 1])]
        self.group = (group % np.uint64(groups)).astype(np.int64)
        self.order = np.lexsort((self.fp, self.doc, self.group))
        self.bounds = np.searchsorted(self.group[self.order], np.arange(groups + 1))

    def leaves(self):
        for g in np.flatnonzero(np.diff(self.bounds)):
            rows = self.order[self.bounds[g] : self.bounds[g + 1]]
            docs, counts = np.unique(self.doc[rows], return_counts=True)
            yield int(g), np.int64(len(docs)).tobytes() + self.ids[docs].tobytes() + counts.astype(np.int32).tobytes() + self.fp[rows].tobytes()


def read_leaves(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    ids, counts = np.frombuffer(raw, np.int64, n, 8), np.frombuffer(raw, np.int32, n, 8 + 8 * n)
    return np.repeat(ids, counts), np.frombuffer(raw, np.uint64, offset=8 + 12 * n)


def later_leaves(ids: np.ndarray, fps: np.ndarray) -> np.ndarray:
    """True for each leaf whose node holds a leaf of a smaller document."""
    order = np.lexsort((ids, fps))
    new = np.ones(len(fps), bool)
    new[1:] = fps[order[1:]] != fps[order[:-1]]
    smallest = ids[order[new]][np.cumsum(new) - 1]
    out = np.empty(len(fps), bool)
    out[order] = ids[order] > smallest
    return out


def remove_repeats(docs: DataFrame, width: int = 13, with_text: bool = True) -> DataFrame:
    """Per document: doc_id, n_words, n_removed, kept_sha256, and with ``with_text`` the kept text."""
    chunks, n, total = in_chunks(docs.select("doc_id", "text"), CHUNK_BYTES, floor=48)
    groups = max(8, math.ceil(total / 6 / GROUP_SUFFIXES))
    shared = docs.sparkSession.sparkContext.broadcast(frequent_prefixes(docs, width, groups))
    names = ["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: 5 if with_text else 4]

    def emit(chunk, table):
        yield from Windows(in_order(table), width, shared.value, groups).leaves()

    def merge(bucket, blobs):
        parts = [read_leaves(raw) for _, raw in blobs]
        flags = later_leaves(np.concatenate([a for a, _ in parts]), np.concatenate([b for _, b in parts]))
        at = 0
        for (chunk, _), (ids, _) in zip(blobs, parts, strict=True):
            yield chunk, np.packbits(flags[at : at + len(ids)]).tobytes()
            at += len(ids)

    def finish(chunk, table, answers):
        table = in_order(table)
        w = Windows(table, width, shared.value, groups)
        flagged = np.zeros(len(w.fp), bool)
        for g, raw in answers.items():
            rows = w.order[w.bounds[g] : w.bounds[g + 1]]
            flagged[rows] = np.unpackbits(np.frombuffer(raw, np.uint8), count=len(rows)).astype(bool)
        hit = w.starts[w.local | flagged[w.inverse]]
        cover = np.zeros(len(w.words) + 1, np.int64)
        np.add.at(cover, hit, 1)
        np.add.at(cover, hit + width, -1)
        keep = np.cumsum(cover)[:-1] == 0
        kept = np.concatenate([[0], np.cumsum(keep)])[w.offsets]
        words = (w.words if keep.all() else w.words.filter(pa.array(keep))).to_pylist()
        texts = [" ".join(words[a:b]) for a, b in zip(kept[:-1].tolist(), kept[1:].tolist(), strict=True)]
        n_words = np.diff(w.offsets)
        columns = [
            table["doc_id"], pa.array(n_words), pa.array(n_words - np.diff(kept)), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in texts], pa.string()), pa.array(texts, pa.string())
        ]
        return pa.Table.from_arrays(columns[: len(names)], names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text
    return round_trip(chunks, n, groups, emit, merge, finish, schema)


def op4_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """Words that repeats remove from every document of ``documents``, and the hash of what is kept."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_text=False)


ORACLE_SQL = {
    "op4_substring_dedup": r"""
WITH d AS MATERIALIZED (
  SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
words AS (SELECT r, id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
windows AS (
  SELECT *, count(*) OVER next AS n, string_agg(word, ' ') OVER next AS seq FROM words
  WINDOW next AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING)),
hits AS (SELECT r, i, word, n = 13 AND min(id) OVER (PARTITION BY n, seq) < id AS hit FROM windows),
judged AS (SELECT *, bool_or(hit) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN 12 PRECEDING AND CURRENT ROW) AS removed FROM hits),
kept AS (
  SELECT r, count(*) AS n_words, count(*) FILTER (WHERE removed) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT removed) AS t
  FROM judged GROUP BY r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)"""
}
