"""Exact top-k search of binary codes by incremental multi-index hashing.

A code is the sign bits of a vector (bit set where the component is above 0), split into segments; in each block of
rows every segment has a sorted array of its values. A query probes the values within radius r of its own segment, one
segment after the other, for r = 0, 1, 2, ... A code whose distance is at most (segments * r + probed segments - 1) has
by the pigeonhole principle been met by then, so the search ends as soon as the k-th verified distance is within that
bound. Ties go to the smaller id; results are exact, block by block and, merged, over all.

Cases: a null vector, or one with a null or non-finite component, takes no part; vectors of another length than a
query's are not compared with it; all-zero vectors have the code 0; repeated rows are ranked by id; a table with
fewer rows gives all of them; extra columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.llm.blocks import search_blocks

ROW_BLOCK, QUERY_BLOCK = 1 << 16, 1 << 9


def usable(vector: Column) -> Column:
    """Not null, and all components are finite numbers."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vector.isNotNull() & (F.size(vector) > 0) & ~F.coalesce(F.exists(vector, bad), F.lit(True))


def sign_code(vector: Column) -> Column:
    """Bytes of the sign bits, eight components a byte and most significant first, as text of 0 and 1."""
    return F.array_join(F.transform(vector, lambda x: F.when(x > 0, "1").otherwise("0")), "")


class SegmentIndex:
    def __init__(self, bits: np.ndarray):
        n, self.width = bits.shape
        per = int(np.clip(round(math.log2(max(n, 2))), 1, 16))
        self.cuts = [np.asarray(c) for c in np.array_split(np.arange(self.width), max(1, round(self.width / per)))]
        self.bits = bits
        self.packed = _pack(bits)
        self.tables = []
        for cut in self.cuts:
            values = self.segment(bits, cut)
            order = np.argsort(values, kind="stable")
            self.tables.append((order, np.searchsorted(values[order], np.arange((1 << len(cut)) + 1))))
        self.masks: dict[tuple[int, int], np.ndarray] = {}

    @staticmethod
    def segment(bits: np.ndarray, cut: np.ndarray) -> np.ndarray:
        return bits[:, cut].astype(np.int64) @ (1 << np.arange(len(cut)))

    def flips(self, width: int, r: int) -> np.ndarray:
        if (width, r) not in self.masks:
            self.masks[width, r] = np.array([sum(1 << i for i in c) for c in itertools.combinations(range(width), r)], np.int64)
        return self.masks[width, r]

    def search(self, query: np.ndarray, allowed: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows and distances of the k nearest of the ``allowed`` rows."""
        packed, seen = _pack(query[None])[0], ~allowed
        rows, dist = np.zeros(0, np.int64), np.zeros(0, np.int64)
        values = [int(self.segment(query[None], cut)[0]) for cut in self.cuts]
        for r in range(max(map(len, self.cuts)) + 1):
            for s, cut in enumerate(self.cuts):
                order, bounds = self.tables[s]
                if r <= len(cut):
                    probe = values[s] ^ self.flips(len(cut), r)
                    starts, ends = bounds[probe], bounds[probe + 1]
                    full = np.flatnonzero(ends > starts)
                    if len(full):
                        n = ends[full] - starts[full]
                        last = np.cumsum(n)
                        hit = order[np.arange(last[-1]) - np.repeat(last - n, n) + np.repeat(starts[full], n)]
                        hit = hit[~seen[hit]]
                        seen[hit] = True
                        d = np.bitwise_count(self.packed[hit] ^ packed).sum(1).astype(np.int64)
                        rows, dist = np.concatenate([rows, hit]), np.concatenate([dist, d])
                        if len(rows) > k:
                            best = np.lexsort((ids[rows], dist))[:k]
                            rows, dist = rows[best], dist[best]
                # Unmet codes differ by over r in the segments probed and by at least r in the others.
                if len(rows) == k and dist.max() <= len(self.cuts) * r + s:
                    return rows, dist
        return rows, dist


def _pack(bits: np.ndarray) -> np.ndarray:
    raw = np.packbits(bits, axis=1)
    raw = np.pad(raw, ((0, 0), (0, -raw.shape[1] % 8)))
    return np.ascontiguousarray(raw).view(np.uint64)


def _bits(codes: pa.Array, width: int) -> np.ndarray:
    text = "".join(codes.to_pylist()).encode()
    return (np.frombuffer(text, np.uint8) - 48).reshape(-1, width)


def search(queries: pa.Array, rows: pa.Array, query_ids: np.ndarray, row_ids: np.ndarray, k: int):
    out = []
    row_width, query_width = (np.array([len(x) for x in side.to_pylist()], np.int64) for side in (rows, queries))
    for width in np.unique(query_width):
        at, mine = np.flatnonzero(row_width == width), np.flatnonzero(query_width == width)
        if not len(at):
            continue
        index, ids = SegmentIndex(_bits(rows.take(pa.array(at)), width)), row_ids[at]
        bits = _bits(queries.take(pa.array(mine)), width)
        for i, q in enumerate(mine):
            found, dist = index.search(bits[i], ids != query_ids[q], ids, k)
            out.append((np.full(len(found), q), at[found], dist))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (empty, empty, empty)


def nearest_codes(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, key, distance): the k nearest codes of other rows, by Hamming distance, ties to the smaller id."""
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).select(F.col(key), sign_code(F.col(vector)).alias("code"))
    found = search_blocks(rows, key, "code", is_query, k, search, False, ROW_BLOCK, QUERY_BLOCK)
    return found.select("query_id", "rank", key, F.col("score").cast("int").alias("distance"))


K = 10


def op3_hamming_search(spark, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_codes(vectors, "vec_id", "embedding", F.col("vec_id") % 100 == 0, K)


ORACLE_SQL = {
    "op3_hamming_search": f"""
WITH v AS (SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
d AS (
  SELECT q.vec_id AS query_id, v.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, 65), lambda i: CASE WHEN (q.embedding[i] > 0) <> (v.embedding[i] > 0) THEN 1 ELSE 0 END)) AS INTEGER) AS distance
  FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM d) WHERE rank <= {K}"""
}
