"""Approximate nearest neighbours by inner product: a forest of sorted hash strings, searched by longest prefix.

Each tree hashes a vector to a string of ``DEPTH`` sign bits of random projections (seeded, the same in every task) and
keeps the strings of a block of rows as a sorted array. A query descends in every tree to its longest-prefix match and
takes candidates around it; then the trees ascend together, tree after tree and bit after bit, and add the rows that share
the shorter prefix. Candidates are verified on the original vectors in double precision. The ascent ends as soon as a
neighbour as near as the k-th verified one would have been met, over all trees, with probability ``RECALL``: with p the
chance that one bit agrees at that angle and l the prefix that a tree has come to, 1 - product of (1 - p^l). The k-th
verified score only grows, so that end is safe. Vectors are brought to one length first (one more component), which turns
inner products into angles.

The nearer the neighbours, the fewer rows are verified; what share it is on the given table is in the README.

Cases: vectors that are null, zero, or hold a null or non-finite component take no part; vectors of another length than the
query's have no inner product with it and are searched among their own; rows that repeat the query's id are its own and no
candidates; a repeated query row is asked once, and different vectors under one query id share one list of k; repeated
vectors are ranked by id, ties of the score too; fewer rows than k give all of them; an empty table gives no row; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework.llm.blocks import search_blocks
from sluicework.llm.hamming import usable

TREES, DEPTH, RECALL, FIRST = 48, 24, 0.92, 32
ROW_BLOCK, QUERY_BLOCK = 1 << 14, 1 << 11


class Forest:
    def __init__(self, rows: np.ndarray, bound: float):
        self.rows, self.bound = rows, bound
        rng = np.random.default_rng(20)
        self.planes = rng.standard_normal((TREES, rows.shape[1] + 1, DEPTH))
        self.trees = []
        for t in range(TREES):
            h = self.hashes(rows, t)
            order = np.argsort(h, kind="stable")
            self.trees.append((h[order], order))

    def hashes(self, x: np.ndarray, t: int, stretch: bool = True) -> np.ndarray:
        norm = (x * x).sum(1)
        last = np.sqrt(np.maximum(self.bound - norm, 0)) if stretch else np.zeros(len(x))
        bits = np.concatenate([x, last[:, None]], 1) @ self.planes[t] > 0
        return bits.astype(np.int64) @ (1 << np.arange(DEPTH - 1, -1, -1))

    def steps(self, query: np.ndarray, kth: float) -> int:
        """After how many ascents of single trees a row of inner product ``kth`` has been met with probability RECALL."""
        cosine = np.clip(kth / max(np.sqrt((query * query).sum() * self.bound), 1e-300), -1, 1)
        agree = 1 - np.arccos(cosine) / np.pi
        with np.errstate(divide="ignore"):
            missed = np.log1p(-np.minimum(agree ** np.arange(DEPTH + 1.0), 1))  # by one tree, per length of prefix
        want = math.log(1 - RECALL)
        level = int(np.flatnonzero(TREES * missed <= want)[-1])
        if level == DEPTH:
            return 0
        some = 1 if level == 0 else math.ceil((want - TREES * missed[level + 1]) / (missed[level] - missed[level + 1]) - 1e-9)
        return (DEPTH - level - 1) * TREES + some

    @staticmethod
    def _best(rows: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        if len(rows) > k:  # all that tie with the k-th stay for the order by id
            some = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
            rows, score = rows[some], score[some]
        best = np.lexsort((ids[rows], -score))[:k]
        return rows[best], score[best]

    def search(self, queries: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int):
        hashed = [self.hashes(queries, t, False) for t in range(TREES)]
        n = len(ids)
        for q in range(len(queries)):
            seen = ids == query_ids[q]
            rows, score = np.zeros(0, np.int64), np.zeros(0)
            came = [DEPTH + 1] * TREES
            spans = [(i := int(np.searchsorted(keys, hashed[t][q])), i) for t, (keys, _) in enumerate(self.trees)]
            done = -1  # ascents so far; before the first one the neighbours in the arrays share the longest prefixes
            while True:
                fresh = []
                for t, (keys, order) in enumerate(self.trees):
                    a, b = spans[t]
                    level = DEPTH - (done + TREES - 1 - t) // TREES
                    if done < 0:
                        lo, hi = max(0, a - FIRST // 2), min(n, b + FIRST // 2)
                    elif level == came[t]:
                        continue
                    else:
                        low = int(hashed[t][q]) >> (DEPTH - level) << (DEPTH - level)
                        lo, hi = min(a, int(np.searchsorted(keys, low))), max(b, int(np.searchsorted(keys, low + (1 << (DEPTH - level)))))
                        came[t] = level
                    fresh += [order[lo:a], order[b:hi]]
                    spans[t] = lo, hi
                hit = np.concatenate(fresh) if fresh else order[:0]
                mark = np.zeros(n, bool)
                mark[hit] = True
                hit = np.flatnonzero(mark & ~seen)
                seen[hit] = True
                rows, score = self._best(np.concatenate([rows, hit]), np.concatenate([score, np.take(self.rows, hit, 0) @ queries[q]]), ids, k)
                need = self.steps(queries[q], score[-1]) if len(rows) == k else DEPTH * TREES
                if done >= need:
                    break
                # In leaps while the end is far, then in small steps: a better k-th score asks for fewer of them.
                done = max(done + 1, min(need, need - TREES if done < need - 2 * TREES else done + TREES // 6))
                if done == DEPTH * TREES:
                    rest = np.flatnonzero(~seen)
                    seen[rest] = True
                    rows, score = self._best(np.concatenate([rows, rest]), np.concatenate([score, np.take(self.rows, rest, 0) @ queries[q]]), ids, k)
                    break
            yield rows, score, int(seen.sum())


def _matrix(vectors: pa.Array) -> np.ndarray:
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(vectors), -1) if len(vectors) else np.zeros((0, 1))


def nearest_vectors(vectors: DataFrame, key: str, vector: str, is_query: Column, k: int) -> DataFrame:
    """(query_id, rank, key, score): about the k rows of largest inner product, ties to the smaller id."""
    rows = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull()).where(F.exists(vector, lambda x: x != 0)).select(key, vector)
    norm = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    bound = float(rows.agg(F.max(norm)).first()[0] or 1.0) * (1 + 1e-9)

    def search(queries: pa.Array, all_rows: pa.Array, query_ids: np.ndarray, row_ids: np.ndarray, k: int):
        out = []
        wide, asked = (pc.list_value_length(x).to_numpy(zero_copy_only=False) for x in (all_rows, queries))
        for width in np.unique(asked):
            at, mine = np.flatnonzero(wide == width), np.flatnonzero(asked == width)
            if len(at):
                found = Forest(_matrix(all_rows.take(pa.array(at))), bound).search(_matrix(queries.take(pa.array(mine))), query_ids[mine], row_ids[at], k)
                out += [(np.full(len(rows), q), at[rows], score) for q, (rows, score, _) in zip(mine, found, strict=True)]
        empty = np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (empty, empty, empty)

    return search_blocks(rows, key, vector, is_query, k, search, True, ROW_BLOCK, QUERY_BLOCK)


def op7_hash_forest(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of all other rows for every row of ``embeddings`` whose id is divisible by 20."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_vectors(vectors, "vec_id", "embedding", F.col("vec_id") % 20 == 0, 20)
