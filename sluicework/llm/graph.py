"""Connected components by alternating large-star and small-star steps, and groups out of a sorted stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sluicework.llm.common import saved


#: Nodes with over 1/HOT of all edges are met by broadcast; there are at most HOT of them.
HOT = 128


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """(a, b, m): edges, of which there are ``total`` at most, with the smallest b of each a.

    The minima are aggregated in parts. A node with more than its share of the edges would be one task of the join back,
    so those few, whose number the share bounds, are sent to the edges instead."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
    hot, cold = (least.where(c).select("a", "m") for c in (F.col("n") > total / HOT, F.col("n") <= total / HOT))
    marked = edges.join(F.broadcast(hot), "a", "left")
    return marked.where(F.col("m").isNotNull()).unionByName(marked.where(F.col("m").isNull()).drop("m").join(cold, "a"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of all nodes in ``edges`` (a, b): root is the smallest node of the component.

    Each step replaces edges by edges to a smaller neighbour; the steps end when the edges no longer change. The driver
    sees a count and a checksum only.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = saved(edges.where(F.col("a") != F.col("b")).select(high.alias("a"), low.alias("b")).distinct())
    state, before = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first(), None
    while state != before:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        pulled = _with_least(both, 2 * state[0]).where(F.col("b") > F.col("a"))
        starred = saved(pulled.select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct())
        pulled = _with_least(starred, 2 * state[0])
        now = saved(pulled.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct())
        before, state = state, now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
    roots = now.select("b").distinct().join(now.select(F.col("a").alias("b")).distinct(), "b", "left_anti")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of equal values in the first ``keys`` columns, of a stream sorted by them."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        new = np.zeros(batch.num_rows, bool)
        for c in range(keys):
            column = batch.column(c)
            if batch.num_rows > 1:
                new[1:] |= pc.not_equal(column.slice(1), column.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
            new[0] |= not waiting or waiting[-1].column(c)[-1].as_py() != column[0].as_py()
        starts = np.flatnonzero(new).tolist()
        if starts and waiting:
            head = batch.slice(0, starts[0])
            yield pa.Table.from_batches([*waiting, head] if head.num_rows else waiting)
            waiting = []
        if not starts:
            waiting.append(batch)
            continue
        for a, b in zip(starts, starts[1:], strict=False):
            yield pa.Table.from_batches([batch.slice(a, b - a)])
        waiting = [batch.slice(starts[-1])]
    if waiting:
        yield pa.Table.from_batches(waiting)
