"""A stated set of queries against all rows, in blocks: cells of one query block and one row block."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def search_blocks(rows: DataFrame, key: str, value: str, is_query: Column, k: int, search: Callable, best_first: bool, row_block: int, query_block: int) -> DataFrame:
    """(query_id, rank, ``key``, score): the ``k`` best of every cell, then of every query.

    ``search(query_values, row_values, k)`` gets two Arrow arrays and the ids of both and returns (query index, row index,
    score), at most about k rows for each query. Every row and every query goes to a cell by hash, so no value can fill
    one; a row is sent once per query block and a query once per row block. Repeated query rows are asked once.
    """
    rows = rows.select(F.col(key).cast("long").alias("id"), F.col(value).alias("value"), F.coalesce(is_query, F.lit(False)).alias("q"))
    n, nq = rows.select(F.count(F.lit(1)), F.count_if("q")).first()
    # Few rows still make several cells, so that all cores share the work.
    row_blocks = max(1, math.ceil(n / row_block))
    query_blocks = max(1, math.ceil(nq / query_block), min(math.ceil(nq / 16), math.ceil(12 / row_blocks)))
    at = F.xxhash64("id", F.lit(1))
    spread = lambda other, of: F.explode(F.sequence(F.lit(0), F.lit(other - 1))).alias(of)
    sides = rows.select(spread(query_blocks, "qb"), F.pmod(at, F.lit(row_blocks)).cast("int").alias("rb"), F.lit(False).alias("q"), "id", "value")
    asked = rows.where("q").distinct().select(F.pmod(at, F.lit(query_blocks)).cast("int").alias("qb"), spread(row_blocks, "rb"), F.lit(True).alias("q"), "id", "value")

    def cell(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        mine, all_rows = table.filter(table["q"]), table.filter(pc.invert(table["q"]))
        qi, ri, score = search(mine["value"].combine_chunks(), all_rows["value"].combine_chunks(), mine["id"].to_numpy(), all_rows["id"].to_numpy(), k)
        return pa.table({"query_id": mine["id"].to_numpy()[qi], "row_id": all_rows["id"].to_numpy()[ri], "score": pa.array(score, pa.float64())})

    found = asked.unionByName(sides.select(*asked.columns)).groupBy("qb", "rb").applyInArrow(cell, "query_id long, row_id long, score double")
    order = F.col("score").desc() if best_first else F.col("score").asc()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(order, "row_id"))
    ranked = found.withColumn("rank", rank).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("row_id").alias(key), "score")
