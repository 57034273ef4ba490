"""Running values along an order of rows, where one key may hold any share of the rows.

Every key is cut into ranges of the order. Rows are worked on by key and range, each range is summed up in one row, and what
the ranges before it come to is carried into each. Where a row belongs depends on the row and the ranges alone, so a task
that runs again finds the same rows. ``before`` takes ranges of a fixed width, for which nothing has to be counted first;
``key_ranges`` gives ranges with about as many rows each, for orders that are spread thinly over a key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows up to which a key is not cut by ``key_ranges``, and the most ranges of a key.
ROWS, SHARES = 100_000, 1024
#: Width of the ranges of ``before``. Where no two rows of a key have the same place, a range has as many rows at most.
WIDTH = 1 << 22
PART = "_sw_part"


def _same(keys: list[str], prefix: str) -> Column:
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(prefix + k))
    return on


def _renamed(df: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    return df.withColumnsRenamed({k: prefix + k for k in keys})


def key_ranges(rows: DataFrame, keys: list[str], order: str, least: int = ROWS) -> DataFrame:
    """(keys, part, lo, hi): the ranges lo < ``order`` <= hi of the keys with over ``least`` rows; the first and last are open.
    A null belongs to the first."""
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_sw_n"))
    hot = counts.withColumn("_sw_pieces", F.least(F.lit(SHARES), F.ceil(F.col("_sw_n") / least)).cast("int")).where(F.col("_sw_pieces") > 1)
    hot = _renamed(hot.drop("_sw_n"), keys, "_sw_hot_")
    # A row for ``least`` rows at most.
    theirs = rows.select(*keys, F.col(order).alias("_sw_order")).join(F.broadcast(hot), _same(keys, "_sw_hot_"))
    at = [i / SHARES for i in range(1, SHARES)]
    found = theirs.groupBy(*keys).agg(F.percentile_approx("_sw_order", at, 10 * SHARES).alias("b"), F.max("_sw_pieces").alias("pieces"))
    chosen = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("pieces") - 1), lambda i: F.get("b", F.floor(i * SHARES / F.col("pieces")).cast("int") - 1)))
    rows = found.select(*keys, chosen.alias("b")).select(*keys, "b", F.explode(F.sequence(F.lit(0), F.size("b"))).alias(PART))
    return rows.select(*keys, PART, F.get("b", F.col(PART) - 1).alias("_sw_lo"), F.get("b", F.col(PART)).alias("_sw_hi"))


def placed(rows: DataFrame, keys: list[str], order: str, ranges: DataFrame) -> DataFrame:
    """``rows`` with the number of their range, null for keys that are not cut."""
    value = F.col(order)
    on = _same(keys, "_sw_key_") & (F.col("_sw_lo").isNull() | (value > F.col("_sw_lo"))) & (F.col("_sw_hi").isNull() | value.isNull() | (value <= F.col("_sw_hi")))
    return rows.join(F.broadcast(_renamed(ranges, keys, "_sw_key_")), on, "left").drop(*[f"_sw_key_{k}" for k in keys], "_sw_lo", "_sw_hi")


@dataclass(frozen=True)
class Carry:
    """An associative way to bring values together: over the rows before one, over a range, over the ranges before one, and of
    what is carried with what is local."""

    local: Callable[[Column, WindowSpec], Column]
    summary: Callable[[Column, Column], Column]
    across: Callable[[Column, WindowSpec], Column]
    joined: Callable[[Column, Column], Column]


SUM = Carry(lambda v, w: F.sum(v).over(w), lambda v, order: F.sum(v), lambda s, w: F.sum(s).over(w), lambda c, x: F.when(c.isNull(), x).otherwise(c + F.coalesce(x, F.lit(0))))
LAST = Carry(
    lambda v, w: F.last(v, ignorenulls=True).over(w), lambda v, order: F.max_by(v, F.when(v.isNotNull(), order)), lambda s, w: F.last(s, ignorenulls=True).over(w), lambda c, x: F.coalesce(x, c)
)


def before(rows: DataFrame, keys: list[str], order: list[str], value: str, carry: Carry, into: str, width: int = WIDTH) -> DataFrame:
    """``rows`` with the column ``into``: what ``value`` comes to over the rows of the same key before it in ``order``, null
    for the first. The first column of ``order`` is a whole number, null before all others; ``order`` should leave no ties.

    Rows are shuffled once, by key and range, and meet what is carried into their range where they are. The sums are made in
    parts before they move; a key within one range carries nothing.
    """
    # One value for key and range: a struct is never null, so keys that are null meet by plain equality.
    rows = rows.withColumn("_sw_at", F.struct(*keys, F.floor(F.col(order[0]) / width).alias(PART)))
    all_before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    ranges_before = all_before(Window.partitionBy(*[F.col("_sw_at")[k] for k in keys]).orderBy(F.col("_sw_at")[PART]))
    sums = rows.groupBy("_sw_at").agg(carry.summary(F.col(value), F.struct(*order)).alias("_sw_sum"))
    sums = sums.select(F.col("_sw_at").alias("_sw_of"), carry.across(F.col("_sw_sum"), ranges_before).alias("_sw_carry")).where(F.col("_sw_carry").isNotNull())
    local = carry.local(F.col(value), all_before(Window.partitionBy("_sw_at").orderBy(*order)))
    both = rows.withColumn("_sw_local", local).join(sums, F.col("_sw_at") == F.col("_sw_of"), "left")
    return both.withColumn(into, carry.joined(F.col("_sw_carry"), F.col("_sw_local"))).drop("_sw_local", "_sw_carry", "_sw_at", "_sw_of")
