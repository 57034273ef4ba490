"""Mixing sources to target weights by pivotal dependent rounding (DataFrame functions only).

Every document of a source has the same expected number of copies, target / source size, at most 2. Its whole part is
certain; the fractional part is rounded with the pivotal method: two documents exchange words (probability times size)
until one of them is certain, at random in proportion so that each expectation is kept. The words of a pair stay the
same, so a source's sum moves only by what the last undecided document weighs. Documents are dealt to small buckets by
hash; each bucket leaves at most one undecided document, and those meet in a reduction tree of fan-in ``FAN``.
Random numbers are hashes of the row, its number among its repeats, and the level: a rerun takes the same copies. Repeats
are counted first, in parts, and then dealt out one by one, so they are as spread as different rows.

Cases: null or empty text has size 0 and is copied with its expectation by a hash (it weighs nothing); a very long text is
one unit like any other, and may be its source's last undecided one; rows of equal size are told apart by their hash; a
null source is a source of its own, ordered last; repeated rows, null ids included, are rounded one by one; an empty table
gives no row; other columns are kept by ``mix`` whatever their names; the entries of a map come
back in the order of their keys.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from sluicework.llm.common import WORD, quoted, saved

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
FAN = 32
_EPS = 1e-9


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, size). One row a source; the water level has a closed form.

    Sources are filled in the order of the level at which they reach their bound; the level is the largest that any
    prefix of full sources leaves to the others.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = totals.withColumn("w", F.element_at(F.array(*map(F.lit, WEIGHTS)), (rank % len(WEIGHTS) + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("cap", MOST * F.col("source_size")).withColumn("full_at", F.col("cap") / F.col("w"))
    everything = Window.partitionBy()
    before = Window.orderBy("full_at", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(SHARE * F.col("source_size")).over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weight = F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    level = weighed.withColumn("level", left / weight).withColumn("level", F.max("level").over(everything))
    return level.select("source", "source_size", F.least("cap", F.col("w") * F.col("level")).alias("target"))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11).cast("double") / float(1 << 53)


def _step(acc: Column, x: Column) -> Column:
    """One exchange between the undecided unit and the next one; what is decided goes to ``out``."""
    a, b = acc["p"] * acc["s"], x["p"] * x["s"]
    give, get = F.least(a, x["s"] - b), F.least(b, acc["s"] - a)
    to_next = _uniform(x["u"], acc["i"]) * (give + get) < get
    p1 = F.when(to_next, F.greatest(F.lit(0.0), a + b - x["s"]) / acc["s"]).otherwise(F.least(F.lit(1.0), (a + b) / acc["s"]))
    p2 = F.when(to_next, F.least(F.lit(1.0), (a + b) / x["s"])).otherwise(F.greatest(F.lit(0.0), a + b - acc["s"]) / x["s"])

    def after(v: Column) -> Column:
        decided = lambda p: (p < _EPS) | (p > 1 - _EPS)
        mark = lambda i, p: F.array(F.struct(i.alias("i"), F.round(p).cast("int").alias("take")))
        none = F.struct(F.lit(-1).cast("long").alias("i"), F.lit(0.0).alias("p"), F.lit(1.0).alias("s"))
        keep = lambda i, p, s: F.struct(i.alias("i"), p.alias("p"), s.alias("s"))
        one, two = decided(v["p1"]), decided(v["p2"])
        carried = F.when(one & two, none).when(one, keep(x["i"], v["p2"], x["s"])).otherwise(keep(acc["i"], v["p1"], acc["s"]))
        added = F.when(one & two, F.concat(mark(acc["i"], v["p1"]), mark(x["i"], v["p2"]))).when(one, mark(acc["i"], v["p1"])).otherwise(mark(x["i"], v["p2"]))
        return F.struct(carried["i"].alias("i"), carried["p"].alias("p"), carried["s"].alias("s"), F.concat(acc["out"], added).alias("out"))

    bound = F.transform(F.array(F.struct(p1.alias("p1"), p2.alias("p2"))), after)[0]
    first = F.struct(x["i"].alias("i"), x["p"].alias("p"), x["s"].alias("s"), acc["out"].alias("out"))
    return F.when(acc["i"] < 0, first).otherwise(bound)


def pivotal(units: Column) -> Column:
    """Fold of array<struct<i long, p double, s double, u long>>, 0 < p < 1, s > 0, to struct<i, p, s, out>.

    ``out`` lists (i, take) of the decided units; i is -1 if none is left undecided."""
    start = F.struct(
        F.lit(-1).cast("long").alias("i"), F.lit(0.0).alias("p"), F.lit(1.0).alias("s"), F.array().cast("array<struct<i:bigint,take:int>>").alias("out")
    )
    return F.aggregate(units, start, _step)


def mix(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(row, size, source_size, target, copies): ``row`` is the struct of all columns of ``docs``."""
    row = F.struct(*[comparable(F.col(quoted(f.name)), f.dataType).alias(f.name) for f in docs.schema])
    rows = docs.select(row.alias("row"), F.col(quoted(source)).alias("source"), word_count(F.col(quoted(text))).alias("size"))
    return mix_rows(rows).withColumn("row", F.struct(*[as_given(F.col("row")[f.name], f.dataType).alias(f.name) for f in docs.schema]))


def comparable(value: Column, kind: DataType) -> Column:
    """``value`` with every map, at any depth, as a sorted list of its entries: maps can't be grouped by or ordered."""
    if not _holds_map(kind):
        return value
    if isinstance(kind, MapType):
        entry = lambda e: F.struct(comparable(e["key"], kind.keyType).alias("key"), comparable(e["value"], kind.valueType).alias("value"))
        return F.array_sort(F.transform(F.map_entries(value), entry))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda e: comparable(e, kind.elementType))
    return F.when(value.isNotNull(), F.struct(*[comparable(value[f.name], f.dataType).alias(f.name) for f in kind]))


def as_given(value: Column, kind: DataType) -> Column:
    """What ``comparable`` was given."""
    if not _holds_map(kind):
        return value
    if isinstance(kind, MapType):
        entry = lambda e: F.struct(as_given(e["key"], kind.keyType).alias("key"), as_given(e["value"], kind.valueType).alias("value"))
        return F.map_from_entries(F.transform(value, entry))
    if isinstance(kind, ArrayType):
        return F.transform(value, lambda e: as_given(e, kind.elementType))
    return F.when(value.isNotNull(), F.struct(*[as_given(value[f.name], f.dataType).alias(f.name) for f in kind]))


def _holds_map(kind: DataType) -> bool:
    if isinstance(kind, ArrayType):
        return _holds_map(kind.elementType)
    if isinstance(kind, StructType):
        return any(_holds_map(f.dataType) for f in kind)
    return isinstance(kind, MapType)


def mix_rows(rows: DataFrame) -> DataFrame:
    """As ``mix``, from (row, source, size)."""
    buckets = max(1, math.ceil(rows.count() / FAN))
    repeats = rows.groupBy("source", "row", "size").agg(F.count(F.lit(1)).alias("n"))
    rows = repeats.withColumn("j", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))).select("source", "row", "size", F.xxhash64("row", "j").alias("u"))
    packed = rows.groupBy("source", F.pmod("u", F.lit(buckets)).alias("bucket")).agg(
        F.array_sort(F.collect_list(F.struct("size", "u", "row"))).alias("units"), F.sum("size").alias("size")
    )
    packed = saved(packed)
    targets = saved(source_targets(packed.select("source", "size")))
    share = packed.alias("k").join(targets.alias("t"), F.col("k.source").eqNullSafe(F.col("t.source"))).select(
        "k.source", "bucket", "units", "source_size", "target",
        F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("share"),
    )
    # A share that rounding leaves a hair off a whole number is that number.
    whole = F.floor(F.col("share") + _EPS)
    share = share.withColumn("whole", whole.cast("int")).withColumn("p", F.greatest(F.col("share") - whole, F.lit(0.0)))
    unit = lambda x, i: F.struct(i.cast("long").alias("i"), F.col("p").alias("p"), x["size"].cast("double").alias("s"), x["u"].alias("u"))
    live = F.filter(F.transform("units", unit), lambda x: (x["s"] > 0) & (x["p"] > _EPS))
    first = share.withColumn("done", pivotal(live))
    left = saved(first.where("done.i >= 0").select("source", "bucket", "done.p", "done.s"))
    taken = [_tree(left, buckets)]
    last = taken[0]
    joined = first.alias("f").join(last.alias("l"), F.col("f.source").eqNullSafe(F.col("l.source")) & (F.col("f.bucket") == F.col("l.bucket")), "left").select(
        "f.units", "f.source_size", "f.target", "f.whole", "f.p", "f.done", "l.take"
    )
    marks = F.map_from_arrays(F.col("done.out.i"), F.col("done.out.take"))
    free = lambda x: F.when(_uniform(x["u"], F.lit("free")) < F.col("p"), 1).otherwise(0)
    copies = lambda x, i: F.col("whole") + F.when((x["size"] == 0) & (F.col("p") > _EPS), free(x)).when(
        i.cast("long") == F.col("done.i"), F.coalesce("take", F.lit(0))
    ).otherwise(F.coalesce(F.element_at(F.col("marks"), i.cast("long")), F.lit(0)))
    out = joined.withColumn("marks", marks).select(
        F.explode(F.transform("units", lambda x, i: F.struct(x["row"].alias("row"), x["size"].alias("size"), copies(x, i).alias("copies")))).alias("x"), "source_size", "target"
    )
    return out.select("x.row", "x.size", "source_size", "target", "x.copies")


def _tree(left: DataFrame, buckets: int) -> DataFrame:
    """(source, bucket, take) of the undecided unit of each bucket; one level joins FAN buckets of a source."""
    found, level, span = None, 0, 1
    while True:
        level, span = level + 1, span * FAN
        key = F.floor(F.col("bucket") / span)
        units = F.array_sort(F.collect_list(F.struct(F.col("bucket").alias("i"), "p", "s", F.xxhash64("source", "bucket", F.lit(level)).alias("u"))))
        done = saved(left.groupBy("source", key.alias("key")).agg(units.alias("units")).select("source", pivotal(F.col("units")).alias("done")))
        decided = done.select("source", F.explode("done.out").alias("x")).select("source", F.col("x.i").alias("bucket"), "x.take")
        left = done.where("done.i >= 0").select("source", F.col("done.i").alias("bucket"), "done.p", "done.s")
        if span >= buckets:
            last = left.withColumn("take", F.when(_uniform(F.xxhash64("source"), F.lit("last")) < F.col("p"), 1).otherwise(0))
            decided = decided.unionByName(last.select("source", "bucket", "take"))
            return decided if found is None else found.unionByName(decided)
        found = decided if found is None else found.unionByName(decided)


def op8_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document of ``documents``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = docs.select(F.struct("doc_id").alias("row"), "source", word_count(F.col("text")).alias("size"))
    out = mix_rows(rows)
    return out.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))
