"""Planning and verification over probed media."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from sluicework import model
from sluicework.functions import media
from sluicework.functions.tables import LADDER
from sluicework.operators import scan


#: Values of a band that one hash asks for, at most; samples and entries of a list that a task compares at once; targets of a range of keyframes.
ASKED, MEET, BLOCK, SPAN = 4096, 1 << 14, 1 << 16, 64
#: Samples and entries of a list whose differences are held at once.
TILE = 64, 4096


def ladder_plan(sources: DataFrame) -> DataFrame:
    """(source, pos, rung, width, height, max_bitrate, crf), best rung first.

    The four rungs are an array in the plan, so no join is needed; a source that no rung fits gets the smallest, capped
    at its own height. A source without a size gets nothing.
    """
    size = media.display_size(*(F.col(c) for c in ("width", "height", "rotation", "sar_num", "sar_den")))
    shown = sources.select("source", "bit_rate", size.alias("d")).where((F.col("d.width") > 0) & (F.col("d.height") > 0))
    src_w, src_h = F.col("d.width"), F.col("d.height")
    rung = lambda n, h, b, c: F.struct(F.lit(n).alias("rung"), h.cast("long").alias("h"), F.lit(b).alias("max_bitrate"), F.lit(c).alias("crf"))
    all_rungs = F.array(*[rung(n, F.lit(h), b, c) for n, h, b, c in LADDER])
    fits = F.filter(all_rungs, lambda r: (r["h"] <= src_h) & (F.col("bit_rate").isNull() | (r["max_bitrate"] < F.col("bit_rate"))))
    name, height, bitrate, crf = min(LADDER, key=lambda r: r[1])
    smallest = F.array(rung(name, F.least(F.lit(height), media.even(src_h)), bitrate, crf))
    chosen = shown.select("source", "d", F.posexplode(F.when(F.size(fits) > 0, fits).otherwise(smallest)).alias("pos", "r"))
    h = media.even(F.least(F.col("r.h"), src_h)).cast("long")
    return chosen.select(
        "source", "pos", "r.rung", media.scaled_width(h, src_w, src_h).alias("width"), F.greatest(h, F.lit(2)).cast("long").alias("height"), "r.max_bitrate", "r.crf"
    )


def fast_path(steps: DataFrame, keys: list[str]) -> DataFrame:
    """The middle step of each key: position size div 2."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return steps.withColumn("_sw_n", n).where(F.col("pos") == F.floor(F.col("_sw_n") / 2)).drop("_sw_n")


def two_paths(steps: DataFrame, keys: list[str]) -> DataFrame:
    """All steps with the path they take: the middle one is fast, the others quality."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return steps.withColumn("path", F.when(F.col("pos") == F.floor(n / 2), "fast").otherwise("quality"))


def keyframe_index(keyframes: DataFrame) -> DataFrame:
    """(source, keyframes): sorted and distinct."""
    return keyframes.groupBy("source").agg(F.array_sort(F.collect_set("ms")).alias("keyframes"))


def split_plan(index: DataFrame, target_ms: int = model.SPLIT_TARGET_MS) -> DataFrame:
    """(source, whole, chunk_index, start_ms, end_ms) from (source, keyframes, duration_ms); see ``split_keyframes``."""
    return split_keyframes(index.select("source", "duration_ms", F.explode_outer("keyframes").alias("ms")), target_ms)


def split_keyframes(keyframes: DataFrame, target_ms: int = model.SPLIT_TARGET_MS, span: int = SPAN) -> DataFrame:
    """(source, whole, chunk_index, start_ms, end_ms) from a row (source, duration_ms, ms) a keyframe; a source without any
    has one row with ms null.

    Cuts are a fold: the first keyframe at or past the target after the last cut. A chunk's number is given before empty
    chunks are left out. A source is cut into ranges of ``span`` targets. A range is a map from the cut that enters it to the
    cut that leaves it, of which only the keyframes of its first target matter; the maps of a source are chained in the order
    of the ranges, and then every range gives its own chunks. A range has as many keyframes as milliseconds at most, and a
    year of ten-second targets is some 50,000 ranges, so no source fills a task.
    Order and repeats of the keyframes do not matter; a source with several durations has the longest; a duration
    that is null ends no chunk, so the last one is left out.
    """
    target = max(target_ms, 1)
    kind = keyframes.schema["source"].dataType.simpleString()
    rows = keyframes.select("source", F.col("duration_ms").cast("long"), F.col("ms").cast("long"))
    part = F.floor(F.col("ms") / (target * span))
    parts = rows.where(F.col("ms") >= target).groupBy("source", part.alias("part")).agg(F.array_sort(F.collect_set("ms")).alias("keys"))
    maps = parts.mapInArrow(_range_maps(target, span), f"source {kind}, part long, enters array<long>, leaves array<long>, cuts array<long>")
    chained = maps.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("part", "enters", "leaves", "cuts"))).alias("l"))

    def step(acc: Column, p: Column) -> Column:
        k = F.size(F.filter(p["enters"], lambda ms: ms < acc["cut"] + target))
        here = F.struct(p["part"].alias("part"), acc["cut"].alias("cut"), acc["number"].alias("number"))
        return F.struct(
            F.coalesce(F.get(p["leaves"], k), acc["cut"]).alias("cut"), (acc["number"] + F.coalesce(F.get(p["cuts"], k), F.lit(0))).alias("number"), F.concat(acc["seen"], F.array(here)).alias("seen")
        )

    zero = F.lit(0).cast("long")
    start = F.struct(zero.alias("cut"), zero.alias("number"), F.array().cast("array<struct<part: bigint, cut: bigint, number: bigint>>").alias("seen"))
    # A source may be null, which joins as a value of its own.
    chained = chained.select(F.col("source").alias("_sw_source"), F.aggregate("l", start, step).alias("c"))
    about = rows.groupBy("source").agg(F.max("duration_ms").alias("duration_ms"), F.count("ms").alias("n"))
    about = about.join(chained, F.col("source").eqNullSafe(F.col("_sw_source")), "left")
    short = F.col("duration_ms").isNotNull() & (F.col("duration_ms") < model.MIN_SPLITTABLE_MS)
    number = F.coalesce(F.col("c.number"), zero)
    whole = F.when(short, "too_short").when(F.col("n") == 0, "no_keyframes").when(number == 0, "keyframes_too_sparse")
    none = F.lit(None)

    def entry(part: Column, whole: Column, number: Column, start: Column, end: Column) -> Column:
        return F.struct(part.cast("long").alias("part"), whole.cast("string").alias("whole"), number.alias("number"), start.alias("start_ms"), end.cast("long").alias("end_ms"))

    nothing = F.array().cast("array<struct<part: bigint, whole: string, number: bigint, start_ms: bigint, end_ms: bigint>>")
    cut, duration = F.col("c.cut"), F.col("duration_ms")
    last = F.when(duration > cut, F.array(entry(none, none, number, cut, duration))).otherwise(nothing)
    inner = F.transform("c.seen", lambda p: entry(p["part"], none, p["number"], p["cut"], none))
    entries = F.when(whole.isNotNull(), F.array(entry(none, whole, zero, zero, duration))).otherwise(F.concat(last, inner))
    # What is known of a source goes through as it is, and what enters a range meets its keyframes: one pass gives all chunks.
    about = about.select(F.col("source").alias("_sw_source"), F.explode(entries).alias("e")).select("_sw_source", "e.whole", "e.number", "e.start_ms", "e.end_ms", F.col("e.part").alias("_sw_part"))
    met = about.join(parts, F.col("source").eqNullSafe(F.col("_sw_source")) & (F.col("part") == F.col("_sw_part")), "left")
    met = met.select(F.col("_sw_source").alias("source"), "whole", "number", "start_ms", "end_ms", "keys")
    return met.mapInArrow(_range_chunks(target), f"source {kind}, whole string, chunk_index int, start_ms long, end_ms long")


class _Ranges:
    """Sorted keyframes of all ranges of a batch, one after the other, and of each the first one of its range a target later."""

    def __init__(self, lists: pa.Array, target: int):
        ends = lists.offsets.to_numpy().astype(np.int64)
        self.ms = lists.values.slice(ends[0], ends[-1] - ends[0]).to_numpy()
        self.ends, self.target, self.row = ends - ends[0], target, np.repeat(np.arange(len(lists)), np.diff(ends))
        self.after = self.first(self.row, self.ms + target)

    def first(self, rows: np.ndarray, at_least: np.ndarray) -> np.ndarray:
        """The first keyframe of each of ``rows`` at or past a time, the end of the row if none is: a binary search in all at once."""
        low, high = self.ends[rows].copy(), self.ends[rows + 1].copy()
        while (open_ := low < high).any():
            middle = (low + high) // 2
            smaller = open_ & (self.ms[np.minimum(middle, len(self.ms) - 1)] < at_least)
            low, high = np.where(smaller, middle + 1, low), np.where(open_ & ~smaller, middle, high)
        return low


def _range_maps(target: int, span: int):
    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            r = _Ranges(batch.column("keys"), target)
            n, ends = len(r.ms), r.ends[r.row + 1]
            # Doubling: after k steps ``last`` is 2^k cuts on, or the last cut of the range, and ``cuts`` tells how many.
            last = np.where(r.after < ends, r.after, np.arange(n))
            cuts = (last != np.arange(n)).astype(np.int64)
            while ((further := last[last]) != last).any():
                cuts, last = cuts + cuts[last], further
            # What enters was cut before the range begins, so it asks for a keyframe of the first target or the next one.
            begins = batch.column("part").to_numpy() * target * span
            m = np.minimum(r.first(np.arange(batch.num_rows), begins + target) + 1, r.ends[1:]) - r.ends[:-1]
            at = np.repeat(r.ends[:-1] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
            offsets = pa.array(np.concatenate([[0], np.cumsum(m)]), pa.int32())
            lists = (pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (r.ms[at], r.ms[last[at]], cuts[at] + 1))
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("part"), *lists], ["source", "part", "enters", "leaves", "cuts"])

    return apply


def _range_chunks(target: int):
    names = ["source", "whole", "chunk_index", "start_ms", "end_ms"]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = pc.is_null(batch.column("keys"))
            whole = batch.filter(known)
            yield pa.RecordBatch.from_arrays([whole.column("source"), whole.column("whole"), whole.column("number").cast(pa.int32()), whole.column("start_ms"), whole.column("end_ms")], names)
            batch = batch.filter(pc.invert(known))
            if not batch.num_rows:
                continue
            r = _Ranges(batch.column("keys"), target)
            rows, cut, number = np.arange(batch.num_rows), batch.column("start_ms").to_numpy(), batch.column("number").to_numpy()
            at = r.first(rows, cut + target)
            found = []
            # All ranges take their next cut at once; a range has no more cuts than targets.
            while (some := at < r.ends[rows + 1]).any():
                rows, cut, number, at = rows[some], cut[some], number[some], at[some]
                found.append((rows, number, cut, r.ms[at]))
                cut, number, at = r.ms[at], number + 1, r.after[at]
            rows, number, start, end = (np.concatenate(x) for x in zip(*found, strict=True)) if found else [np.zeros(0, np.int64)] * 4
            yield pa.RecordBatch.from_arrays([batch.column("source").take(pa.array(rows)), pa.nulls(len(rows), pa.string()), pa.array(number, pa.int32()), pa.array(start), pa.array(end)], names)

    return apply


def sparse_gaps(keyframes: DataFrame, gap_ms: int = model.SPARSE_GAP_MS, width: int = scan.WIDTH) -> DataFrame:
    """Neighbouring keyframes further apart than the gap."""
    rows = scan.before(keyframes.select("source", "ms").distinct(), ["source"], ["ms"], "ms", scan.LAST, "before_ms", width)
    return rows.where(F.col("ms") - F.col("before_ms") > gap_ms).select("source", "before_ms", "ms", (F.col("ms") - F.col("before_ms")).alias("gap_ms"))


def backward_timestamps(packets: DataFrame, keys: list[str], order: list[str], dts: str = "dts", width: int = scan.WIDTH) -> DataFrame:
    """Packets whose timestamp is before the last known one."""
    return scan.before(packets, keys, order, dts, scan.LAST, "previous", width).where(F.col(dts) < F.col("previous"))


def verify(renditions: DataFrame) -> DataFrame:
    """(asset, name, problem, expected, actual) from (asset, pos, name, frame_count, duration_ms, keyframes, warnings, fps).

    The first rendition of an asset is what the others must agree with. A rendition with fps null has no video.
    """
    first = Window.partitionBy("asset").orderBy("pos")
    for_all = ["frame_count", "duration_ms", "keyframes", "fps", "pos"]
    rows = renditions.withColumns({f"ref_{c}": F.first(c).over(first) for c in for_all})
    later = F.col("pos") != F.col("ref_pos")
    problem = lambda name, a, b: F.struct(F.lit(name).alias("problem"), a.cast("string").alias("expected"), b.cast("string").alias("actual"))
    none = F.lit(None).cast("string")
    listed = lambda c: F.array_join(F.col(c).cast("array<string>"), ",")
    fixed = [
        F.when(F.col("fps").isNull(), problem("no_video", none, none)),
        F.when(later & (F.col("frame_count") != F.col("ref_frame_count")), problem("frame_count", F.col("ref_frame_count"), F.col("frame_count"))),
        F.when(later & ~F.col("keyframes").eqNullSafe(F.col("ref_keyframes")), problem("keyframe_mismatch", listed("ref_keyframes"), listed("keyframes"))),
        F.when(later & (F.abs(F.col("duration_ms") - F.col("ref_duration_ms")) > F.coalesce(media.frame_slack_ms(F.col("ref_fps")), F.lit(0))), problem("duration", F.col("ref_duration_ms"), F.col("duration_ms"))),
    ]
    bad = F.transform(F.array_intersect("warnings", F.array(*map(F.lit, model.MUST_NOT_SURVIVE))), lambda w: problem("unexpected_warning", none, w))
    found = F.concat(F.array_compact(F.array(*fixed)), bad)
    return rows.select("asset", "name", F.explode(found).alias("p")).select("asset", "name", "p.*")


def verdicts(renditions: DataFrame, findings: DataFrame) -> DataFrame:
    """(asset, checked, findings, ok)."""
    n = renditions.groupBy("asset").agg(F.count(F.lit(1)).alias("checked"))
    bad = findings.groupBy("asset").agg(F.count(F.lit(1)).alias("findings"))
    joined = n.join(bad, "asset", "left").withColumn("findings", F.coalesce("findings", F.lit(0)))
    return joined.withColumn("ok", F.col("findings") == 0)


def bands_of(width: int, most: int, n: int) -> list[tuple[int, int]]:
    """``n`` bands (bits, radius) of ``width`` bits: hashes within ``most`` bits of each other are within the radius in one of
    them, since they would differ in most + 1 bits otherwise."""
    cuts = [width * i // n for i in range(n + 1)]
    return [(b - a, (most + 1) // n - 1 + (i < (most + 1) % n)) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _near(bits: int, radius: int) -> int:
    """How many values lie within a radius of one."""
    return sum(math.comb(bits, r) for r in range(radius + 1))


def pair_share(bands: list[tuple[int, int]]) -> float:
    """The share of all pairs of random hashes that meet in a band."""
    return sum(_near(*b) / 2 ** b[0] for b in bands)


def band_plan(width: int, most: int, samples: int, known: int) -> list[tuple[int, int]] | None:
    """The bands that make the fewest rows for so many samples and known hashes; None where comparing all pairs in
    blocks is less work, a comparison being a tenth of a row that is shuffled."""
    options = [bands_of(width, most, n) for n in range(1, min(width, most + 1) + 1)]
    options = [b for b in options if max(_near(*x) for x in b) <= ASKED]
    cost = lambda b: samples * len(b) + known * sum(_near(*x) for x in b) + samples * known * pair_share(b)
    best = min(options, key=cost, default=None)
    return best if best and cost(best) < samples * known / 10 else None


def blocklist_match(samples: DataFrame, blocklist: DataFrame, most: int = model.MATCH_DISTANCE) -> DataFrame:
    """The nearest blocklist entry within ``most`` bits of each sample; ties go to the first entry.

    samples: (sample_id, phash); blocklist: (pos, known). Of equal entries only the first is compared. The bits that hashes differ
    in at all are cut into bands, chosen by ``band_plan``: each entry asks for its own value of a band and all values within its
    radius, and the distance is checked after. Where no bands prune enough (far distances, short lists) all samples are compared
    with the list, see ``_in_cells``.
    """
    samples = samples.select("sample_id", "phash").where(F.col("phash").isNotNull())
    firsts = blocklist.where(F.col("known").isNotNull()).groupBy("known").agg(F.min(F.struct("pos")).alias("p")).select("p.pos", "known")
    about = lambda df, c: df.agg(F.bit_or(c), F.bit_and(c), F.count(F.lit(1))).first()
    (any_a, all_a, n_a), (any_b, all_b, n_b) = about(samples, "phash"), about(firsts, "known")
    used = ((any_a or 0) | (any_b or 0)) & ~((-1 if all_a is None else all_a) & (-1 if all_b is None else all_b)) & (1 << 64) - 1
    first = (used & -used).bit_length() - 1 if used else 0
    bands = band_plan(used.bit_length() - first, most, n_a, n_b) if used else None
    if bands is None:
        pairs = _in_cells(samples.distinct(), firsts, math.ceil(n_a / MEET) or 1, math.ceil(n_b / BLOCK) or 1, most)
    else:
        cuts = list(itertools.accumulate((w for w, _ in bands), initial=first))
        part = lambda value, i: F.shiftrightunsigned(F.col(value), cuts[i]).bitwiseAND((1 << bands[i][0]) - 1)

        def asks(i: int) -> Column:
            width, radius = bands[i]
            flips = [sum(1 << b for b in c) for r in range(radius + 1) for c in itertools.combinations(range(width), r)]
            return F.transform(F.expr(f"array({', '.join(f'{x}L' for x in flips)})"), lambda x: F.struct(F.lit(i).alias("band"), part("known", i).bitwiseXOR(x).alias("slot")))

        mine = samples.select("sample_id", "phash", F.explode(F.array(*[F.struct(F.lit(i).alias("band"), part("phash", i).alias("slot")) for i in range(len(bands))])).alias("x"))
        asked = firsts.select("pos", "known", F.explode(F.flatten(F.array(*map(asks, range(len(bands)))))).alias("x"))
        distance = media.hamming(F.col("phash"), F.col("known"))
        pairs = mine.select("sample_id", "phash", "x.*").join(asked.select("pos", "known", "x.*"), ["band", "slot"]).where(distance <= most).withColumn("distance", distance)
    best = pairs.groupBy("sample_id").agg(F.min(F.struct("distance", "pos", "known")).alias("b"))
    return best.select("sample_id", F.col("b.known").alias("known"), F.col("b.distance").alias("distance"))


def _in_cells(samples: DataFrame, firsts: DataFrame, rows: int, columns: int, most: int) -> DataFrame:
    """(sample_id, distance, pos, known): each sample's nearest entry of each of ``columns`` parts of the list, all pairs being compared.

    ``rows`` parts of the samples meet the parts of the list in cells. A cell is a partition of its own (dealt by its hash, several
    would meet in one), so a task's work has a bound whatever the size of the tables. Samples of equal hashes in a cell are compared once.
    """
    deal = lambda n, *c: F.pmod(F.xxhash64(*c), F.lit(n)).cast("int")
    over = lambda n, cell: F.explode(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), cell)).alias("cell")
    row, column = deal(rows, "sample_id", "phash"), deal(columns, "known")
    mine = samples.select("*", over(columns, lambda i: row * columns + i)).repartitionById(rows * columns, "cell")
    listed = firsts.select("*", over(rows, lambda i: i * columns + column)).repartitionById(rows * columns, "cell")
    schema = StructType([samples.schema["sample_id"], StructField("distance", IntegerType()), *firsts.schema])

    def met(some: pa.Table, entries: pa.Table) -> pa.Table:
        entries = entries.sort_by([("pos", "ascending")], null_placement="at_start")
        hashes, index = np.unique(some["phash"].to_numpy().astype(np.int64), return_inverse=True)
        distance, at = nearest(hashes, entries["known"].to_numpy().astype(np.int64))
        near = np.flatnonzero(distance[index] <= most)
        found = entries.take(pa.array(at[index[near]]))
        return pa.Table.from_arrays([some["sample_id"].take(pa.array(near)), pa.array(distance[index[near]], pa.int32()), found["pos"], found["known"]], names=schema.names)

    return mine.groupBy("cell").cogroup(listed.groupBy("cell")).applyInArrow(met, schema)


def nearest(hashes: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and place of the nearest of ``known`` for each hash, the first one where several are; 65 bits where there is none."""
    best, at = np.full(len(hashes), 65, np.uint8), np.zeros(len(hashes), np.int64)
    for a in range(0, len(hashes), TILE[0]):
        mine, rows = slice(a, a + TILE[0]), np.arange(len(hashes[a : a + TILE[0]]))
        for b in range(0, len(known), TILE[1]):
            bits = np.bitwise_count((hashes[mine, None] ^ known[None, b : b + TILE[1]]).view(np.uint64))
            first = bits.argmin(axis=1)
            nearer = bits[rows, first] < best[mine]
            best[mine], at[mine] = np.where(nearer, bits[rows, first], best[mine]), np.where(nearer, first + b, at[mine])
    return best, at


def asset_hits(samples: DataFrame, matches: DataFrame) -> DataFrame:
    """The nearest hit of each asset's samples, first sample first."""
    rows = samples.join(matches, "sample_id").groupBy("asset").agg(F.min(F.struct("distance", "index", "known")).alias("b"))
    return rows.select("asset", "b.distance", F.col("b.index").alias("sample_index"), "b.known")


def by_area(renditions: DataFrame) -> DataFrame:
    """Renditions of each asset with their place by pixel area, largest first, ties by name: the first is the reference."""
    order = Window.partitionBy("asset").orderBy(F.desc(F.col("width") * F.col("height")), "name")
    return renditions.withColumn("pos", F.row_number().over(order))


def asset_plan(sources: DataFrame, chunks: DataFrame) -> DataFrame:
    """(source, whole, chunks, rungs, fast_rung, jobs, dedupe_key): what is submitted for each probed source that has been split."""
    chunks = chunks.groupBy("source").agg(F.first("whole").alias("whole"), F.count(F.lit(1)).alias("chunks"))
    steps = ladder_plan(sources)
    rungs = steps.groupBy("source").agg(F.count(F.lit(1)).alias("rungs"))
    fast = fast_path(steps, ["source"]).select("source", F.col("rung").alias("fast_rung"))
    rows = chunks.join(rungs, "source").join(fast, "source")
    return rows.select("*", (F.col("chunks") * F.col("rungs")).alias("jobs"), F.concat(F.lit("asset:"), F.col("source").cast("string")).alias("dedupe_key"))
