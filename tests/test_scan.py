"""Running values, folds and cuts over keys that are spread over many tasks, against plain Python."""

from __future__ import annotations

import bisect
import random

import pytest
from pyspark.sql import functions as F

from sluicework import model
from sluicework.operators import events, fanout, media, scan
from sluicework.streaming.state import MOVES

HOT = 3000


@pytest.fixture(scope="module")
def rows(spark):
    """One key with two thirds of all rows, a null key, null values, a null in the order."""
    rng = random.Random(4)
    data = [("hot", i, rng.choice([None, *range(50)])) for i in range(HOT)] + [(f"k{i % 40}", i, rng.randint(0, 9)) for i in range(1200)] + [(None, i, i % 7) for i in range(300)] + [("hot", None, 5)]
    rng.shuffle(data)
    return spark.createDataFrame(data, "key string, at long, v long").repartition(5).cache()


def by_key(rows):
    out = {}
    for r in sorted(rows.collect(), key=lambda r: (r.at is not None, r.at)):
        out.setdefault(r.key, []).append((r.at, r.v))
    return out


@pytest.mark.parametrize("width", [7, 100, 1000, 10**9])
def test_running_values(rows, width):
    sums = {(r.key, r.at): r.x for r in scan.before(rows, ["key"], ["at"], "v", scan.SUM, "x", width).collect()}
    lasts = {(r.key, r.at): r.x for r in scan.before(rows, ["key"], ["at"], "v", scan.LAST, "x", width).collect()}
    n = 0
    for key, pairs in by_key(rows).items():
        total = last = None
        for at, v in pairs:
            assert (sums[key, at], lasts[key, at]) == (total, last)
            if v is not None:
                total, last = (total or 0) + v, v
            n += 1
    assert n == len(sums) == len(lasts) == HOT + 1501


@pytest.mark.parametrize("least", [50, 400])
def test_a_hot_key_is_cut_into_even_ranges(rows, least):
    ranges = scan.key_ranges(rows, ["key"], "at", least)
    sizes = scan.placed(rows, ["key"], "at", ranges).where(F.col(scan.PART).isNotNull()).groupBy("key", scan.PART).count().collect()
    assert {r.key for r in sizes} == ({"hot", None} if least == 50 else {"hot"})
    assert max(r["count"] for r in sizes) <= 1.5 * least and sum(r["count"] for r in sizes if r.key == "hot") == HOT + 1
    assert scan.placed(rows, ["key"], "at", ranges).count() == rows.count()


def test_equal_places_and_no_rows(spark):
    same = spark.createDataFrame([("a", 1, 2)] * 500, "key string, at long, v long")
    assert scan.key_ranges(same, ["key"], "at", 10).count() <= 2
    assert scan.before(same, ["key"], ["at"], "v", scan.SUM, "x", 10).agg(F.max("x")).first()[0] == 998
    assert scan.before(same.limit(0), ["key"], ["at"], "v", scan.LAST, "x", 10).count() == 0


def slow_fold(history):
    state, attempts, admitted, finished, ignored = None, 0, None, None, 0
    for _, event, ts in history:
        fits, to = MOVES.get(event, (set(), None))
        if state not in fits:
            ignored += 1
            continue
        state, attempts = to, attempts + (to == "admitted")
        if to in ("admitted", "pending"):
            admitted = ts if to == "admitted" else None
        if to in model.TERMINAL:
            finished = ts
    return state, attempts, admitted, finished, ignored


@pytest.fixture(scope="module")
def history(spark):
    rng, rows = random.Random(8), []
    names = [*MOVES, "unknown"]
    for item in range(60):
        rows += [(i, f"w{item}", f"t{item % 3}", rng.choice(names), i * 10) for i in range(rng.randint(1, 40))]
    # A third of all events and more: an open item whose state goes round, repeats and events out of place.
    turns = ["admit", "release", "run", "admit", "requeue", "submit", "unknown", "admit", "admit", "release"]
    rows += [(0, "hot", "t0", "submit", 0), *((i, "hot", "t0", turns[i % 10], i * 10) for i in range(1, 2000)), *((2001, "hot", "t0", "run", 9) for _ in range(50))]
    rows += [(i, "ended", "t1", e, i) for i, e in enumerate(["submit", "finish", *["run", "admit", "run"] * 100])]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "seq long, work_id string, tenant_id string, event string, ts long").repartition(4).cache()


@pytest.mark.parametrize(("block", "least"), [(4096, 10**9), (5, 10**9), (4, 30), (5, 10), (100, 150)])
def test_fold_of_any_blocks_and_ranges(history, block, least):
    rows, frame = history
    want = {}
    for seq, item, tenant, event, ts in sorted(rows, key=lambda r: (r[0], r[3], r[4])):
        want.setdefault((item, tenant), []).append((seq, event, ts))
    got = {(r.work_id, r.tenant_id): tuple(r)[2:] for r in events.fold(frame, block, least).collect()}
    assert got == {k: slow_fold(h) for k, h in want.items()}
    assert got["hot", "t0"][4] > 400


def test_a_hot_item_is_spread(history):
    """No range holds more than its share, and the sums of an item are as many as its ranges."""
    _, frame = history
    keys = ["work_id", "tenant_id"]
    placed = scan.placed(frame, keys, "seq", scan.key_ranges(frame, keys, "seq", 100))
    sizes = placed.where("work_id = 'hot'").groupBy(scan.PART).count().collect()
    assert len(sizes) > 15 and max(r["count"] for r in sizes) <= 200


def slow_cuts(duration, keys, target):
    if duration is not None and duration < model.MIN_SPLITTABLE_MS:
        return [("too_short", 0, 0, duration)]
    if not keys:
        return [("no_keyframes", 0, 0, duration)]
    keys, cuts = sorted(set(keys)), [0]
    while (i := bisect.bisect_left(keys, cuts[-1] + target)) < len(keys):
        cuts.append(keys[i])
    if len(cuts) == 1:
        return [("keyframes_too_sparse", 0, 0, duration)]
    ends = cuts[1:] + ([duration] if duration is not None and duration > cuts[-1] else [])
    return [(None, i, a, b) for i, (a, b) in enumerate(zip(cuts, ends, strict=False))]


@pytest.mark.parametrize(("target", "span"), [(1000, 1), (1000, 3), (10_000, 2), (10_000, 64), (1, 5)])
def test_cuts_of_any_ranges(spark, target, span):
    rng, sources = random.Random(target + span), {}
    for s in range(40):
        top = rng.choice([150_000, 400_000])
        step = rng.choice([50, 700, 3000, 45_000])
        sources[s] = (rng.choice([None, top, top + 1, 90_000]), [rng.randrange(-500, top) for _ in range(rng.choice([0, 1, min(top // step, 400)]))])
    sources[99] = (900_000, list(range(0, 900_000, 100)))  # over half of all keyframes
    if target == 1:
        sources = {s: (d, k[:300]) for s, (d, k) in sources.items()}
    rows = [(s, d, ms) for s, (d, keys) in sources.items() for ms in [*keys, *keys[:3], *([] if keys else [None])]]
    frame = spark.createDataFrame(rows, "source long, duration_ms long, ms long").repartition(4)
    got = {}
    for r in media.split_keyframes(frame, target, span).collect():
        got.setdefault(r.source, []).append((r.whole, r.chunk_index, r.start_ms, r.end_ms))
    assert {s: sorted(c, key=lambda x: x[1]) for s, c in got.items()} == {s: c for s, (d, k) in sources.items() if (c := slow_cuts(d, k, target))}


def test_one_source_is_many_ranges(spark):
    frame = spark.range(50_000).select(F.lit("a").alias("source"), F.lit(10**8).cast("long").alias("duration_ms"), (F.col("id") * 2000).alias("ms"))
    chunks = media.split_keyframes(frame)
    assert chunks.count() == 10_000
    sizes = frame.where("ms >= 10000").groupBy(F.floor(F.col("ms") / (10_000 * media.SPAN))).count()
    assert sizes.count() > 150 and sizes.agg(F.max("count")).first()[0] <= 320


def test_gaps_and_offsets_of_hot_keys(spark):
    ms = sorted(random.Random(1).sample(range(10**6), 3000))
    frame = spark.createDataFrame([("a", m) for m in ms] + [("b", 5), ("b", 400_000)], "source string, ms long")
    got = sorted((r.source, r.before_ms, r.ms, r.gap_ms) for r in media.sparse_gaps(frame, 900, width=40).collect())
    assert got == sorted([("a", a, b, b - a) for a, b in zip(ms, ms[1:], strict=False) if b - a > 900] + [("b", 5, 400_000, 399_995)])
    jobs = spark.createDataFrame([("a", "r", i, i % 5 + 1) for i in range(1000)], "source string, rung string, chunk_index int, duration_ms long")
    offsets = [r.offset_ms for r in fanout.join_offsets(jobs, width=30).orderBy("chunk_index").collect()]
    assert offsets == [sum(i % 5 + 1 for i in range(n)) for n in range(1000)]
