"""Golden cases of the queue and media rules."""

from __future__ import annotations

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sluicework.functions import media
from sluicework.operators import commands, events, fanout, queue, reports
from sluicework.operators import media as plan
from sluicework.plans import tick
from sluicework.sources import storage


def grants(spark, total, running, pending):
    rows = [(lane, r, p) for lane, r, p in zip(["realtime", "standard", "bulk"], running, pending, strict=True)]
    got = queue.lane_grants(spark.createDataFrame(rows, "lane string, running long, pending long"), total).collect()
    return [{r.lane: r.grant for r in got}[x] for x in ("realtime", "standard", "bulk")]


@pytest.mark.parametrize(
    "total, running, pending, expected",
    [(100, (0, 0, 0), (500, 500, 500), [40, 50, 10]), (100, (0, 0, 0), (5, 5, 10_000), [5, 5, 90]), (100, (0, 50, 0), (500, 500, 0), [50, 0, 0]), (0, (0, 0, 0), (1, 1, 1), [0, 0, 0])],
)
def test_lane_grants(spark, total, running, pending, expected):
    assert grants(spark, total, running, pending) == expected


def one_by_one(slots, tenants, credits):
    """The rule as a loop: tenants = {id: (weight, ceiling)}."""
    eligible = {t: v for t, v in sorted(tenants.items()) if v[1] > 0 and v[0] > 0}
    if len(credits) > len(eligible):
        credits = {t: c for t, c in credits.items() if t in eligible}
    credits = dict(credits)
    if not slots or not eligible:
        return {}, credits
    total, left, took = sum(w for w, _ in eligible.values()), slots, {}
    for t, (w, most) in eligible.items():
        credits[t] = credits.get(t, 0.0) + slots * w / total
        took[t] = min(max(0, int(credits[t] // 1)), most, left)
        credits[t] -= took[t]
        left -= took[t]
    while left:
        open_ = [t for t in eligible if took[t] < eligible[t][1]]
        if not open_:
            break
        t = min(open_, key=lambda x: (-credits[x], x))
        credits[t], took[t], left = credits[t] - 1, took[t] + 1, left - 1
    return {t: n for t, n in took.items() if n}, {t: max(-1.0, min(1.0, c)) if t in eligible else c for t, c in credits.items()}


def test_fair_share_equals_the_loop(spark):
    rng = random.Random(3)
    cases = {}
    for i in range(60):
        tenants = {f"t{k}": (rng.choice([1.0, 2.0, 5.0]), rng.choice([0, 1, 3, 40])) for k in range(rng.randint(1, 6))}
        credits = {f"t{k}": rng.randint(-8, 8) / 8 for k in range(rng.randint(0, 8))}
        cases[f"case{i}"] = (rng.choice([0, 1, 7, 30]), tenants, credits)
    cases["weights"] = (60, {"a": (5.0, 1000), "b": (1.0, 1000)}, {})
    cases["short"] = (10, {"a": (1.0, 10_000), "b": (1.0, 1)}, {})
    candidates = spark.createDataFrame([(c, t, w, m, m) for c, (_, ts, _) in cases.items() for t, (w, m) in ts.items()], "lane string, tenant_id string, weight double, headroom long, pending long")
    given = spark.createDataFrame([(c, s) for c, (s, _, _) in cases.items()], "lane string, grant long")
    carried = spark.createDataFrame([(c, t, v) for c, (_, _, cr) in cases.items() for t, v in cr.items()], "lane string, tenant_id string, credit double")
    rows = queue.fair_share(candidates, given, carried).collect()
    for case, (slots, tenants, credits) in cases.items():
        took, left = one_by_one(slots, tenants, credits)
        mine = [r for r in rows if r.lane == case]
        assert {r.tenant_id: r["take"] for r in mine if r["take"]} == took, case
        for t, c in left.items():
            assert abs(next(r.credit for r in mine if r.tenant_id == t) - c) < 1e-9, case
    by = {(r.lane, r.tenant_id): r["take"] for r in rows}
    assert (by["weights", "a"], by["weights", "b"], by["short", "a"], by["short", "b"]) == (50, 10, 9, 1)


def split(spark, keys, duration, target=10_000):
    df = spark.createDataFrame([(1, keys, duration)], "source int, keyframes array<long>, duration_ms long")
    return plan.split_plan(df, target).orderBy("chunk_index").collect()


def cut_one_by_one(keys, duration, target):
    cuts = [0]
    for k in sorted(set(keys)):
        if k - cuts[-1] >= target:
            cuts.append(k)
    return [(i, a, b) for i, (a, b) in enumerate(zip(cuts, [*cuts[1:], duration], strict=True)) if b > a] if len(cuts) > 1 else [(0, 0, duration)]


def test_split_of_streams_of_keyframes(spark):
    rng = random.Random(5)
    keys = {f"s{i}": [rng.randrange(0, 900_000) for _ in range(rng.choice([1, 3, 40, 400]))] for i in range(30)} | {"long": list(range(0, 40_000_000, 997)), None: [0, 130_000, 260_000]}
    rows = [(s, 600_000 if s != "long" else 50_000_000, k) for s, ks in keys.items() for k in ks] + [("s1", 600_000, None), ("none", 600_000, None)]
    df = spark.createDataFrame(rows, "source string, duration_ms int, ms long").repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        got = plan.split_keyframes(df, 10_000).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for source, ks in keys.items():
        mine = sorted((r.chunk_index, r.start_ms, r.end_ms) for r in got if r.source == source)
        assert mine == cut_one_by_one(ks, 50_000_000 if source == "long" else 600_000, 10_000), source
    assert [(r.whole, r.end_ms) for r in got if r.source == "none"] == [("no_keyframes", 600_000)]
    index = plan.keyframe_index(df.where("ms IS NOT NULL")).join(df.select("source", "duration_ms").distinct(), "source")
    assert sorted(map(str, plan.split_plan(index, 10_000).collect())) == sorted(str(r) for r in got if r.source not in (None, "none"))
    assert plan.split_keyframes(df.where("false")).count() == 0


def test_fold_counts_repeats(spark):
    names = ["run", "submit", "submit", None, None, "admit", *["admit"] * 50, "release", "admit", "run", "run", "finish", "finish", "cancel", "submit"]
    rows = [(i, w, "t", e, i) for w in ("a", "b") for i, e in enumerate(names)] + [(0, "c", "t", None, 0)]
    got = {r.work_id: r for r in events.fold(spark.createDataFrame(rows, "seq long, work_id string, tenant_id string, event string, ts long")).collect()}
    for w in "ab":
        assert (got[w].state, got[w].attempts, got[w].admitted_at, got[w].ignored) == ("done", 2, 57, len(names) - 6)
    assert (got["c"].state, got["c"].ignored) == (None, 1)


def test_split(spark):
    assert len(split(spark, list(range(0, 600_000, 2000)), 600_000)) == 60
    wide = split(spark, list(range(0, 600_000, 30_000)), 600_000)
    assert len(wide) == 20 and all(c.end_ms - c.start_ms >= 30_000 for c in wide)
    assert [c.whole for c in split(spark, [0], 119_999)] == ["too_short"]
    assert [c.whole for c in split(spark, [], 200_000)] == ["no_keyframes"]
    assert [c.whole for c in split(spark, [0, 5000], 200_000)] == ["keyframes_too_sparse"]
    late = split(spark, [0, 150_000], 150_000)
    assert [(c.chunk_index, c.start_ms, c.end_ms) for c in late] == [(0, 0, 150_000)]


def ladder(spark, w, h, rate=None, rotation=0, num=1, den=1):
    schema = "source int, width long, height long, bit_rate long, rotation int, sar_num int, sar_den int"
    return [(r.rung, r.width, r.height) for r in plan.ladder_plan(spark.createDataFrame([(1, w, h, rate, rotation, num, den)], schema)).orderBy("pos").collect()]


def test_ladder(spark):
    assert ladder(spark, 1920, 1080) == [("1080p", 1920, 1080), ("720p", 1280, 720), ("480p", 854, 480), ("360p", 640, 360)]
    assert ladder(spark, 426, 240) == [("360p", 426, 240)]
    assert ladder(spark, 0, 1080) == []
    assert ladder(spark, 1920, 1080, rate=800_000) == [("360p", 640, 360)]
    assert ladder(spark, 1280, 720, rotation=90)[0] == ("1080p", 608, 1080)


def scalar(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_scalars(spark):
    lit = F.lit
    assert tuple(scalar(spark, media.display_size(lit(1280), lit(720), lit(90), lit(1), lit(1)))) == (720, 1280)
    assert tuple(scalar(spark, media.job_size(lit(480), lit(1280), lit(720)))) == (854, 480)
    assert tuple(scalar(spark, media.job_size(lit(1080), lit(640), lit(360)))) == (640, 360)
    assert scalar(spark, media.straggler_budget_ms(lit(10_000), lit(3))) == 120_000
    assert scalar(spark, media.straggler_budget_ms(lit(200), lit(1))) == 60_000
    assert scalar(spark, media.default_gop(lit(29.97))) == 60 and scalar(spark, media.default_gop(lit(0.0))) == 48
    assert scalar(spark, media.rate(lit(1), lit(0))) == 0.0
    assert len(scalar(spark, media.sample_times_ms(lit(120)))) == 60
    assert scalar(spark, media.work_id_of(lit("wf-fake-1-2-3-4-5"))) == "1-2-3-4-5" and scalar(spark, media.work_id_of(lit("a-b"))) is None
    assert scalar(spark, media.part_name(lit("720p"), lit(7))) == "720p-00007.mp4" and scalar(spark, media.thumb_name(lit(12))) == "00000012ms.jpg"
    down, flat = F.array(*[lit(255 - c * 20) for _ in range(8) for c in range(9)]), F.array(*[lit(5)] * 72)
    assert scalar(spark, media.dhash(down, 9, 8)) == -1 and scalar(spark, media.dhash(flat, 9, 8)) == 0
    assert len(scalar(spark, media.path_id(lit("/a")))) == 36
    assert scalar(spark, media.needs_mezzanine(lit(1), F.array(lit("no_audio")))) is False


def test_encoder_options(spark):
    spec = lambda **k: F.struct(*[F.lit(v).alias(n) for n, v in ({"codec": "h264", "preset": "medium", "mode": "crf", "crf": 23, "max_bitrate": 1000, "buffer_size": 2000, "bitrate": 5, "gop_frames": 60} | k).items()], F.create_map(F.lit("tune"), F.lit("film")).alias("extra"))
    plain = scalar(spark, media.encoder_options(spec()))
    assert plain["maxrate"] == "1000" and plain["sc_threshold"] == "0" and plain["tune"] == "film"
    other = scalar(spark, media.encoder_options(spec(codec="h265")))
    assert other["x265-params"] == "vbv-maxrate=1:vbv-bufsize=2:keyint=60:min-keyint=60:scenecut=0:open-gop=0" and "maxrate" not in other


def test_warnings(spark):
    row = (0, 5, 90, 4, 3, 30, 1, 25, 1, "smpte2084", 2, 0, [0, 20_000], [1, None, 0])
    names = "duration_ms start_time rotation sar_num sar_den avg_num avg_den real_num real_den transfer n_video n_audio keyframes dts".split()
    kinds = ["long"] * 9 + ["string", "int", "int", "array<long>", "array<long>"]
    df = spark.createDataFrame([row], ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    got = df.select(media.warnings_of(F.struct(*names)).alias("w")).first().w
    assert got == ["variable_frame_rate", "rotation_metadata", "non_monotonic_timestamps", "start_time_offset", "sparse_keyframes", "unknown_duration", "multiple_video_streams", "no_audio", "non_square_pixels", "hdr_transfer"]


def test_verify(spark):
    schema = "asset int, pos int, name string, frame_count long, duration_ms long, keyframes array<long>, warnings array<string>, fps double"
    rows = [(1, 1, "1080p", 240, 8000, [0], [], 30.0), (1, 2, "720p", 210, 8030, [0], [], 30.0), (1, 3, "480p", None, 8500, [0, 1], ["rotation_metadata", "no_audio"], 30.0), (2, 1, "a", None, 1, [], [], None)]
    got = {(r.asset, r.name, r.problem) for r in plan.verify(spark.createDataFrame(rows, schema)).collect()}
    assert got == {(1, "720p", "frame_count"), (1, "480p", "duration"), (1, "480p", "keyframe_mismatch"), (1, "480p", "unexpected_warning"), (2, "a", "no_video")}


def test_blocklist(spark):
    known = spark.createDataFrame([(0, -1), (1, 0b111), (2, 1)], "pos long, known long")
    got = plan.blocklist_match(spark.createDataFrame([(5, 0), (6, 0x5555555555555555)], "sample_id long, phash long"), known).collect()
    assert [(r.sample_id, r.known, r.distance) for r in got] == [(5, 1, 1)]


def test_compare(spark):
    rows = lambda v: spark.createDataFrame([("f", "720p", "vmaf", v), ("f", "720p", "other", 0.0)], "file string, rung string, metric string, value double")
    assert [r.regression for r in reports.compare(rows(95.0), rows(94.4)).where("metric = 'vmaf'").collect()] == [True]
    assert [r.regression for r in reports.compare(rows(95.0), rows(94.6)).where("metric = 'vmaf'").collect()] == [False]
    assert [r.change for r in reports.missing_and_added(rows(1.0), rows(1.0).limit(0)).collect()] == ["missing"]
    assert reports.diff_verdict(reports.compare(rows(1.0), rows(1.0)), reports.missing_and_added(rows(1.0).limit(0), rows(1.0))).first().clean


def test_conform(spark):
    failing = {"verdict": "FAIL", "entries": {"a": [{"x": {"test": [{"spec": "S", "section": "", "test": "T", "messages": ["✗ bad", "! odd", "✓ good", "!  "], "state": "FAIL"}, {"state": "PASS", "messages": ["✗ no"]}]}}], "test": "not a list"}}
    bare = {"test": [{"spec": "S", "test": "T", "state": "FAIL"}]}
    df = spark.createDataFrame([(1, json.dumps(failing)), (2, json.dumps(bare)), (3, json.dumps({"verdict": "PASS"}))], "id int, report string")
    got = sorted((r.id, r.severity, r.section, r.message) for r in reports.conform_findings(df).collect())
    assert got == [(1, "error", "S / T", "bad"), (1, "warning", "S / T", "odd"), (2, "error", "S / T", "failed")]
    assert reports.conform_tests(df).groupBy("id").count().count() == 2
    assert reports.at_least(reports.conform_findings(df), "error").count() == 2


def test_vmaf_report(spark):
    body = json.dumps({"frames": [{"frameNum": 0}, {"frameNum": 1}], "pooled_metrics": {"vmaf": {"mean": 95.0, "min": 90.0, "max": 99.0}, "psnr_y": {"mean": 40.0, "min": 1.0, "max": 50.0}}})
    row = reports.vmaf_metrics(spark.createDataFrame([(1, body)], "id int, report string")).first()
    assert row.frames == 2 and row.vmaf["mean"] == 95.0 and row.cambi is None
    with pytest.raises(Exception, match="lacks vmaf"):
        reports.vmaf_metrics(spark.createDataFrame([(1, "{}")], "id int, report string")).collect()


def test_queue_edges(spark):
    schema = "id string, tenant_id string, kind string, lane string, priority_key int, fairness_weight double, state string, workflow_id string, attempts int, created_at timestamp_ntz, admitted_at timestamp_ntz"
    work = spark.createDataFrame([], schema)
    as_of = F.lit("2024-01-01").cast("timestamp_ntz")
    assert queue.capacity_report(work, as_of, 0).count() == 3
    with pytest.raises(LookupError):
        queue.budget(spark.createDataFrame([], "tenant_id string"), "x")
    with pytest.raises(ValueError):
        queue.work_list(work, state="odd")
    assert queue.scoped(spark.createDataFrame([("a",)], "tenant_id string"), "tenant").count() == 0
    with pytest.raises(Exception, match="unknown lane"):
        queue.decoded(spark.createDataFrame([("pending", "odd")], "state string, lane string")).collect()


def test_tick_drains_and_bounds_attempts(spark):
    import datetime

    schema = "id string, tenant_id string, kind string, lane string, priority_key int, fairness_weight double, state string, workflow_id string, attempts int, created_at timestamp_ntz, admitted_at timestamp_ntz"
    when = datetime.datetime(2024, 1, 1)
    rows = [(f"w{i}", f"t{i % 2}", "fake", "standard", 0, 1.0, "pending", None, 4 if i == 0 else 0, when, None) for i in range(12)]
    limits = spark.createDataFrame([("t0", 100, 100, False), ("t1", 2, 100, False)], "tenant_id string, max_concurrent_tasks int, rate_limit_per_min int, suspended boolean")
    as_of = F.lit("2024-01-02").cast("timestamp_ntz")
    work, credits = tick.tick(spark.createDataFrame(rows, schema), limits, queue.no_credits(limits), as_of, 1, tick.Config(), storage.cut, fails=F.col("id").isin("w0", "w2"))
    state = {r.id: (r.state, r.attempts) for r in work.collect()}
    assert state["w0"] == ("failed", 5) and state["w2"] == ("pending", 1)
    assert sum(s == "running" for s, _ in state.values()) == 6 and sum(state[f"w{i}"][0] == "running" for i in range(1, 12, 2)) == 2
    assert credits.count() >= 2


def test_first_latest_billed(spark):
    rows = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, "z")], "k string, seq int, v string")
    assert {(r.k, r.v) for r in events.latest_wins(rows, ["k"], "seq").collect()} == {("a", "x"), ("b", "z")}
    assert [r.v for r in events.first_wins(rows, ["k"], ["seq"]).where("created and k = 'a'").collect()] == ["y"]
    costs = spark.createDataFrame([("w", 5, 1.0), ("w", 9, 1.0)], "work_id string, seq int, cpu_seconds double")
    ends = spark.createDataFrame([("w", 5, "finish"), ("w", 9, "finish")], "work_id string, seq int, event string")
    assert events.billed(costs, ends).count() == 1


def test_fanout(spark):
    chunks = spark.createDataFrame([(1, i, i * 10, i * 10 + 10) for i in range(12)], "source int, chunk_index int, start_ms long, end_ms long")
    rungs = spark.createDataFrame([(1, "720p"), (1, "360p")], "source int, rung string")
    parts = fanout.join_parts(fanout.chunk_rung_jobs(chunks, rungs)).where("rung = '720p'").first().parts
    assert parts == [f"720p-{i:05d}.mp4" for i in range(12)]


def test_report_files(spark, tmp_path):
    body = {"created_unix": 1, "entries": [{"file": "f", "rungs": [{"name": "720p", "scores": {"vmaf": 95.0, "psnr_y": 40.0}}, {"name": "360p", "scores": None}]}]}
    (tmp_path / "r.json").write_text(json.dumps(body, indent=1))
    rows = storage.read_reports(spark, str(tmp_path / "r.json"))
    assert rows.where("rung = '720p' and metric = 'vmaf'").first().value == 95.0
    assert [r.rung for r in reports.unscored(rows, rows).collect()] == ["360p"]
    (tmp_path / "t1/assets/a1/720p").mkdir(parents=True)
    (tmp_path / "t1/assets/a1/720p/x.mp4").write_text("x")
    (tmp_path / "t1/assets/a1/720p/.hidden.mp4").write_text("x")
    listed = storage.listing(spark, str(tmp_path / "t1/assets/a1/720p"), "*.mp4")
    assert [r.name for r in listed.collect()] == ["x.mp4"] and storage.landed(listed).first().asset == "a1"
    with pytest.raises(ValueError):
        storage.required({"bucket": " "}, "bucket")


def test_ranges_and_names(spark):
    lit = F.lit
    assert [scalar(spark, media.place_in_range(lit(x), lit(10), lit(20))) for x in (9, 10, 19, 20)] == ["before", "inside", "inside", "after"]
    assert scalar(spark, media.rotation_of(lit(-90.2))) == 90 and scalar(spark, media.rotation_of(lit(450.0))) == -90
    assert scalar(spark, media.published_language(lit("und"))) is None and scalar(spark, media.published_language(lit("de"))) == "de"
    assert scalar(spark, media.start_name(lit("fake"), lit("7"))) == "wf-fake-7"


def test_first_place_of_a_rung_counts(spark, tmp_path):
    rung = lambda v: {"name": "720p", "scores": {"vmaf": v, "psnr_y": 40.0}}
    body = {"created_unix": 1, "entries": [{"file": "f", "rungs": [rung(95.0), rung(10.0)], "findings": ["odd size", "no audio"]}, {"file": "g", "rungs": [], "findings": ["odd size"]}]}
    (tmp_path / "r.json").write_text(json.dumps(body))
    rows = storage.read_reports(spark, str(tmp_path / "r.json"))
    both = reports.compare(rows, rows).where("metric = 'vmaf'").collect()
    assert [(r.before, r.after) for r in both] == [(95.0, 95.0)]
    assert sorted(r.finding for r in storage.read_findings(spark, str(tmp_path / "r.json")).collect()) == ["f: no audio", "f: odd size", "g: odd size"]


def test_near_hashes_are_all_found(spark):
    rng = random.Random(5)
    known = [rng.getrandbits(56) for _ in range(40)]
    near = [(i, known[i % 40] ^ sum(1 << b for b in rng.sample(range(56), i % 14))) for i in range(400)]
    got = plan.blocklist_match(spark.createDataFrame(near, "sample_id long, phash long"), spark.createDataFrame(list(enumerate(known)), "pos long, known long")).collect()
    want = {i: min(((h ^ k).bit_count(), p) for p, k in enumerate(known)) for i, h in near}
    assert {r.sample_id: (r.distance, known.index(r.known)) for r in got} == {i: w for i, w in want.items() if w[0] <= 10}


def test_positions_and_codecs(spark):
    table = lambda rows, c: spark.createDataFrame(rows, f"asset int, pos int, {c} string")
    rows = fanout.zip_positions([table([(1, 0, "a"), (1, 1, "b"), (1, 2, "c")], "x"), table([(1, 0, "p"), (1, 1, "q")], "y"), table([(1, 1, "v"), (1, 0, "u")], "z")], ["asset"])
    assert sorted((r.pos, r.x, r.y, r.z) for r in rows.collect()) == [(0, "a", "p", "u"), (1, "b", "q", "v")]
    assert scalar(spark, media.codec_of(F.lit("HEVC"))) == "h265" and scalar(spark, media.rate_text(F.lit(30), F.lit(1))) == "30/1"
    with pytest.raises(Exception, match="unknown codec"):
        scalar(spark, media.codec_of(F.lit("theora")))


def test_reports_are_written_and_read_again(spark, tmp_path):
    runs = spark.createDataFrame([("a", 7, "n7.1", "slow", 5), ("b", 8, "n7.1", "fast", 1)], "run string, created_unix long, ffmpeg string, preset string, subsample int")
    files = spark.createDataFrame(
        [("a", "g.mp4", 2, 100, ["no_audio"], ["odd size"], 1.5), ("a", "f.mp4", 1, 200, [], [], 2.5)],
        "run string, file string, pos int, duration_ms long, warnings array<string>, findings array<string>, encode_seconds double",
    )
    rungs = spark.createDataFrame([("a", "f.mp4", "360p", 1, 640, 360, 10, 100), ("a", "f.mp4", "720p", 0, 1280, 720, 10, 400)], "run string, file string, rung string, pos int, width int, height int, frames long, bytes long")
    scores = spark.createDataFrame([("a", "f.mp4", "720p", m, v) for m, v in (("vmaf", 95.5), ("vmaf_min", 80.0), ("psnr_y", 41.0))], "run string, file string, rung string, metric string, value double")
    storage.write_reports(reports.assemble(runs, files, rungs, scores), str(tmp_path / "r"))
    text = next((tmp_path / "r/run=a").glob("*.txt")).read_text()
    assert text.count("\n") > 30 and json.loads(text) == {
        "created_unix": 7, "ffmpeg": "n7.1", "preset": "slow", "subsample": 5,
        "entries": [
            {"file": "f.mp4", "duration_ms": 200, "warnings": [], "encode_seconds": 2.5, "findings": [], "rungs": [
                {"name": "720p", "width": 1280, "height": 720, "frames": 10, "bytes": 400, "scores": {"vmaf": 95.5, "vmaf_min": 80.0, "psnr_y": 41.0, "ssim": None, "ms_ssim": None, "ciede2000": None, "cambi": None}},
                {"name": "360p", "width": 640, "height": 360, "frames": 10, "bytes": 100, "scores": None},
            ]},
            {"file": "g.mp4", "duration_ms": 100, "warnings": ["no_audio"], "encode_seconds": 1.5, "findings": ["odd size"], "rungs": []},
        ],
    }
    rows = storage.read_reports(spark, str(tmp_path / "r/run=a"))
    changes = reports.missing_and_added(rows, rows)
    assert reports.diff_verdict(reports.compare(rows, rows), changes).first() == (0, 0, 0, True)
    assert reports.compare(rows, rows).where("delta = 0").count() == 3 and [r.rung for r in reports.unscored(rows, rows).collect()] == ["360p"]
    kept = {r.created_unix: (r.ffmpeg, r.preset, r.subsample, len(r.entries)) for r in storage.read_runs(spark, str(tmp_path / "r")).collect()}
    assert kept == {7: ("n7.1", "slow", 5, 2), 8: ("n7.1", "fast", 1, 0)}
    assert [r.finding for r in storage.read_findings(spark, str(tmp_path / "r/run=a")).collect()] == ["g.mp4: odd size"]


def test_what_is_not_permitted_is_not_seen(spark):
    from sluicework.sources import scopes

    of = lambda *tenants: spark.createDataFrame([(t, i) for i, t in enumerate(tenants)], "tenant_id string, n int")
    scopes.open_views(spark, work=of("a", "b", "b", None, ""), tenant_budgets=of("a", "b"), work_cost=of("b"))
    counts = lambda: [spark.table(f"scoped_{t}").count() for t in scopes.TABLES]
    assert counts() == [0, 0, 0]  # unset
    scopes.set_scope(spark, "service")
    assert counts() == [5, 2, 1]
    scopes.set_scope(spark, tenant="b")
    assert counts() == [2, 1, 1]
    scopes.set_scope(spark, "service", "b")  # either rule permits
    assert counts() == [5, 2, 1]
    scopes.set_scope(spark, "tenant", "' OR '1' = '1")
    assert counts() == [0, 0, 0]
    scopes.set_scope(spark)
    assert counts() == [0, 0, 0]
    with pytest.raises(ValueError):
        scopes.open_views(spark, other=of("a"))


def test_requests_that_cannot_be_read(spark):
    body = lambda **x: json.dumps(x)
    asked = [
        (1, "submit", None, body(tenant_id="t", dedupe_key="k", lane="bulk")), (2, "submit", None, body(tenant_id="t", dedupe_key="k", lane="bulk")), (3, "submit", None, "{"), (4, "submit", None, None),
        (5, "submit", None, body(tenant_id="t", dedupe_key="k", lane="fast")), (6, "submit", None, body(tenant_id="u", dedupe_key="k", lane="bulk")), (7, "submit", None, body(tenant_id="s", dedupe_key="k", lane="bulk")),
        (8, "get", "1", None), (9, "get", "2", None), (10, "finish", "1", body(state="done")), (11, "finish", "1", body(state="gone")), (12, "finish", "2", "no"), (13, "cancel", "1", None), (14, "drop", "1", None), (15, None, None, None),
        (16, "budget", "t", body(max_concurrent_tasks=1, rate_limit_per_min=0)), (17, "budget", "t", body(max_concurrent_tasks=-1, rate_limit_per_min=0)), (18, "budget", "t", body(max_concurrent_tasks="many", rate_limit_per_min=0)),
    ]
    requests = spark.createDataFrame(asked, "seq long, verb string, target string, body string")
    budgets = spark.createDataFrame([("t", 1.0, False), ("s", 1.0, True)], "tenant_id string, fairness_weight double, suspended boolean")
    got = {r.seq: r.status for r in commands.answered(requests, spark.createDataFrame([("1", "running")], "work_id string, state string"), budgets).collect()}
    assert got == {1: 201, 2: 200, 3: 400, 4: 400, 5: 400, 6: 422, 7: 403, 8: 200, 9: 404, 10: 200, 11: 400, 12: 400, 13: 200, 14: 400, 15: 400, 16: 204, 17: 400, 18: 400}


@pytest.mark.parametrize(("most", "n", "known", "kind"), [(3, 50_000, 20_000, "bands"), (16, 300, 200, "blocks"), (10, 10**9, 10**5, "bands"), (40, 10**9, 10**6, "blocks")])
def test_bands_follow_distance_and_size(most, n, known, kind):
    bands = plan.band_plan(64, most, n, known)
    assert (bands is None) == (kind == "blocks")
    if bands:
        widths, radii = zip(*bands, strict=True)
        # Two hashes that differ in ``most`` bits cannot differ in more than the radius in every band.
        assert sum(widths) == 64 and sum(r + 1 for r in radii) == most + 1 and plan.pair_share(bands) < 0.02


@pytest.mark.parametrize("plan_of", ["bands", "blocks", "small blocks"])
def test_every_plan_finds_the_same_matches(spark, monkeypatch, plan_of):
    rng = random.Random(11)
    known = [rng.getrandbits(56) for _ in range(60)]
    samples = [k ^ sum(1 << b for b in rng.sample(range(56), rng.randint(0, 14))) for k in known for _ in range(4)] + [rng.getrandbits(56) for _ in range(100)]
    a = spark.createDataFrame(list(enumerate(samples)), "sample_id long, phash long")
    b = spark.createDataFrame([*enumerate(known), (60, known[5])], "pos long, known long")
    monkeypatch.setattr(plan, "band_plan", (lambda width, most, *_: plan.bands_of(width, most, 4)) if plan_of == "bands" else lambda *_: None)
    monkeypatch.setattr(plan, "BLOCK", 7 if plan_of == "small blocks" else plan.BLOCK)
    got = {r.sample_id: (r.distance, r.known) for r in plan.blocklist_match(a, b, 10).collect()}
    want = {}
    for i, x in enumerate(samples):
        d, at = min(((x ^ k).bit_count(), pos) for pos, k in enumerate(known))
        if d <= 10:
            want[i] = (d, known[at])
    assert got == want and len(got) > 100


def test_deep_reports(spark):
    test = {"test": [{"spec": "S", "test": f"t{i}", "state": "FAIL", "messages": [f"✗ {i}"]} for i in range(2)], "x": [{"test": [{"test": "later"}]}]}
    deep = "[" * 900 + json.dumps(test) + "]" * 900
    rows = spark.createDataFrame([(1, deep)], "id int, report string")
    assert [r.test for r in reports.conform_tests(rows).collect()] == ["t0", "t1", "later"]
    with pytest.raises(Exception, match="nested too deeply"):
        reports.conform_tests(spark.createDataFrame([(1, "[" * 100_000 + "]" * 100_000)], "id int, report string")).collect()


def test_findings_keep_the_order_of_their_report(spark):
    tests = [{"spec": "Z", "state": "FAIL", "messages": ["! later", "✗ b", "✗ a"]}, {"spec": "A", "state": "FAIL", "messages": ["✗ c"]}]
    rows = spark.createDataFrame([(json.dumps({"test": tests}),)], "report string")
    assert [(r.severity, r.message) for r in reports.worst_first(reports.conform_findings(rows)).collect()] == [("error", "c"), ("error", "b"), ("error", "a"), ("warning", "later")]


def test_listings_are_in_order(spark, tmp_path):
    for name in ("b.MP4", "a.mkv", "c.txt", ".d.mp4", "mp4", "e.tar.mov"):
        (tmp_path / name).write_text("x")
    assert [r.name for r in storage.listing(spark, str(tmp_path), extensions=["mp4", ".mkv", "mov"]).collect()] == ["a.mkv", "e.tar.mov"]
    assert [r.name for r in storage.listing(spark, str(tmp_path)).collect()] == ["a.mkv", "b.MP4", "c.txt", "e.tar.mov", "mp4"]


def test_hashes_are_compared_in_cells_of_bounded_size(spark, monkeypatch):
    rng = random.Random(3)
    known = [rng.getrandbits(64) - (1 << 63) for _ in range(50)]
    samples = [rng.getrandbits(64) - (1 << 63) for _ in range(200)] + [7] * 200
    # Equal entries and samples, nulls on both sides; an entry without a place comes first.
    listed = [*enumerate([*known, *known[:20]]), (None, known[3]), (70, None)]
    monkeypatch.setattr(plan, "MEET", 50)
    monkeypatch.setattr(plan, "BLOCK", 9)
    monkeypatch.setattr(plan, "TILE", (16, 4))
    sizes = spark.sparkContext.accumulator(0)
    work = plan.nearest

    def counted(hashes, entries):
        sizes.add(len(hashes) * len(entries))
        # Cells deal by hash, so they are even on average only.
        assert len(hashes) <= 2 * 50 and len(entries) <= 3 * 9
        return work(hashes, entries)

    monkeypatch.setattr(plan, "nearest", counted)
    a = spark.createDataFrame([*enumerate(samples), (400, None)], "sample_id long, phash long")
    b = spark.createDataFrame(listed, "pos long, known long")
    got = {r.sample_id: (r.distance, r.known) for r in plan.blocklist_match(a, b, 32).collect()}
    apart = lambda x, k: ((x ^ k) & (1 << 64) - 1).bit_count()
    want = {i: min((apart(x, k), -1 if pos is None else pos, k) for pos, k in listed if k is not None) for i, x in enumerate(samples)}
    assert got == {i: (d, k) for i, (d, _, k) in want.items() if d <= 32}
    # 200 equal samples are compared once in each of their cells at most, and each entry once.
    assert 0 < sizes.value <= (200 + 8) * 50
    distance, at = work(np.array(samples[:40]), np.array(known))
    assert [(d, i) for d, i in zip(distance, at, strict=True)] == [min((apart(x, k), i) for i, k in enumerate(known)) for x in samples[:40]]


@pytest.mark.parametrize("n_samples, n_known", [(0, 3), (3, 0), (0, 0)])
def test_hash_matching_of_empty_tables(spark, n_samples, n_known):
    a = spark.createDataFrame([(i, i) for i in range(n_samples)], "sample_id long, phash long")
    b = spark.createDataFrame([(i, i) for i in range(n_known)], "pos long, known long")
    assert plan.blocklist_match(a, b).collect() == []


def test_asset_hits_over_several_cells(spark, monkeypatch):
    rng = random.Random(8)
    known = [rng.getrandbits(56) for _ in range(30)]
    hashes = [rng.choice(known) ^ sum(1 << b for b in rng.sample(range(56), rng.randint(0, 12))) for _ in range(120)]
    monkeypatch.setattr(plan, "MEET", 20)
    monkeypatch.setattr(plan, "BLOCK", 6)
    cells = []
    inner = plan._in_cells
    monkeypatch.setattr(plan, "_in_cells", lambda a, b, rows, columns, most: cells.append((rows, columns)) or inner(a, b, rows, columns, most))
    samples = spark.createDataFrame([(i, i // 10, i % 10, h) for i, h in enumerate(hashes)], "sample_id long, asset long, index long, phash long")
    listed = spark.createDataFrame(list(enumerate(known)), "pos long, known long")
    got = {tuple(r) for r in plan.asset_hits(samples.drop("phash"), plan.blocklist_match(samples.select("sample_id", "phash"), listed, 16)).collect()}
    near = [min(((h ^ k).bit_count(), pos) for pos, k in enumerate(known)) for h in hashes]
    best = [min((d, i, pos) for i, (d, pos) in enumerate(near[a * 10 : a * 10 + 10])) for a in range(12)]
    assert got == {(a, d, i, known[pos]) for a, (d, i, pos) in enumerate(best) if d <= 16} and cells == [(6, 5)]


def test_every_cell_is_a_partition_of_its_own(spark):
    rng = random.Random(12)
    a = spark.createDataFrame([(i, rng.getrandbits(56)) for i in range(400)], "sample_id long, phash long")
    b = spark.createDataFrame([(i, rng.getrandbits(56)) for i in range(90)], "pos long, known long")
    # Every sample is within 64 bits of each part of the list, so it gives a row in each of three cells.
    found = plan._in_cells(a, b, 8, 3, 64).groupBy(F.spark_partition_id()).count().collect()
    assert len(found) == 24 and sum(r["count"] for r in found) == 3 * 400 and max(r["count"] for r in found) < 100
