from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sluicework.__main__ import main
from sluicework.operators import commands
from sluicework.sources import boundary

def ts():
    return F.lit("2024-01-01").cast("timestamp_ntz")


@pytest.fixture(scope="module")
def state(spark):
    return spark.createDataFrame([("a", "t", "running"), ("b", "t", "done"), ("c", "t", "pending")], "work_id string, tenant_id string, state string")


def test_cancel(spark, state):
    events, answers = commands.cancel(state, spark.createDataFrame([("a", 1), ("b", 2), ("x", 3)], "work_id string, seq long"), ts())
    assert [(r.work_id, r.event) for r in events.collect()] == [("a", "cancel")]
    assert {r.work_id: r.outcome for r in answers.collect()} == {"a": "canceled", "b": "done", "x": "not_found"}


def test_finish_bills_once(spark, state):
    rows = [("a", 1, "done", 2.0, 5, "m"), ("a", 2, "done", 2.0, 5, "m"), ("b", 3, "failed", 1.0, 0, "m"), ("c", 4, "odd", 1.0, 0, "m"), ("x", 5, "done", 1.0, 0, "m"), ("c", 6, "failed", 0.0, 0, "m")]
    reports = spark.createDataFrame(rows, "work_id string, seq long, state string, cpu_seconds double, bytes_written long, machine string")
    events, costs, answers = commands.finish(state, reports, ts())
    assert sorted((r.work_id, r.seq, r.event) for r in events.collect()) == [("a", 1, "finish"), ("c", 6, "fail")]
    assert [(r.work_id, r.seq) for r in costs.collect()] == [("a", 1)]
    assert {r.seq: r.outcome for r in answers.collect()} == {1: "done", 2: "running", 3: "done", 4: "bad_request", 5: "not_found", 6: "failed"}
    assert commands.finish(state, reports, ts(), bill_repeats=True)[1].count() == 3


def test_requeue_and_budgets(spark):
    rows = spark.createDataFrame([("a", "t"), ("b", "t")], "id string, tenant_id string")
    assert [r.seq >= 100 for r in commands.requeue(rows, 100, ts()).collect()] == [True, True]
    with pytest.raises(Exception, match="bad budget of t"):
        commands.set_budgets(spark.createDataFrame([("t", -1, 1)], "tenant_id string, max_concurrent_tasks int, rate_limit_per_min int")).collect()


def test_seam(spark):
    jobs = spark.createDataFrame([(1, 0, "720p", 0, 1000, "p")], "source int, chunk_index int, rung string, start_ms long, end_ms long, part string")
    assert boundary.first_supporting([boundary.NullBackend()], "h264").run(jobs).first().frames == 30
    with pytest.raises(LookupError):
        boundary.first_supporting([boundary.NullBackend()], "vp8")
    assert boundary.RecordingEngine(F.lit(True)).start(jobs).first().failed


def test_command_line(spark, tmp_path, sf_dir, capsys):
    report = lambda v: {"entries": [{"file": "f", "rungs": [{"name": "720p", "scores": {"vmaf": v, "vmaf_min": 1.0, "psnr_y": 40.0}}]}]}
    for name, v in (("a", 95.0), ("b", 94.6), ("c", 94.0)):
        (tmp_path / f"{name}.json").write_text(json.dumps(report(v)))
    path = lambda n: str(tmp_path / f"{n}.json")
    assert main(["compare", path("a"), path("b")], spark) == 0 and main(["--json", "compare", path("a"), path("c")], spark) == 1
    (tmp_path / "pass.json").write_text(json.dumps({"verdict": "PASS", "test": [{"state": "PASS"}]}))
    (tmp_path / "none.json").write_text(json.dumps({"verdict": "PASS"}))
    assert main(["conform", path("pass")], spark) == 0 and main(["conform", path("none")], spark) == 1
    assert main(["--json", "query", "lane_grants", sf_dir], spark) == 0 and main(["list"], spark) == 0
    assert "realtime" in capsys.readouterr().out


def test_commands_on_files(spark, tmp_path, capsys):
    def file(name, *rows):
        (tmp_path / name).write_text("\n".join(map(json.dumps, rows)))
        return str(tmp_path / name)

    def said(*argv):
        code = main(["--json", *argv], spark)
        return code, [json.loads(line) for line in capsys.readouterr().out.splitlines()]

    code, rows = said("ladder", file("p", {"source": "a", "width": 1920, "height": 1080, "rotation": 0, "sar_num": 1, "sar_den": 1}))
    assert code == 0 and [(r["rung"], r["width"], r["height"]) for r in rows][:2] == [("1080p", 1920, 1080), ("720p", 1280, 720)] and len(rows) == 4
    code, rows = said("split", file("k", *({"source": "a", "duration_ms": 600_000, "ms": i * 2000} for i in range(300))))
    assert code == 0 and len(rows) == 60 and rows[-1]["end_ms"] == 600_000
    good = {"asset": "x", "pos": 1, "name": "720p", "frame_count": 240, "duration_ms": 8000, "keyframes": [0], "warnings": [], "fps": 30.0}
    assert said("verify", file("v", good, good | {"pos": 2, "name": "480p"})) == (0, [])
    code, rows = said("verify", file("v", good, good | {"pos": 2, "name": "480p", "frame_count": 210}))
    assert code == 1 and [(r["name"], r["problem"], r["expected"], r["actual"]) for r in rows] == [("480p", "frame_count", "240", "210")]
    asked = file("r", {"seq": 2, "verb": "get", "target": "1"}, {"seq": 1, "verb": "submit", "body": json.dumps({"tenant_id": "t", "dedupe_key": "k", "lane": "bulk"})})
    code, rows = said("answer", asked, file("s", {"work_id": "1", "state": "running"}), file("b", {"tenant_id": "t", "fairness_weight": 1.0, "suspended": False}))
    assert code == 0 and [r["status"] for r in rows] == [201, 200]
