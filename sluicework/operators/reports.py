"""Quality reports: pooled metrics, their comparison, conformance findings."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework import model
from sluicework.functions.tables import LOWER_IS_BETTER, METRICS, TOLERANCE


def pooled(frames: DataFrame, keys: list[str]) -> DataFrame:
    return frames.groupBy(*keys, "metric").agg(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"), F.count(F.lit(1)).alias("frames"))


def gate(pooled_rows: DataFrame, keys: list[str], least: float = model.GATE_VMAF) -> DataFrame:
    """Whether each rendition's mean of the first metric reaches the threshold."""
    return pooled_rows.where(F.col("metric") == "vmaf").select(*keys, "mean", (F.col("mean") >= least).alias("passed"))


def tolerance_of(metric: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TOLERANCE.items() for x in pair])
    return F.coalesce(F.try_element_at(known, metric), F.lit(float("inf")))


def first_rungs(rows: DataFrame, by: list[str]) -> DataFrame:
    """The rows of the first place of each rung, where rows have a place; a rung that is listed again is left out."""
    if "pos" not in rows.columns:
        return rows
    first = rows.groupBy(*by).agg(F.min("pos").alias("pos"))
    return rows.join(first, [*by, "pos"], "left_semi")


def compare(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., file, rung, metric, before, after, delta, worse, regression) of the metrics that both runs have.

    before, after: (by..., file, rung, metric, value) and, where a rung may be listed twice, pos: the first place counts.
    ``by`` tells several comparisons apart, which are made at once."""
    keys = [*(by or []), "file", "rung"]
    before, after = first_rungs(before, keys), first_rungs(after, keys)
    keys = [*keys, "metric"]
    rows = before.select(*keys, F.col("value").alias("before")).join(after.select(*keys, F.col("value").alias("after")), keys)
    delta = F.col("after") - F.col("before")
    worse = F.when(F.col("metric").isin(LOWER_IS_BETTER), delta).otherwise(-delta)
    return rows.select("*", delta.alias("delta"), worse.alias("worse"), (worse > tolerance_of(F.col("metric"))).alias("regression"))


def missing_and_added(before: DataFrame, after: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(by..., file, rung, change): rungs that only one of the runs has."""
    keys = [*(by or []), "file", "rung"]
    a, b = (x.select(*keys).distinct() for x in (before, after))
    both = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), keys, "full")
    return both.where(F.col("a").isNull() | F.col("b").isNull()).select(*keys, F.when(F.col("b").isNull(), "missing").otherwise("added").alias("change"))


def unscored(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rungs of both runs without scores in one of them: they are skipped by ``compare``, so they are listed."""
    count = lambda x, c: x.groupBy("file", "rung").agg(F.count("value").alias(c))
    both = count(before, "n_before").join(count(after, "n_after"), ["file", "rung"])
    return both.where((F.col("n_before") == 0) | (F.col("n_after") == 0))


def diff_verdict(compared: DataFrame, changes: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts, and whether the change is clean (no regression, nothing missing): one row, or with ``by`` one for each comparison
    that found anything to compare or to list."""
    keys = by or []
    what = compared.select(*keys, F.when(F.col("regression"), "regression").alias("change")).unionByName(changes.select(*keys, "change"))
    counts = what.groupBy(*keys).agg(*[F.count_if(F.col("change") == c).alias(n) for c, n in (("regression", "regressions"), ("missing", "missing"), ("added", "added"))])
    return counts.withColumn("clean", (F.col("regressions") == 0) & (F.col("missing") == 0))


def conform_findings(reports: DataFrame, body: str = "report") -> DataFrame:
    """(…, severity, section, message, place) from reports in JSON: every ``test`` array at any depth; ``place`` tells their order.

    Only the walk for those arrays is Python, on Arrow batches: depth is open, and a recursive query has a limit of rows.
    """
    keys = [c for c in reports.columns if c != body]
    tests = conform_tests(reports, body)
    failed = tests.where(~F.coalesce(F.col("state") == "PASS", F.lit(False)))
    section = F.array_join(F.filter(F.array(*[F.coalesce(F.col(c), F.lit("")) for c in ("spec", "section", "test")]), lambda x: x != ""), " / ")
    # An entry without messages is one error.
    said = failed.select(*keys, "place", section.alias("section"), F.posexplode(F.coalesce("messages", F.array(F.lit("failed")))).alias("i", "m")).where(F.col("m").isNotNull())
    mark = F.substring("m", 1, 1)
    severity = F.when(mark == "✗", "error").when(mark == "!", "warning").when(mark == "✓", None).otherwise("error")
    text = F.trim(F.when(mark.isin("✗", "!"), F.expr("substring(m, 2)")).otherwise(F.col("m")))
    return said.select(*keys, severity.alias("severity"), "section", text.alias("message"), (F.shiftleft("place", 32) + F.col("i")).alias("place")).where(F.col("severity").isNotNull() & (F.col("message") != ""))


def conform_verdict(reports: DataFrame, body: str = "report") -> DataFrame:
    """(…, tests_run, errors, warnings, passed, conformant): a report conforms if it says so, tests ran and none found an error."""
    keys = [c for c in reports.columns if c != body]
    ran = conform_tests(reports, body).groupBy(*keys).agg(F.count(F.lit(1)).alias("tests_run"))
    found = conform_findings(reports, body).groupBy(*keys).agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    rows = reports.select(*keys, F.coalesce(F.get_json_object(body, "$.verdict") == "PASS", F.lit(False)).alias("passed")).join(ran, keys, "left").join(found, keys, "left")
    counts = {c: F.coalesce(c, F.lit(0)) for c in ("tests_run", "errors", "warnings")}
    rows = rows.withColumns(counts)
    return rows.withColumn("conformant", F.col("passed") & (F.col("tests_run") > 0) & (F.col("errors") == 0))


def _test_entries(node) -> Iterator[dict]:
    """Entries of the ``test`` arrays below a JSON value, in their order; nothing inside such an array is looked at again."""
    waiting = [(None, node)]
    while waiting:
        key, node = waiting.pop()
        if key == "test" and isinstance(node, list):
            yield from (x if isinstance(x, dict) else {} for x in node)
        elif isinstance(node, dict):
            waiting += reversed(node.items())
        elif isinstance(node, list):
            waiting += ((None, child) for child in reversed(node))


def _parsed(report: str):
    try:
        return json.loads(report)
    except RecursionError:
        raise ValueError("a report is nested too deeply to be read") from None


def conform_tests(reports: DataFrame, body: str = "report") -> DataFrame:
    """The entries of all ``test`` arrays: (…, spec, section, test, state, messages, place). A report that is not JSON, or
    is nested deeper than the parser reads (thousands of levels), is an error that says so."""
    keys = [f for f in reports.schema if f.name != body]
    text = lambda x: x if isinstance(x, str) else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, report in enumerate(batch.column(len(keys)).to_pylist()):
                for place, t in enumerate(_test_entries(_parsed(report)) if report is not None else ()):
                    said = t.get("messages")
                    at.append(i)
                    rows.append([*(text(t.get(c)) for c in ("spec", "section", "test", "state")), [m for m in said if isinstance(m, str)] if isinstance(said, list) else None, place])
            columns = list(zip(*rows, strict=True)) or [[]] * 6
            kept = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(len(keys))]
            values = [*(pa.array(c, pa.string()) for c in columns[:4]), pa.array(columns[4], pa.list_(pa.string())), pa.array(columns[5], pa.int64())]
            yield pa.RecordBatch.from_arrays([*kept, *values], [*(f.name for f in keys), "spec", "section", "test", "state", "messages", "place"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in keys), "spec string, section string, test string, state string, messages array<string>, place long"])
    return reports.select(*[F.col(f.name) for f in keys], body).mapInArrow(read, schema)


def at_least(findings: DataFrame, severity: str) -> DataFrame:
    return findings.where(model.rank(F.col("severity"), model.SEVERITIES) <= model.SEVERITIES.index(severity))


def worst_first(findings: DataFrame) -> DataFrame:
    """The worst first, then by section, and what is left equal in the order of its report."""
    return findings.orderBy(model.rank(F.col("severity"), model.SEVERITIES), "section", "place")


def vmaf_metrics(reports: DataFrame, body: str = "report") -> DataFrame:
    """Pooled metrics of a report in JSON; the two required ones are an error when they are missing."""
    stat = "struct<mean:double,min:double,max:double>"
    names = {"vmaf": True, "psnr_y": True, "float_ssim": False, "float_ms_ssim": False, "ciede2000": False, "cambi": False}
    schema = f"frames array<struct<frameNum:long>>, pooled_metrics struct<{','.join(f'{n}:{stat}' for n in names)}>"
    keys = [c for c in reports.columns if c != body]
    rows = reports.select(*keys, F.from_json(body, schema).alias("j"))

    def metric(n: str, required: bool) -> Column:
        value = F.col(f"j.pooled_metrics.{n}")
        return F.when(value.isNull(), F.raise_error(F.lit(f"report lacks {n}"))).otherwise(value).alias(n) if required else value.alias(n)

    return rows.select(*keys, F.coalesce(F.when(F.col("j.frames").isNotNull(), F.size("j.frames")), F.lit(0)).alias("frames"), *[metric(n, r) for n, r in names.items()])


def build(files: DataFrame, probes: DataFrame, scores: DataFrame) -> DataFrame:
    """(file, finding, rung, scored) for every file of a corpus.

    A file that could not be read, or that has no video, is an entry with a finding and never left out.
    files: (file); probes: (file, n_video); scores: (file, rung, metric, value)."""
    entries = files.join(probes, "file", "left").withColumn("finding", F.when(F.col("n_video").isNull(), "unreadable").when(F.col("n_video") == 0, "no video"))
    rungs = scores.groupBy("file", "rung").agg((F.count("value") > 0).alias("scored"))
    whole = entries.where(F.col("finding").isNull()).select("file", "finding").join(rungs, "file", "left").withColumn("scored", F.coalesce("scored", F.lit(False)))
    bad = entries.where(F.col("finding").isNotNull()).select("file", "finding", F.lit(None).cast("string").alias("rung"), F.lit(False).alias("scored"))
    return whole.unionByName(bad)


def assemble(runs: DataFrame, files: DataFrame, rungs: DataFrame, scores: DataFrame) -> DataFrame:
    """(run, report): a nested report for each run, its files and their rungs in the order of ``pos``.

    runs: (run, created_unix, ffmpeg, preset, subsample); files: (run, file, pos, duration_ms, warnings, findings, encode_seconds);
    rungs: (run, file, rung, pos, width, height, frames, bytes); scores: (run, file, rung, metric, value). A rung without scores has
    null for them, a file without rungs none, a run without files no entries.
    """
    kept = F.struct(*[F.max(F.when(F.col("metric") == m, F.col("value"))).alias(m) for m in METRICS])
    scored = scores.groupBy("run", "file", "rung").agg(kept.alias("scores"))
    in_order = lambda what: F.transform(F.array_sort(F.collect_list(F.struct("pos", what.alias("x")))), lambda r: r["x"])
    as_int = lambda c, kind="long": F.col(c).cast(kind).alias(c)
    rung = F.struct(F.col("rung").alias("name"), as_int("width", "int"), as_int("height", "int"), as_int("frames"), as_int("bytes"), "scores")
    by_file = rungs.join(scored, ["run", "file", "rung"], "left").groupBy("run", "file").agg(in_order(rung).alias("rungs"))
    listed = files.join(by_file, ["run", "file"], "left").withColumn("rungs", F.coalesce("rungs", F.array().cast(by_file.schema["rungs"].dataType)))
    entry = F.struct("file", as_int("duration_ms"), "warnings", as_int("encode_seconds", "double"), "rungs", "findings")
    entries = listed.groupBy("run").agg(in_order(entry).alias("entries"))
    rows = runs.join(entries, "run", "left").withColumn("entries", F.coalesce("entries", F.array().cast(entries.schema["entries"].dataType)))
    return rows.select("run", F.struct("created_unix", "ffmpeg", "preset", "subsample", "entries").alias("report"))
