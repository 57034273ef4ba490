"""python -m sluicework: list | query NAME SF_DIR | ladder PROBES | split KEYFRAMES | verify RENDITIONS | answer REQUESTS STATE BUDGETS | compare BEFORE AFTER | conform REPORT.

ladder, split, verify and answer read files of JSON lines. Exit code 1: a check failed."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework.operators import commands, media, reports
from sluicework.plans.queries import QUERIES
from sluicework.sources.storage import read_reports

#: Columns of the files that commands read.
FILES = {
    "probes": "source string, width long, height long, bit_rate long, rotation int, sar_num long, sar_den long",
    "keyframes": "source string, duration_ms long, ms long",
    "renditions": "asset string, pos int, name string, frame_count long, duration_ms long, keyframes array<long>, warnings array<string>, fps double",
    "requests": "seq long, verb string, target string, body string", "state": "work_id string, state string", "budgets": "tenant_id string, fairness_weight double, suspended boolean",
}
COMMANDS = {
    "list": [], "query": ["name", "sf_dir"], "ladder": ["probes"], "split": ["keyframes"], "verify": ["renditions"], "answer": ["requests", "state", "budgets"],
    "compare": ["before", "after"], "conform": ["report"],
}


def _show(df: DataFrame, as_json: bool) -> None:
    """All rows, one a line, as they come in."""
    if not as_json:
        print("\t".join(df.columns))
    for row in (df.toJSON() if as_json else df).toLocalIterator():
        print(row if as_json else "\t".join("" if x is None else str(x) for x in row))


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sluicework", description=__doc__)
    parser.add_argument("--json", action="store_true")
    parsers = parser.add_subparsers(dest="command", required=True)
    for name, args in COMMANDS.items():
        one = parsers.add_parser(name)
        for a in args:
            one.add_argument(a)
    asked = parser.parse_args(argv)
    if asked.command == "list":
        print("\n".join(sorted(QUERIES)))
        return 0
    spark = spark or SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if asked.command == "query":
        _show(QUERIES[asked.name](spark, asked.sf_dir), asked.json)
        return 0
    read = {name: spark.read.schema(FILES[name]).json(getattr(asked, name)) for name in COMMANDS[asked.command] if name in FILES}
    if asked.command == "ladder":
        _show(media.ladder_plan(read["probes"]).orderBy("source", "pos"), asked.json)
        return 0
    if asked.command == "split":
        _show(media.split_keyframes(read["keyframes"]).orderBy("source", "chunk_index"), asked.json)
        return 0
    if asked.command == "answer":
        _show(commands.answered(read["requests"], read["state"], read["budgets"]).orderBy("seq"), asked.json)
        return 0
    if asked.command == "verify":
        findings = media.verify(read["renditions"])
        _show(findings.orderBy("asset", "name", "problem"), asked.json)
        return int(not findings.isEmpty())
    if asked.command == "compare":
        before, after = read_reports(spark, asked.before), read_reports(spark, asked.after)
        diff, changes = reports.compare(before, after), reports.missing_and_added(before, after)
        _show(diff.where("regression"), asked.json)
        _show(changes, asked.json)
        _show(reports.unscored(before, after), asked.json)
        return int(not reports.diff_verdict(diff, changes).first().clean)
    body = spark.read.text(asked.report, wholetext=True).withColumnRenamed("value", "report").withColumn("manifest", F.lit(asked.report))
    findings = reports.conform_findings(body)
    _show(reports.worst_first(findings), asked.json)
    return int(not reports.conform_verdict(body).first().conformant)


if __name__ == "__main__":
    sys.exit(main())
