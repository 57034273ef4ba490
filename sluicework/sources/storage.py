"""Shared folders, listings and report files."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REPORT = """created_unix long, ffmpeg string, preset string, subsample int, entries array<struct<file: string, duration_ms: long, warnings: array<string>, encode_seconds: double,
  rungs: array<struct<name: string, width: int, height: int, frames: long, bytes: long,
    scores: struct<vmaf: double, vmaf_min: double, psnr_y: double, ssim: double, ms_ssim: double, ciede2000: double, cambi: double>>>,
  findings: array<string>>>"""


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of the session and read again: its lineage ends there."""
    spark = df.sparkSession
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(base)
    path = f"{base.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written, if it is there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def listing(spark: SparkSession, root: str, pattern: str = "*", extensions: list[str] | None = None) -> DataFrame:
    """(path, name, length, modified) of the files of a folder in the order of their paths, without hidden ones; with ``extensions``
    only those that have one of them, as it is spelled."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root).select("path", "length", F.col("modificationTime").alias("modified"))
    named = files.withColumn("name", F.element_at(F.split("path", "/"), -1)).where(~F.startswith("name", F.lit(".")))
    if extensions is not None:
        named = named.where(F.regexp_extract("name", r".\.([^.]+)$", 1).isin([e.lstrip(".") for e in extensions]))
    return named.select("path", "name", "length", "modified").orderBy("path")


def landed(listed: DataFrame) -> DataFrame:
    """(tenant, asset, rendition) of paths that follow {tenant}/assets/{asset}/{rendition}/."""
    part = lambda i: F.regexp_extract("path", r"([^/]+)/assets/([^/]+)/([^/]+)/", i)
    return listed.select(part(1).alias("tenant"), part(2).alias("asset"), part(3).alias("rendition")).where(F.col("asset") != "").distinct()


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    """(file, rung, metric, value, pos) of a report file; a rung without scores has nulls; ``pos`` is the rung's place in the file."""
    report = spark.read.schema(REPORT).option("multiLine", True).json(path)
    rungs = report.select(F.posexplode("entries").alias("i", "e")).select("i", "e.file", F.posexplode_outer("e.rungs").alias("j", "r"))
    metrics = F.map_entries(F.create_map(*[x for m in ("vmaf", "vmaf_min", "psnr_y", "ssim", "ms_ssim", "ciede2000", "cambi") for x in (F.lit(m), F.col(f"r.scores.{m}"))]))
    place = F.shiftleft(F.col("i").cast("long"), 32) + F.col("j")
    rows = rungs.where(F.col("r").isNotNull()).select("file", F.col("r.name").alias("rung"), place.alias("pos"), F.explode(metrics).alias("m"))
    return rows.select("file", "rung", F.col("m.key").alias("metric"), F.col("m.value").alias("value"), "pos")


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    """(file, finding) of all entries of a report file, each finding with its file before it."""
    report = spark.read.schema(REPORT).option("multiLine", True).json(path)
    rows = report.select(F.explode("entries").alias("e")).select("e.file", F.explode("e.findings").alias("finding"))
    return rows.select("file", F.concat_ws(": ", "file", "finding").alias("finding"))


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """(created_unix, ffmpeg, preset, subsample, entries): a row a report file, whole."""
    return spark.read.schema(REPORT).option("multiLine", True).json(path)


def write_reports(reports: DataFrame, path: str) -> None:
    """One indented file for each row (run, report), in the folder run=... of ``path``; fields without a value are null."""
    text = F.to_json("report", {"pretty": "true", "ignoreNullFields": "false"})
    reports.select("run", text.alias("value")).write.mode("overwrite").partitionBy("run").text(path)


def required(options: dict[str, str | None], name: str) -> str:
    """A storage option; a blank one counts as missing."""
    value = (options.get(name) or "").strip()
    if not value:
        raise ValueError(f"storage option {name} is not set")
    return value
