"""Chunk-by-rung fan-out and ordered fan-in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sluicework.functions import media
from sluicework.operators import scan


def chunk_rung_jobs(chunks: DataFrame, rungs: DataFrame) -> DataFrame:
    """Every chunk of a source with every rung of the same source: (source, chunk_index, rung, part, start_ms, end_ms)."""
    jobs = chunks.select("source", "chunk_index", "start_ms", "end_ms").join(rungs.select("source", "rung"), "source")
    return jobs.withColumn("part", media.part_name(F.col("rung"), F.col("chunk_index")))


def join_parts(jobs: DataFrame) -> DataFrame:
    """(source, rung, parts): the parts of each rung in the order of the chunks."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "part")))
    return jobs.groupBy("source", "rung").agg(F.transform(parts, lambda x: x["part"]).alias("parts"))


def join_offsets(jobs: DataFrame, duration: str = "duration_ms", width: int = scan.WIDTH) -> DataFrame:
    """The timestamp at which each part starts in the joined rung: what the parts before it last."""
    rows = scan.before(jobs, ["source", "rung"], ["chunk_index"], duration, scan.SUM, "offset_ms", width)
    return rows.withColumn("offset_ms", F.coalesce("offset_ms", F.lit(0)))


def straggler_budgets(jobs: DataFrame) -> DataFrame:
    """How long each chunk may take before it is given out again."""
    rows = jobs.groupBy("source", "chunk_index", "start_ms", "end_ms").agg(F.count("rung").alias("rungs"))
    return rows.select("source", "chunk_index", "rungs", media.straggler_budget_ms(F.col("end_ms") - F.col("start_ms"), F.col("rungs")).alias("budget_ms"))


def ready(rungs: DataFrame, landed: DataFrame) -> DataFrame:
    """Rungs whose rendition has landed."""
    return rungs.join(landed, ["source", "rung"], "left_semi")


def zip_positions(tables: list[DataFrame], keys: list[str]) -> DataFrame:
    """The rows of all tables that have the same place (``pos``) in the same key; what the shortest lacks is left out."""
    rows = tables[0]
    for other in tables[1:]:
        rows = rows.join(other, [*keys, "pos"])
    return rows


def totals(parts: DataFrame) -> DataFrame:
    """Frames, bytes and seconds over all parts."""
    return parts.agg(F.sum("frames").alias("frames"), F.sum("bytes").alias("bytes"), F.sum("seconds").alias("seconds"))
