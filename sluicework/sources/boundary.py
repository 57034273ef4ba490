"""The seam to codecs: what decodes and encodes takes a table row and gives one back. None is shipped but a null backend."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Backend(Protocol):
    """Runs jobs (source, chunk_index, rung, start_ms, end_ms, part) and returns (…, frames, bytes, seconds)."""

    name: str

    def supports(self, codec: str) -> bool: ...

    def run(self, jobs: DataFrame) -> DataFrame: ...


class NullBackend:
    """Encodes nothing: sizes follow from the duration alone."""

    name = "null"

    def supports(self, codec: str) -> bool:
        return codec in ("h264", "h265", "av1")

    def run(self, jobs: DataFrame) -> DataFrame:
        ms = F.col("end_ms") - F.col("start_ms")
        return jobs.withColumns({"frames": F.floor(ms * 30 / 1000), "bytes": ms, "seconds": ms / 1000.0})


def first_supporting(backends: list[Backend], codec: str) -> Backend:
    for backend in backends:
        if backend.supports(codec):
            return backend
    raise LookupError(f"no backend supports {codec}")


class WorkflowEngine(Protocol):
    """Starts claimed work and says which starts failed."""

    def start(self, claimed: DataFrame) -> DataFrame: ...


class RecordingEngine:
    """Starts everything but the rows that a predicate marks, and keeps what it was given."""

    def __init__(self, fails=None):
        self.fails, self.started = fails, []

    def start(self, claimed: DataFrame) -> DataFrame:
        self.started.append(claimed)
        return claimed.withColumn("failed", self.fails if self.fails is not None else F.lit(False))
