"""The state fold as a stream, and admission as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sluicework import model
from sluicework.operators import queue
from sluicework.plans import tick
from sluicework.sources import storage

#: event -> (states it fits, state it leads to); None is the state before the first event.
MOVES = {
    "submit": ({None}, "pending"), "admit": ({"pending"}, "admitted"), "run": ({"admitted"}, "running"), "release": ({"admitted"}, "pending"), "requeue": ({"admitted"}, "pending"),
    "finish": ({"pending", "admitted", "running"}, "done"), "fail": ({"pending", "admitted", "running"}, "failed"), "cancel": ({"pending", "admitted", "running"}, "canceled"),
}


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now, attempts, ignored, last = state.get if state.exists else (None, 0, 0, -1)
    for frame in frames:
        for seq, event in frame.sort_values("seq")[["seq", "event"]].itertuples(index=False):
            if seq <= last:  # late or repeated: the fold has gone past it
                ignored += 1
                continue
            fits, to = MOVES.get(event, (set(), None))
            if now in fits:
                now, attempts = to, attempts + (to == "admitted")
            else:
                ignored += 1
            last = int(seq)
    state.update((now, attempts, ignored, last))
    yield pd.DataFrame({"work_id": [key[0]], "state": [now], "attempts": [attempts], "ignored": [ignored]})


def fold_stream(events: DataFrame) -> DataFrame:
    """A row (work_id, state, attempts, ignored) for each item that a micro-batch of (seq, work_id, event) touches."""
    return events.select("seq", "work_id", "event").groupBy("work_id").applyInPandasWithState(
        _fold, "work_id string, state string, attempts int, ignored int", "state string, attempts int, ignored int, last long", "update", GroupStateTimeout.NoTimeout
    )


def lane_counts(submissions: DataFrame, window: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Submissions for each lane and window; a row later than the watermark is left out."""
    known = submissions.where(F.col("lane").isin(model.LANES)).withColumn("created_at", F.col("created_at").cast("timestamp")).withWatermark("created_at", late)
    return known.groupBy(F.window("created_at", window), "lane").agg(F.count(F.lit(1)).alias("submitted"))


class Admission:
    """A single writer that ticks once per micro-batch: new submissions join the table, then slots are given out.

    With ``path``, a folder that driver and executors share, every batch leaves a version of the work and the credits there, and then
    a mark that the version is whole. An admission that is made anew goes on from the last whole version: a batch that it finished is not
    done twice, and one that was cut off is done again from the version before. Versions before the last two are removed.
    """

    def __init__(self, budgets: DataFrame, as_of: Callable[[int], Column], config: tick.Config, cut: Callable[[DataFrame], DataFrame], path: str | None = None):
        self.budgets, self.as_of, self.config, self.cut, self.path = budgets, as_of, config, cut, path
        self.work: DataFrame | None = None
        self.credits: DataFrame | None = None
        self.done = -1
        spark = budgets.sparkSession
        if path and storage.exists(spark, f"{path}/whole"):
            self.done = spark.read.parquet(f"{path}/whole").agg(F.max("number")).first()[0]
            self.work, self.credits = (spark.read.parquet(self._place(self.done, t)) for t in ("work", "credits"))

    def _place(self, number: int, table: str) -> str:
        return f"{self.path}/{number:010d}/{table}"

    def _kept(self, df: DataFrame, number: int, table: str) -> DataFrame:
        if self.path is None:
            return self.cut(df)
        df.write.mode("overwrite").parquet(self._place(number, table))
        return df.sparkSession.read.schema(df.schema).parquet(self._place(number, table))

    def batch(self, new: DataFrame, number: int) -> None:
        if number <= self.done:  # a batch that is delivered again
            return
        work = self.cut(new if self.work is None else self.work.unionByName(new))
        credits = queue.no_credits(work) if self.credits is None else self.credits
        work, credits = tick.tick(work, self.budgets, credits, self.as_of(number), number + 1, self.config, self.cut)
        self.work, self.credits = self._kept(work, number, "work"), self._kept(credits, number, "credits")
        self.done = number
        if self.path is not None:
            spark = work.sparkSession
            spark.range(1).select(F.lit(number).cast("long").alias("number")).coalesce(1).write.mode("append").parquet(f"{self.path}/whole")
            storage.remove(spark, f"{self.path}/{number - 2:010d}")

    def start(self, submissions: DataFrame) -> DataStreamWriter:
        return submissions.writeStream.foreachBatch(self.batch)
