"""One admission tick, and a run of them, as functions of the work table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sluicework import model
from sluicework.functions import media
from sluicework.operators import queue


@dataclass
class Config:
    total_slots: int = model.TOTAL_SLOTS
    rate_window: str = "1 MINUTE"
    stall_seconds: float = model.STALL_SECONDS
    max_attempts: int = model.MAX_ATTEMPTS
    sweep_every: int = model.SWEEP_EVERY_TICKS


def sweep(work: DataFrame, as_of: Column, config: Config) -> DataFrame:
    """Admitted rows without a workflow, older than the limit, are pending again."""
    limit = as_of - F.make_interval(secs=F.lit(config.stall_seconds))
    lost = (F.col("state") == "admitted") & F.col("workflow_id").isNull() & (F.col("admitted_at") < limit)
    return work.withColumns({"state": F.when(lost, "pending").otherwise(F.col("state")), "admitted_at": F.when(~F.coalesce(lost, F.lit(False)), F.col("admitted_at"))})


def tick(work: DataFrame, budgets: DataFrame, credits: DataFrame, as_of: Column, number: int, config: Config, cut, fails: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(work, credits) after one tick.

    Lanes take their turn one after the other, since a tenant's headroom shrinks as an earlier lane claims; there are
    three of them, and ``cut`` ends the lineage after each. ``fails`` marks rows whose start fails: they go back to pending, or are failed after the last attempt.
    """
    if number % config.sweep_every == 0:
        work = sweep(work, as_of, config)
    grants = cut(queue.lane_grants(queue.fleet_state(work), config.total_slots).where(F.col("grant") > 0))
    kept = []
    for lane in model.LANES:
        # A lane without a grant or a candidate keeps its credits as they are.
        waiting = queue.candidates(work, budgets, as_of, config.rate_window).where(F.col("lane") == lane)
        shared = cut(queue.fair_share(waiting, grants.where(F.col("lane") == lane), credits.where(F.col("lane") == lane), cut))
        kept.append(shared.select("lane", "tenant_id", "credit"))
        took = queue.claim(work, shared).select(F.col("id").alias("_sw_id"), F.lit(True).alias("_sw_took"))
        rows = work.join(took, work["id"] == took["_sw_id"], "left").drop("_sw_id")
        taken = F.col("_sw_took").isNotNull()
        bad = taken & (fails if fails is not None else F.lit(False))
        again = bad & (F.col("attempts") + 1 < config.max_attempts)
        state = F.when(again, "pending").when(bad, "failed").when(taken, "running").otherwise(F.col("state"))
        work = cut(rows.withColumns({
            "state": state, "admitted_at": F.when(again, F.lit(None)).when(taken, as_of).otherwise(F.col("admitted_at")),
            "attempts": F.col("attempts") + F.when(taken, 1).otherwise(0), "workflow_id": F.when(taken & ~bad, media.start_name(F.col("kind"), F.col("id"))).otherwise(F.col("workflow_id")),
        }).drop("_sw_took"))
    merged = kept[0]
    for k in kept[1:]:
        merged = merged.unionByName(k)
    return work, merged


def run(work: DataFrame, budgets: DataFrame, as_of: Column, ticks: int, config: Config, cut) -> tuple[DataFrame, DataFrame]:
    """Several ticks; ``cut`` writes a frame and reads it again, so plans stay short and lost executors cost one lane."""
    credits = queue.no_credits(work)
    for n in range(1, ticks + 1):
        work, credits = tick(work, budgets, credits, as_of, n, config, cut)
        credits = cut(credits)
    return work, credits
