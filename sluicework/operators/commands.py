"""What callers may ask of the queue, as rows to append to the event log and the cost table.

Nothing is updated in place: a command reads the folded state and gives the events that it leads to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicework import model
from sluicework.operators.events import admitted_submissions

#: What a caller is told for each kind of failure.
STATUS = {"created": 201, "existing": 200, "found": 200, "stored": 204, "not_found": 404, "no_budget": 422, "suspended": 403, "bad_request": 400}
#: Fields of the bodies that callers send.
BODY = "tenant_id string, dedupe_key string, lane string, state string, max_concurrent_tasks int, rate_limit_per_min int"


def _events(rows: DataFrame, event: Column | str, seq: Column, ts: Column) -> DataFrame:
    return rows.select(seq.alias("seq"), "work_id", "tenant_id", (F.lit(event) if isinstance(event, str) else event).alias("event"), ts.alias("ts"))


def cancel(state: DataFrame, asked: DataFrame, ts: Column) -> tuple[DataFrame, DataFrame]:
    """(events, answers) for (work_id, seq): an ended item stays as it is, an unknown one is not_found."""
    found = asked.join(state.select("work_id", "tenant_id", "state"), "work_id", "left")
    open_ = F.col("state").isNotNull() & ~F.col("state").isin(model.TERMINAL)
    answers = found.select("work_id", F.when(F.col("state").isNull(), "not_found").when(open_, "canceled").otherwise(F.col("state")).alias("outcome"))
    return _events(found.where(open_), "cancel", F.col("seq"), ts), answers


def finish(state: DataFrame, reports: DataFrame, ts: Column, bill_repeats: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, costs, answers) for (work_id, seq, state, cpu_seconds, bytes_written, machine).

    Only done and failed are states to finish in. A cost counts with the first report that ends an item;
    ``bill_repeats`` counts every one.
    """
    now = state.select("work_id", "tenant_id", F.col("state").alias("was"))
    place = F.row_number().over(Window.partitionBy("work_id", F.col("state").isin("done", "failed")).orderBy("seq"))
    rows = reports.join(now, "work_id", "left").withColumn("place", place)
    valid, known = F.col("state").isin("done", "failed"), F.col("was").isNotNull()
    ends = valid & known & ~F.col("was").isin(model.TERMINAL) & (F.col("place") == 1)
    outcome = F.when(~known, "not_found").when(~valid, "bad_request").when(ends, F.col("state")).otherwise(F.col("was"))
    billed = rows.where((valid & known if bill_repeats else ends) & ((F.col("cpu_seconds") > 0) | (F.col("bytes_written") > 0)))
    events = _events(rows.where(ends), F.when(F.col("state") == "done", "finish").otherwise("fail"), F.col("seq"), ts)
    return events, billed.select("work_id", "seq", "cpu_seconds", "bytes_written", "machine"), rows.select("work_id", "seq", outcome.alias("outcome"))


def requeue(stalled: DataFrame, first_seq: int, ts: Column) -> DataFrame:
    """Events that take stalled rows (id, tenant_id) back to the queue, numbered from ``first_seq``.

    Numbers leave gaps: they only need to be larger than all before them and never the same."""
    rows = stalled.select(F.col("id").alias("work_id"), "tenant_id")
    return _events(rows, "requeue", F.monotonically_increasing_id() + first_seq, ts)


def set_budgets(changes: DataFrame) -> DataFrame:
    """Budget changes (tenant_id, seq, …) that are valid; limits below zero are an error."""
    bad = (F.col("max_concurrent_tasks") < 0) | (F.col("rate_limit_per_min") < 0)
    return changes.withColumn("max_concurrent_tasks", F.when(bad, F.raise_error(F.concat(F.lit("bad budget of "), "tenant_id"))).otherwise(F.col("max_concurrent_tasks")))


def answered(requests: DataFrame, state: DataFrame, budgets: DataFrame) -> DataFrame:
    """(seq, outcome, status) for requests (seq, verb, target, body): what each is answered, in the order of ``seq``.

    Verbs: submit, budget (target a tenant), get, cancel and finish (target an item). A body that is no JSON or lacks a field, a lane or
    final state that is none, a limit below zero and an unknown verb are bad requests; they change nothing for those after
    them. state: (work_id, state) before the requests; budgets as for ``events.admitted_submissions``.
    """
    rows = requests.select("seq", "verb", "target", F.from_json("body", BODY).alias("b"))
    submit = rows.where(F.col("verb") == "submit").select("seq", "b.tenant_id", "b.dedupe_key", "b.lane")
    good = F.coalesce(F.col("tenant_id").isNotNull() & F.col("dedupe_key").isNotNull() & F.col("lane").isin(model.LANES), F.lit(False))
    submitted = admitted_submissions(submit.where(good), budgets).select("seq", "outcome")
    refused = submit.where(~good).select("seq", F.lit("bad_request").alias("outcome"))
    found = rows.where(F.col("verb").isin("get", "cancel", "finish")).join(state.select(F.col("work_id").alias("target"), F.col("state").alias("was")), "target", "left")
    ends = F.coalesce(F.col("b.state").isin("done", "failed"), F.lit(False)) | (F.col("verb") != "finish")
    outcome = F.when(~ends, "bad_request").when(F.col("was").isNull(), "not_found").otherwise("found")
    limits = [F.coalesce(F.col(f"b.{c}") >= 0, F.lit(False)) for c in ("max_concurrent_tasks", "rate_limit_per_min")]
    stored = rows.where(F.col("verb") == "budget").select("seq", F.when(limits[0] & limits[1], "stored").otherwise("bad_request").alias("outcome"))
    known = F.coalesce(F.col("verb").isin("submit", "get", "cancel", "finish", "budget"), F.lit(False))
    others = rows.where(~known).select("seq", F.lit("bad_request").alias("outcome"))
    all_rows = submitted.unionByName(refused).unionByName(found.select("seq", outcome.alias("outcome"))).unionByName(stored).unionByName(others)
    status = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return all_rows.withColumn("status", F.element_at(status, F.col("outcome")))
