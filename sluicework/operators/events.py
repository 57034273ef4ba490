"""State as a fold of an append-only event table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicework import model
from sluicework.operators import scan


def first_wins(submissions: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Idempotent insert: each submission with ``created``, true for the first of its key in a total order.

    The first row is found by partial aggregation and joined back, so one key may hold any share of the rows.
    """
    firsts = submissions.groupBy(*keys).agg(F.min(F.struct(*order)).alias("_sw_first")).select(*[F.col(k).alias(f"_sw_{k}") for k in keys], "_sw_first")
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_sw_{k}"))
    joined = submissions.join(firsts, on).withColumn("created", F.struct(*order) == F.col("_sw_first"))
    return joined.drop("_sw_first", *[f"_sw_{k}" for k in keys])


def latest_wins(changes: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Upsert: of each key the row with the largest ``seq``; partial aggregation keeps one row a key and task."""
    rest = [c for c in changes.columns if c not in keys]
    best = changes.groupBy(*keys).agg(F.max(F.struct(F.col(seq).alias("_sw_seq"), *[F.col(c) for c in rest])).alias("_sw_row"))
    return best.select(*keys, *[F.col(f"_sw_row.{c}").alias(c) for c in rest])


def admitted_submissions(submissions: DataFrame, budgets: DataFrame) -> DataFrame:
    """(…, outcome, fairness_weight): created, existing, no_budget or suspended; the weight is the tenant's at submission.

    With a column ``seq``, ``budgets`` is a history, and each submission meets the change in force when it came."""
    if "seq" in budgets.columns:
        until = F.lead("seq").over(Window.partitionBy("tenant_id").orderBy("seq"))
        spans = budgets.select(F.col("tenant_id").alias("_sw_tenant"), F.col("seq").alias("_sw_from"), until.alias("_sw_until"), "fairness_weight", "suspended")
        in_force = (F.col("tenant_id") == F.col("_sw_tenant")) & (F.col("seq") >= F.col("_sw_from")) & (F.col("_sw_until").isNull() | (F.col("seq") < F.col("_sw_until")))
        rows = submissions.join(spans, in_force, "left").drop("_sw_tenant", "_sw_from", "_sw_until")
    else:
        rows = submissions.join(budgets.select("tenant_id", "fairness_weight", "suspended"), "tenant_id", "left")
    rows = rows.withColumn("_sw_open", F.col("suspended").isNotNull() & ~F.col("suspended"))
    rows = first_wins(rows, ["tenant_id", "dedupe_key", "_sw_open"], ["seq"])
    outcome = F.when(F.col("suspended").isNull(), "no_budget").when(F.col("suspended"), "suspended").when(F.col("created"), "created").otherwise("existing")
    return rows.withColumn("outcome", outcome).drop("suspended", "created", "_sw_open")


#: Events that are folded to one map at once, and the most events of an item that is folded as a whole.
BLOCK, FEW = 4096, 500_000


def _next(acc: Column, e: Column) -> Column:
    """One transition; an event that does not fit the state changes nothing but the count of ignored ones."""
    state, event = acc["state"], e["event"]
    end = F.when(event == "finish", "done").when(event == "fail", "failed").when(event == "cancel", "canceled")
    to = (
        F.when((event == "submit") & state.isNull(), "pending")
        .when((event == "admit") & (state == "pending"), "admitted")
        .when((event == "run") & (state == "admitted"), "running")
        .when(event.isin("release", "requeue") & (state == "admitted"), "pending")
        .when(end.isNotNull() & state.isNotNull() & ~state.isin(model.TERMINAL), end)
    )
    moved = to.isNotNull()
    admits, ends = moved & to.isin("admitted", "pending"), moved & to.isin(model.TERMINAL)
    keep = lambda name, when, new: F.when(when, new).otherwise(acc[name]).alias(name)
    return F.struct(
        keep("state", moved, to), (acc["attempts"] + F.when(to == "admitted", 1).otherwise(0)).alias("attempts"),
        keep("sets_admitted", admits, F.lit(True)), keep("admitted_at", admits, F.when(to == "admitted", e["ts"])),
        keep("sets_finished", ends, F.lit(True)), keep("finished_at", ends, e["ts"]), (acc["ignored"] + F.when(moved, 0).otherwise(1)).alias("ignored"),
    )


def _then(acc: Column, later: Column) -> Column:
    """Of an entry of one map and the map after it, the entry of both; where that map has no entry for the state, the entry as it is."""
    m = F.get(later, F.coalesce(F.array_position(F.array(*map(F.lit, model.STATES)), acc["state"]), F.lit(0)).cast("int"))
    return F.struct(
        m["state"].alias("state"), (acc["attempts"] + m["attempts"]).alias("attempts"),
        (acc["sets_admitted"] | m["sets_admitted"]).alias("sets_admitted"), F.when(m["sets_admitted"], m["admitted_at"]).otherwise(acc["admitted_at"]).alias("admitted_at"),
        (acc["sets_finished"] | m["sets_finished"]).alias("sets_finished"), F.when(m["sets_finished"], m["finished_at"]).otherwise(acc["finished_at"]).alias("finished_at"),
        (acc["ignored"] + m["ignored"]).alias("ignored"),
    )


def fold(events: DataFrame, block: int = BLOCK, few: int = FEW) -> DataFrame:
    """(work_id, tenant_id, state, attempts, admitted_at, finished_at, ignored) from (seq, work_id, tenant_id, event, ts).

    Events are maps of the states to states, and maps compose: a stretch of an item's events is one map of seven entries,
    whatever its length, each with its attempts, times and ignored events. Items with over ``few`` events are cut into ranges
    of ``seq`` that any tasks may take; blocks of a range become maps, the maps of a range one map, those of an item its
    state. All other items need the one entry that they begin with, and are folded where their events meet. Events of equal
    ``seq`` are taken by name, then time.
    """
    keys = ["work_id", "tenant_id"]
    events = events.select(F.struct(*keys).alias("_sw_key"), "seq", "event", "ts")
    ts = events.schema["ts"].dataType.simpleString()
    identity = lambda state: F.struct(
        F.lit(state).cast("string").alias("state"), F.lit(0).alias("attempts"), F.lit(False).alias("sets_admitted"), F.lit(None).cast(ts).alias("admitted_at"),
        F.lit(False).alias("sets_finished"), F.lit(None).cast(ts).alias("finished_at"), F.lit(0).cast("long").alias("ignored"),
    )
    # A row for ``few`` events at most.
    long = events.groupBy("_sw_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > few).select(F.col("_sw_key").alias("_sw_long"))
    is_long = F.col("_sw_key") == F.col("_sw_long")
    history = F.collect_list(F.struct("seq", "event", "ts"))
    short = events.join(F.broadcast(long), is_long, "left_anti").groupBy("_sw_key").agg(F.sort_array(history).alias("h"))
    # From every entry that is asked for; one expression serves both ways.
    stepped = F.aggregate("h", F.col("from"), lambda accs, e: F.transform(accs, lambda a: _next(a, e))).alias("m")
    none = identity(None)
    short = short.select("_sw_key.*", "h", F.array(none).alias("from")).select(*keys, stepped)
    rows = events.join(F.broadcast(long), is_long).select("_sw_key.*", "seq", "event", "ts")
    rows = scan.placed(rows, keys, "seq", scan.key_ranges(rows, keys, "seq", min(few, scan.ROWS)))
    place = F.row_number().over(Window.partitionBy(*keys, scan.PART).orderBy("seq", "event", "ts"))
    rows = rows.withColumn("block", F.floor((place - 1) / block))
    blocks = rows.groupBy(*keys, scan.PART, "block").agg(F.sort_array(history).alias("h"))
    every = F.array(none, *map(identity, model.STATES))
    maps = blocks.withColumn("from", every).select(*keys, scan.PART, "block", stepped)
    composed = F.aggregate(F.slice("l", 2, F.size("l")), F.get("l", F.lit(0))["m"], lambda accs, later: F.transform(accs, lambda a: _then(a, later["m"]))).alias("m")
    for level in ("block", scan.PART):
        whole = [*keys, scan.PART] if level == "block" else keys
        listed = maps.groupBy(*whole).agg(F.array_sort(F.collect_list(F.struct(level, "m"))).alias("l"))
        maps = listed.select(*whole, composed)
    return short.unionByName(maps).select(*keys, F.get("m", F.lit(0)).alias("s")).select(*keys, "s.state", "s.attempts", "s.admitted_at", "s.finished_at", "s.ignored")


def billed(costs: DataFrame, events: DataFrame) -> DataFrame:
    """Costs that arrived with the first terminal event of their item; later reports of an ended item count nothing."""
    ends = events.where(F.col("event").isin("finish", "fail", "cancel")).groupBy("work_id").agg(F.min("seq").alias("end_seq"))
    return costs.join(ends, (costs["work_id"] == ends["work_id"]) & (costs["seq"] <= ends["end_seq"])).drop(ends["work_id"])
