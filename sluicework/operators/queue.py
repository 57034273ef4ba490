"""The work queue: listings, fleet state, lane and tenant shares, claims and repairs.

Every operator takes DataFrames and parameters and returns a DataFrame; the present moment is a parameter.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sluicework import model


def work_list(work: DataFrame, tenant: str | None = None, state: str | None = None, limit: int = 100) -> DataFrame:
    """Newest first, ties by id; the limit is held to 1..1000. An unknown state is an error."""
    if state is not None and state not in model.STATES:
        raise ValueError(f"unknown state: {state}")
    if tenant is not None:
        work = work.where(F.col("tenant_id") == tenant)
    if state is not None:
        work = work.where(F.col("state") == state)
    return work.orderBy(F.desc("created_at"), "id").limit(min(max(limit, 1), 1000))


def work_by_id(work: DataFrame, work_id: str) -> DataFrame:
    return work.where(F.col("id") == work_id)


def budget(budgets: DataFrame, tenant: str) -> DataFrame:
    """The tenant's budget row; without one the query fails."""
    found = budgets.where(F.col("tenant_id") == tenant)
    if found.isEmpty():
        raise LookupError(f"no budget for tenant {tenant}")
    return found


def decoded(work: DataFrame) -> DataFrame:
    """Rows whose words are all known; any other row is an error that names it."""
    state, lane = (model.checked(F.col(c), v, f"{c} of work") for c, v in (("state", model.STATES), ("lane", model.LANES)))
    return work.withColumns({"state": state, "lane": lane})


def _holds_slot() -> Column:
    return F.col("state").isin(model.HOLDS_SLOT)


def fleet_state(work: DataFrame) -> DataFrame:
    """(lane, running, pending) of the known lanes that have either."""
    live = work.where(F.col("state").isin("pending", *model.HOLDS_SLOT) & F.col("lane").isin(model.LANES))
    return live.groupBy("lane").agg(F.count_if(_holds_slot()).alias("running"), F.count_if(F.col("state") == "pending").alias("pending"))


def lane_stats(work: DataFrame) -> DataFrame:
    live = work.where(F.col("state").isin("pending", *model.HOLDS_SLOT) & F.col("lane").isin(model.LANES))
    return live.groupBy("lane").agg(
        F.count_if(F.col("state") == "pending").alias("waiting"), F.count_if(_holds_slot()).alias("running"), F.min(F.when(F.col("state") == "pending", F.col("created_at"))).alias("oldest")
    )


def all_lanes(df: DataFrame) -> DataFrame:
    """The three lanes with their order, as rows made beside ``df``'s session."""
    return df.sparkSession.createDataFrame(list(enumerate(model.LANES)), "lane_rank int, lane string")


def capacity_report(work: DataFrame, as_of: Column, total_slots: int) -> DataFrame:
    """A line for each lane, also an idle one, with the fleet's use beside it."""
    stats = all_lanes(work).join(lane_stats(work), "lane", "left")
    running = F.coalesce("running", F.lit(0))
    busy = F.sum(running).over(Window.partitionBy())
    wait = F.timestamp_diff("SECOND", F.col("oldest"), as_of)
    return stats.select(
        "lane", "lane_rank", F.coalesce("waiting", F.lit(0)).alias("waiting"), F.coalesce(wait, F.lit(0)).alias("oldest_wait_seconds"), running.alias("running"), busy.alias("fleet_running"),
        F.when(F.lit(total_slots) == 0, 0.0).otherwise(busy / F.lit(float(max(total_slots, 1)))).alias("utilization"),
    )


def lane_grants(fleet: DataFrame, total_slots: int) -> DataFrame:
    """(lane, grant): free slots in lane order, less what the lanes below are guaranteed and have not yet.

    The shares are single-precision numbers, widened before they are multiplied."""
    running = [F.coalesce(F.sum(F.when(F.col("lane") == lane, F.col("running"))), F.lit(0)).alias(f"r{i}") for i, lane in enumerate(model.LANES)]
    pending = [F.coalesce(F.sum(F.when(F.col("lane") == lane, F.col("pending"))), F.lit(0)).alias(f"p{i}") for i, lane in enumerate(model.LANES)]
    row = fleet.agg(*running, *pending)
    free = F.greatest(F.lit(0), F.lit(total_slots) - F.col("r0") - F.col("r1") - F.col("r2"))
    owed = [F.least(F.greatest(F.lit(0), F.floor(F.lit(total_slots) * F.lit(s).cast("float").cast("double")) - F.col(f"r{i}")), F.col(f"p{i}")) for i, s in enumerate(model.LANE_SHARES)]
    grants = []
    for i in range(len(model.LANES)):
        below = sum(owed[i + 1 :], F.lit(0))
        grant = F.least(F.col(f"p{i}"), F.greatest(F.lit(0), free - below))
        grants.append(grant)
        free = free - grant
    pairs = F.array(*[F.struct(F.lit(lane).alias("lane"), g.cast("long").alias("grant")) for lane, g in zip(model.LANES, grants, strict=True)])
    return row.select(F.explode(pairs).alias("x")).select("x.lane", "x.grant")


def recent_admissions(work: DataFrame, as_of: Column, window: str) -> DataFrame:
    return work.where(F.col("admitted_at") > as_of - F.expr(f"INTERVAL {window}")).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("recent"))


def in_flight(work: DataFrame) -> DataFrame:
    return work.where(_holds_slot()).groupBy("tenant_id").agg(F.count(F.lit(1)).alias("in_flight"))


def candidates(work: DataFrame, budgets: DataFrame, as_of: Column, window: str = "1 MINUTE") -> DataFrame:
    """(lane, tenant_id, weight, headroom, pending) of tenants below every limit. ``in_flight`` is always counted."""
    pending = work.where(F.col("state") == "pending").groupBy("lane", "tenant_id").agg(F.count(F.lit(1)).alias("pending"), F.max("fairness_weight").alias("weight"))
    limits = budgets.where(~F.col("suspended")).select("tenant_id", "max_concurrent_tasks", "rate_limit_per_min")
    limits = limits.join(in_flight(work), "tenant_id", "left").join(recent_admissions(work, as_of, window), "tenant_id", "left")
    slots = F.greatest(F.col("max_concurrent_tasks") - F.coalesce("in_flight", F.lit(0)), F.lit(0))
    rate = F.greatest(F.col("rate_limit_per_min") - F.coalesce("recent", F.lit(0)), F.lit(0))
    rows = pending.join(limits.select("tenant_id", F.least(slots, rate).alias("headroom")), "tenant_id")
    return rows.where(F.col("headroom") > 0).select("lane", "tenant_id", "weight", "headroom", "pending")


def leading(rows: DataFrame, keys: list[str], order: list, most: str, spread: str, into: str, parts: int | None = None) -> DataFrame:
    """The first ``most`` (a column) rows of each key in ``order``, with their place in ``into``.

    Rows are first ranked in parts by the hash of ``spread``, as many as a shuffle has partitions unless given, so a key with
    any share of the rows is spread like any other table and leaves ``most`` rows a part at most.
    """
    parts = parts or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_sw_part", F.pmod(F.xxhash64(spread), F.lit(parts)))
    for by in ([*keys, "_sw_part"], keys):
        rows = rows.withColumn(into, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(into) <= F.col(most))
    return rows.drop("_sw_part")


def fair_share(candidates: DataFrame, grants: DataFrame, credits: DataFrame, cut: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(lane, tenant_id, take, credit) after one tick, from candidates, (lane, grant) and carried (lane, tenant_id, credit).

    The floor phase is a clamped running sum in the order of tenants. Who takes part in it takes a slot at least, so it is over
    after as many tenants as the lane has slots, and no more are sorted. The phase that gives single slots to the tenant that
    is owed most merges decreasing sequences credit - 0, credit - 1, ..., so the first ``remaining`` of all of them, ranked,
    are the slots given. Who still has room is owed less than one slot and lacks less than one, so these sequences run level:
    all but the last rounds are given by the level up to which the rooms fill, which the number of tenants for each room
    tells, and only about three units a tenant are ranked. What a lane sums up is made in parts and sent back as one row a
    lane; no window holds more rows than the lane has slots, times the parts of a ranking. Tenants without a turn keep their
    credit unless more credits than eligible tenants are held. ``cut`` ends the lineage of the tenants' rows, which are read
    several times.
    """
    # One row for each lane.
    beside = lambda df, lanes, how="inner": df.join(F.broadcast(lanes), "lane", how)
    ceiling = F.least("headroom", "pending")
    eligible = candidates.where((ceiling > 0) & (F.col("weight") > 0)).select("lane", "tenant_id", "weight", ceiling.alias("ceiling"), F.lit(True).alias("eligible"))
    rows = eligible.join(credits.withColumnRenamed("credit", "had"), ["lane", "tenant_id"], "full").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    lanes = rows.groupBy("lane").agg(F.sum(F.when(F.col("eligible"), F.col("weight"))).alias("total"), (F.count("had") > F.count_if("eligible")).alias("crowded"))
    lanes = lanes.join(F.broadcast(grants), "lane", "left").select("lane", "total", "crowded", F.coalesce("grant", F.lit(0)).alias("slots"))
    rows = beside(rows, lanes).where(F.col("eligible") | ~F.col("crowded"))
    turn = F.col("eligible") & (F.col("slots") > 0)
    credit = F.coalesce("had", F.lit(0.0)) + F.when(turn, F.col("slots") * F.col("weight") / F.col("total")).otherwise(0.0)
    rows = cut(rows.withColumn("turn", turn).withColumn("credit", credit).select("lane", "tenant_id", "ceiling", "had", "slots", "turn", "credit"))
    whole = F.when(F.col("turn"), F.least(F.greatest(F.floor("credit"), F.lit(0)), F.col("ceiling"))).otherwise(F.lit(0)).cast("long")

    early = leading(rows.select("lane", "tenant_id", "slots", whole.alias("whole")).where(F.col("whole") > 0), ["lane"], ["tenant_id"], "slots", "tenant_id", "place")
    up_to = F.sum("whole").over(Window.partitionBy("lane").orderBy("tenant_id").rowsBetween(Window.unboundedPreceding, 0))
    first = F.least("up_to", "slots") - F.least(F.col("up_to") - F.col("whole"), F.col("slots"))
    early = early.withColumn("up_to", up_to).select("lane", "tenant_id", first.alias("first")).where(F.col("first") > 0)
    rows = rows.join(early, ["lane", "tenant_id"], "left").withColumn("first", F.coalesce("first", F.lit(0)))
    rows = rows.withColumn("owed", F.col("credit") - F.col("first"))
    rows = rows.withColumn("gap", F.when(F.col("turn"), F.least(F.col("ceiling") - F.col("first"), F.col("slots"))).otherwise(F.lit(0)).cast("int"))

    # Gaps are at most the lane's slots, so there are no more of them than that.
    rooms = rows.groupBy("lane", "slots", "gap").agg(F.count(F.lit(1)).alias("n"), F.sum("first").alias("first"))
    rooms = rooms.withColumn("remaining", F.col("slots") - F.sum("first").over(Window.partitionBy("lane")))
    room = F.least("gap", "remaining").cast("int")
    rooms = rooms.withColumn("room", room).where(F.col("room") > 0)
    lane = Window.partitionBy("lane")
    before = lane.orderBy("room", "gap").rowsBetween(Window.unboundedPreceding, -1)
    filled, passed = (F.coalesce(F.sum(x).over(before), F.lit(0)) for x in (F.col("n") * F.col("room"), F.col("n")))
    rooms = rooms.withColumns({"left": F.col("remaining") - filled, "others": F.sum("n").over(lane) - passed})
    # Among tenants of equal room the level runs one way, so it is highest at the first or the last.
    level = F.greatest(F.col("left") / F.col("others"), (F.col("left") - (F.col("n") - 1) * F.col("room")) / (F.col("others") - F.col("n") + 1))
    sure = F.least(F.col("room"), F.greatest(F.floor("level") - 1, F.lit(0))).cast("int")
    rooms = rooms.withColumn("level", level).withColumn("level", F.max("level").over(lane))
    levels = rooms.groupBy("lane").agg(F.max("level").alias("level"), F.max("remaining").alias("remaining"), (F.max("remaining") - F.sum(F.col("n") * sure)).alias("after"))
    rows = beside(rows, levels, "left").withColumn("room", F.coalesce(room, F.lit(0)))
    rows = rows.withColumn("sure", F.when((F.col("room") > 0) & F.col("level").isNotNull(), sure).otherwise(F.lit(0)))

    last = F.least(F.col("room"), F.col("sure") + 3)
    units = rows.where(F.col("room") > F.col("sure")).select("lane", "tenant_id", "after", "owed", F.explode(F.sequence(F.col("sure"), last - 1)).alias("j"))
    units = units.where(F.col("after") > 0).withColumn("key", F.col("owed") - F.col("j"))
    ranked = leading(units, ["lane"], [F.desc("key"), "tenant_id", "j"], "after", "tenant_id", "place").groupBy("lane", "tenant_id").agg(F.count(F.lit(1)).alias("more"))
    out = rows.join(ranked, ["lane", "tenant_id"], "left").withColumn("extra", F.col("sure") + F.coalesce("more", F.lit(0)))
    left = F.col("owed") - F.col("extra")
    band = F.greatest(F.least(left, F.lit(model.CREDIT_BAND)), F.lit(-model.CREDIT_BAND))
    # Who has neither had a turn nor a credit is not remembered.
    out = out.where(F.col("turn") | F.col("had").isNotNull())
    return out.select("lane", "tenant_id", (F.col("first") + F.col("extra")).alias("take"), F.when(F.col("turn"), band).otherwise(left).alias("credit"))


def no_credits(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([], "lane string, tenant_id string, credit double")


def claim(work: DataFrame, takes: DataFrame, parts: int | None = None) -> DataFrame:
    """The pending rows that (lane, tenant_id, take) gives a slot to, most urgent and then oldest first.

    A tenant's rows are ranked in ``parts`` first, so a tenant with a third of all rows is spread like any other table.
    """
    order = ["priority_key", "created_at", "id"]
    rows = work.where(F.col("state") == "pending").join(takes.where(F.col("take") > 0).select("lane", "tenant_id", "take"), ["lane", "tenant_id"])
    # Slots bound these rows, so their order costs little.
    return leading(rows, ["lane", "tenant_id"], order, "take", "id", "claim_rank", parts).drop("take").orderBy(*order)


def stalled(work: DataFrame, as_of: Column, older_than_seconds: float) -> DataFrame:
    """Admitted rows whose start never landed."""
    limit = as_of - F.make_interval(secs=F.lit(max(older_than_seconds, 0)))
    return work.where((F.col("state") == "admitted") & F.col("workflow_id").isNull() & (F.col("admitted_at") < limit))


def overdue(work: DataFrame, as_of: Column, older_than_seconds: float) -> DataFrame:
    """Running rows that nothing has ended for too long."""
    limit = as_of - F.make_interval(secs=F.lit(max(older_than_seconds, 0)))
    return work.where((F.col("state") == "running") & (F.col("admitted_at") < limit))


def drift(budgets: DataFrame, work: DataFrame, counter: str = "in_flight") -> DataFrame:
    """Budgets whose stored counter differs, nulls included, from the rows that hold a slot."""
    counted = budgets.join(in_flight(work).withColumnRenamed("in_flight", "actual"), "tenant_id", "left").withColumn("actual", F.coalesce("actual", F.lit(0)))
    return counted.where(~F.col(counter).eqNullSafe(F.col("actual"))).select("tenant_id", F.col(counter).alias("stored"), "actual")


def cost_rollup(work: DataFrame, costs: DataFrame) -> DataFrame:
    """Cost of each known work item: sums, and the machine of the last report."""
    sums = costs.groupBy("work_id").agg(F.sum("cpu_seconds").alias("encode_seconds"), F.sum("bytes_written").alias("bytes_written"), F.max(F.struct("seq", "machine")).alias("last"))
    known = work.select(F.col("id").alias("work_id"), "tenant_id")
    return sums.join(known, "work_id").select("work_id", "tenant_id", "encode_seconds", "bytes_written", "last.machine")


def scoped(df: DataFrame, scope: str | None, tenant: str | None = None) -> DataFrame:
    """Rows that a scope may see: 'service' all, 'tenant' its own, anything unset none."""
    if scope == "service":
        return df
    if scope == "tenant" and tenant is not None:
        return df.where(F.col("tenant_id") == tenant)
    return df.where(F.lit(False))
