"""The queue, media and report tables as projections of the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-07-30 00:00:00"
EPOCH_MS = 1_704_067_200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_of():
    """The moment at which queries look at the queue; time is always a parameter."""
    return F.lit(AS_OF).cast("timestamp_ntz")


def work(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customer, nation = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    first, key = F.substring("o_orderpriority", 1, 1), F.col("o_orderkey")
    state = F.when(F.col("o_orderstatus") == "O", "pending").when(F.col("o_orderstatus") == "F", F.when(key % 10 == 0, "failed").otherwise("done")).otherwise(
        F.when(key % 2 == 0, "running").otherwise("admitted")
    )
    return rows.select(
        key.cast("string").alias("id"), F.col("c_nationkey").cast("string").alias("tenant_id"), F.lit("fake").alias("kind"),
        F.when(first == "1", "realtime").when(first.isin("2", "3"), "standard").otherwise("bulk").alias("lane"), first.cast("int").alias("priority_key"),
        (F.col("n_regionkey") + 1).cast("double").alias("fairness_weight"), state.alias("state"),
        F.when((state == "running") | ((state == "admitted") & (key % 3 == 0)), F.concat(F.lit("wf-fake-"), key.cast("string"))).alias("workflow_id"),
        F.concat_ws("/", F.col("c_nationkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")).alias("dedupe_key"),
        F.when(state == "pending", 0).otherwise(1).alias("attempts"), F.col("o_orderdate").alias("created_at"),
        F.when(state != "pending", F.col("o_orderdate") + F.expr("INTERVAL 1 HOUR")).alias("admitted_at"), key.alias("seq"),
    )


def budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, region = F.col("n_nationkey"), F.col("n_regionkey")
    return table(spark, sf_dir, "nation").select(
        key.cast("string").alias("tenant_id"), (200 + 10 * region).alias("max_concurrent_tasks"), (5 + region).alias("rate_limit_per_min"),
        (1 + region).cast("double").alias("fairness_weight"), (key % 7 == 0).alias("suspended"),
    )


def cost_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.struct("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("work_id"), F.col("l_quantity").alias("cpu_seconds"), F.floor("l_extendedprice").cast("long").alias("bytes_written"),
        F.col("l_suppkey").cast("string").alias("machine"), order.alias("seq"),
    )


def work_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, work_id, tenant_id, event, ts): a submission and its transitions, some repeated and some invalid."""
    rows = work(spark, sf_dir)
    hour = lambda n: F.col("created_at") + F.expr(f"INTERVAL {n} HOUR")
    key = F.col("seq")
    final = F.when(key % 10 == 0, "fail").when(key % 17 == 0, "cancel").otherwise("finish")
    events = F.array(
        F.struct(F.lit("submit").alias("event"), F.col("created_at").alias("ts"), F.lit(0).alias("n")),
        F.struct(F.when(F.col("state") != "pending", "admit").alias("event"), hour(1).alias("ts"), F.lit(1).alias("n")),
        F.struct(F.when((F.col("state") != "pending") & (key % 4 == 1), "release").alias("event"), hour(2).alias("ts"), F.lit(2).alias("n")),
        F.struct(F.when(F.col("state").isin("running", "done", "failed") | (key % 11 == 0), "run").alias("event"), hour(3).alias("ts"), F.lit(3).alias("n")),
        F.struct(F.when(F.col("state").isin("done", "failed"), final).alias("event"), hour(4).alias("ts"), F.lit(4).alias("n")),
        F.struct(F.when(F.col("state").isin("done", "failed") & (key % 3 == 0), "fail").alias("event"), hour(5).alias("ts"), F.lit(5).alias("n")),
        F.struct(F.when(key % 13 == 0, "submit").alias("event"), hour(6).alias("ts"), F.lit(6).alias("n")),
    )
    exploded = rows.select("id", "tenant_id", "seq", F.explode(events).alias("x")).where(F.col("x.event").isNotNull())
    return exploded.select((F.col("seq") * 10 + F.col("x.n")).alias("seq"), F.col("id").alias("work_id"), "tenant_id", "x.event", "x.ts")


def keyframes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(source, ms): one row a keyframe."""
    ms = F.unix_millis(F.col("ts").cast("timestamp")) - EPOCH_MS
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), ms.alias("ms"), "event_id")


def ladder_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    height = F.col("p_size") * 48
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("source"), F.floor(height * 16 / 9).cast("long").alias("width"), height.cast("long").alias("height"),
        F.when(F.col("p_partkey") % 5 != 0, F.floor(F.col("p_retailprice") * 4000).cast("long")).alias("bit_rate"),
        F.when(F.col("p_partkey") % 4 == 0, 90).otherwise(0).alias("rotation"),
        F.when(F.col("p_partkey") % 6 == 0, 4).otherwise(1).alias("sar_num"), F.when(F.col("p_partkey") % 6 == 0, 3).otherwise(1).alias("sar_den"),
    )


def renditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(asset, pos, name, frame_count, duration_ms, keyframes, warnings, fps)."""
    order = [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")]
    from pyspark.sql import Window

    pos = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
    n = F.col("l_quantity").cast("int")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("asset"), pos.alias("pos"), F.concat(F.lit("r"), pos.cast("string")).alias("name"),
        F.when(F.col("l_partkey") % 9 != 0, n.cast("long")).alias("frame_count"), (F.floor("l_extendedprice") % 100).cast("long").alias("duration_ms"),
        F.transform(F.sequence(F.lit(0), (n % 4).cast("int")), lambda i: (i * 2000).cast("long")).alias("keyframes"),
        F.when(F.col("l_partkey") % 50 == 0, F.array(F.lit("rotation_metadata"))).when(F.col("l_partkey") % 50 == 1, F.array(F.lit("no_audio"), F.lit("variable_frame_rate")))
        .otherwise(F.array().cast("array<string>")).alias("warnings"), F.when(F.col("l_linenumber") < 6, 30.0).otherwise(25.0).alias("fps"),
    )


def frame_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, file, brand, rung, metric, value): per-frame scores of the runs A, R and N, each compared with the one before it."""
    from sluicework.functions.tables import METRICS

    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    metric = F.element_at(F.array(*[F.lit(m) for m in METRICS]), (F.col("l_linenumber") % len(METRICS) + 1).cast("int"))
    return rows.select(
        F.col("l_returnflag").alias("run"), F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_brand").alias("brand"),
        F.concat(F.col("p_type"), F.lit("-"), (F.col("l_suppkey") % 3).cast("string")).alias("rung"), metric.alias("metric"), F.round(F.col("l_extendedprice"), 0).alias("value"),
    )
