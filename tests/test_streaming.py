from __future__ import annotations

from pyspark.sql import functions as F

from sluicework.operators import events
from sluicework.plans import tick
from sluicework.sources import projections as p
from sluicework.sources.storage import cut
from sluicework.streaming.state import Admission, fold_stream, lane_counts


def drained(writer, tmp_path, name):
    q = writer.option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None


def test_streamed_fold_equals_batch(spark, sf_dir, tmp_path):
    rows = p.work_events(spark, sf_dir).where("work_id < '3'")
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    drained(fold_stream(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("append").parquet(str(tmp_path / "out"))), tmp_path, "fold")
    got = {r.work_id: (r.state, r.attempts, r.ignored) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.work_id: (r.state, r.attempts, r.ignored) for r in events.fold(rows).collect()}
    assert got == want and len(got) > 100


def test_admission_stream_and_windows(spark, sf_dir, tmp_path):
    rows = p.work(spark, sf_dir).where("state = 'pending'").limit(200)
    rows.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    writer = Admission(p.budgets(spark, sf_dir), lambda n: p.as_of(), tick.Config(total_slots=20), cut)
    drained(writer.start(stream), tmp_path, "admit")
    assert writer.work.where(F.col("state") == "running").count() == 20 and writer.work.count() == 200
    drained(lane_counts(stream, "365 days").writeStream.outputMode("complete").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(tmp_path / "lanes"))), tmp_path, "lanes")
    assert spark.read.parquet(str(tmp_path / "lanes")).agg(F.sum("submitted")).first()[0] == 200


def test_admission_goes_on_after_a_restart(spark, sf_dir, tmp_path):
    rows = p.work(spark, sf_dir).where("state = 'pending'").limit(120).repartition(3).cache()
    budgets, config = p.budgets(spark, sf_dir), tick.Config(total_slots=15, rate_window="1 DAY")
    parts = [rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) == i) for i in range(3)]
    at = lambda n: p.as_of() + F.make_interval(days=F.lit(2 * n))
    unbroken = Admission(budgets, at, config, cut)
    for i, part in enumerate(parts):
        unbroken.batch(part, i)
    path = f"file://{tmp_path}/state"
    for i, part in enumerate(parts):
        broken = Admission(budgets, at, config, cut, path)  # a new process each time
        assert broken.done == i - 1
        if i == 1:  # cut off in the middle of a batch: a version without its mark
            part.write.parquet(f"{path}/{1:010d}/work")
        broken.batch(part, i)
        broken.batch(part, i)
    got, want = (sorted((r.id, r.state, r.attempts) for r in x.work.collect()) for x in (broken, unbroken))
    assert got == want and len(got) == 120 and sum(s == "running" for _, s, _ in got) >= 15
    credits = [sorted((r.lane, r.tenant_id, round(r.credit, 9)) for r in x.credits.collect()) for x in (broken, unbroken)]
    assert credits[0] == credits[1]
    assert not (tmp_path / f"state/{0:010d}").exists() and (tmp_path / f"state/{1:010d}").exists()
