"""Streams whose state is in their checkpoint, stopped and started again between batches."""

from __future__ import annotations

import random
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sluicework.operators import queue
from sluicework.sources import projections as p
from sluicework.streaming import stateful

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module", autouse=True)
def store(spark):
    before = spark.conf.get(stateful.STATE_STORE[0])
    stateful.use_state_store(spark)
    yield
    spark.conf.set(stateful.STATE_STORE[0], before)


class Feed:
    """Batches of rows for a stream: each ``run`` starts the query anew from its checkpoint and works off what is new."""

    def __init__(self, spark, path, schema, operator):
        self.spark, self.path, self.schema, self.operator, self.n = spark, path, schema, operator, 0
        (path / "in").mkdir()

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(str(self.path / f"w{self.n}"))
        for f in (self.path / f"w{self.n}").glob("*.parquet"):
            f.rename(self.path / "in" / f"b{self.n:04d}.parquet")
        self.n += 1

    def run(self):
        stream = self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in"))
        writer = self.operator(stream).writeStream.outputMode("update").option("checkpointLocation", str(self.path / "checkpoint")).trigger(availableNow=True)
        q = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(self.path / "out" / f"n={n}"))).start()
        q.awaitTermination(300)
        assert q.exception() is None
        return self

    def rows(self):
        return self.spark.read.parquet(str(self.path / "out"))


CANDIDATES = "lane string, tick long, slots long, tenant_id string, weight double, headroom long, pending long"


def ticks(rng, n):
    tenants = {f"t{k}": rng.choice([1.0, 2.0, 5.0]) for k in range(6)}
    for tick in range(n):
        for lane in ("realtime", "bulk"):
            for t, w in tenants.items():
                if rng.random() < 0.8:
                    yield lane, tick, (tick * 7 + len(lane)) % 9, t, w, rng.choice([0, 1, 5]), rng.choice([1, 3, 50])


def test_credits_survive_a_restart(spark, tmp_path):
    rows = list(ticks(random.Random(2), 8))
    (tmp_path / "whole").mkdir(), (tmp_path / "broken").mkdir()
    whole = Feed(spark, tmp_path / "whole", CANDIDATES, stateful.fair_shares)
    whole.add(rows)
    whole.run()
    broken = Feed(spark, tmp_path / "broken", CANDIDATES, stateful.fair_shares)
    for cut in ((0, 5), (3, 6), (6, 8)):  # ticks 3 and 4 are delivered twice
        broken.add([r for r in rows if cut[0] <= r[1] < cut[1]])
        broken.run()
    got = sorted(tuple(r)[:5] for r in broken.rows().select("lane", "tick", "tenant_id", "take", "credit").collect())
    assert got == sorted(tuple(r)[:5] for r in whole.rows().select("lane", "tick", "tenant_id", "take", "credit").collect())
    # And both equal the batch operator with its credits handed on.
    credits = queue.no_credits(spark.createDataFrame(rows, CANDIDATES))
    held = []
    for tick in range(8):
        mine = spark.createDataFrame([r for r in rows if r[1] == tick], CANDIDATES)
        shared = queue.fair_share(mine.drop("tick", "slots"), mine.select("lane", F.col("slots").alias("grant")).distinct(), spark.createDataFrame(held, credits.schema))
        held = [(r.lane, r.tenant_id, r.credit) for r in shared.collect()]
        after = {(lane, t): c for lane, n, t, _, c in got if n == tick}
        assert {k for k in after} == {(lane, t) for lane, t, _ in held} and all(abs(after[lane, t] - c) < 1e-9 for lane, t, c in held)


def test_the_small_share_is_that_of_the_rule():
    credits = {}
    assert stateful.share(60, [("a", 5.0, 1000), ("b", 1.0, 1000)], credits) == {"a": 50, "b": 10}
    assert stateful.share(10, [("a", 1.0, 10_000), ("b", 1.0, 1)], {}) == {"a": 9, "b": 1}
    assert stateful.share(0, [("a", 1.0, 5)], credits) == {} and stateful.share(5, [("a", 0.0, 5), ("b", 1.0, 0)], credits) == {} and credits == {}
    served, credits = {"a": 0, "b": 0}, {}
    for _ in range(400):
        for t, n in stateful.share(3, [("a", 4.0, 10_000), ("b", 1.0, 10_000)], credits).items():
            served[t] += n
    assert sum(served.values()) == 1200 and 3.8 <= served["a"] / served["b"] <= 4.2


def at(seconds):
    return START + timedelta(seconds=seconds)


def test_stalled_items_are_requeued_by_the_clock(spark, tmp_path):
    feed = Feed(spark, tmp_path, "seq long, work_id string, tenant_id string, event string, ts timestamp", lambda s: stateful.requeue_stalled(s, "0 seconds"))
    feed.add([(1, "a", "t", "submit", at(0)), (2, "a", "t", "admit", at(1)), (1, "b", "t", "admit", at(2)), (1, "c", "u", "admit", at(3)), (2, "c", "u", "release", at(4)), (3, "c", "u", "admit", at(200))])
    feed.run()
    feed.add([(2, "b", "t", "run", at(250)), (1, "z", "t", "submit", at(299))])
    feed.run()
    assert feed.rows().count() == 0
    feed.add([(1, "y", "t", "submit", at(302))])
    feed.run()
    feed.add([(2, "y", "t", "submit", at(303))])
    feed.run()
    assert [(r.work_id, r.tenant_id, r.after_seq, r.event, r.ts) for r in feed.rows().collect()] == [("a", "t", 2, "requeue", at(301))]
    feed.add([(3, "a", "t", "requeue", at(304)), (4, "a", "t", "admit", at(305)), (9, "y", "t", "submit", at(501))])
    feed.run()
    feed.add([(10, "y", "t", "submit", at(700))])
    feed.run()
    feed.add([(11, "y", "t", "submit", at(701))])
    feed.run()
    assert sorted((r.work_id, r.after_seq, r.ts) for r in feed.rows().collect()) == [("a", 2, at(301)), ("a", 4, at(605)), ("c", 3, at(500))]


def test_stragglers_are_issued_again_and_given_up(spark, tmp_path):
    feed = Feed(spark, tmp_path, "source long, chunk_index int, event string, budget_ms long, ts timestamp", lambda s: stateful.reissue_stragglers(s, "0 seconds"))
    feed.add([(1, 0, "issue", 60_000, at(0)), (1, 1, "issue", 120_000, at(0)), (1, 2, "issue", 60_000, at(0)), (1, 2, "done", None, at(30)), (1, 0, "issue", 60_000, at(31))])
    for t in (59, 61, 121, 130):
        feed.add([(9, 9, "done", None, at(t))] + ([(1, 1, "done", None, at(125))] if t == 130 else []))
        feed.run()
    for t in (181, 300, 600, 601):
        feed.add([(9, 9, "done", None, at(t))])
    feed.run()
    got = sorted((r.source, r.chunk_index, r.attempt, r.event, r.ts) for r in feed.rows().collect())
    assert got == [(1, 0, 2, "reissue", at(60)), (1, 0, 3, "reissue", at(120)), (1, 0, 4, "gave_up", at(240)), (1, 0, 4, "reissue", at(180)), (1, 1, 2, "reissue", at(120))]


def test_machine_clock(spark, tmp_path):
    """Timers go off without new rows; the query is stopped once they have."""
    schema = "seq long, work_id string, tenant_id string, event string, ts timestamp"
    feed = Feed(spark, tmp_path, schema, None)
    feed.add([(1, "a", "t", "admit", at(0)), (1, "b", "t", "submit", at(0))])
    stream = stateful.requeue_stalled(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), after_ms=1)
    q = stream.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(processingTime="200 milliseconds").format("memory").queryName("machine_clock").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            if found := spark.table("machine_clock").collect():
                break
    finally:
        q.stop()
    assert [(r.work_id, r.event) for r in found] == [("a", "requeue")]


def test_rolling_limit_equals_the_table_at_every_instant(spark, sf_dir, tmp_path):
    rng = random.Random(6)
    times = sorted((at(rng.randrange(0, 600)), f"t{rng.randrange(4)}") for _ in range(400))
    feed = Feed(spark, tmp_path, "tenant_id string, admitted_at timestamp", lambda s: stateful.recent_admissions(s, 60, 5))
    # Batches meet within a second, and the last row of each comes a batch too late.
    cuts = [0, *sorted(rng.sample(range(1, 400), 5)), 400]
    parts = [times[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    for part in parts:
        feed.add([(t, ts) for ts, t in part])
    feed.run()
    got = [(r.tenant_id, r.admitted_at, r.recent) for r in feed.rows().collect()]
    assert len(got) == 400
    table = spark.createDataFrame([(t, ts) for ts, t in times], "tenant_id string, admitted_at timestamp")
    for moment in {ts for ts, _ in times[::40]}:
        then = table.where(F.col("admitted_at") <= F.lit(moment))
        want = {r.tenant_id: r.recent for r in queue.recent_admissions(then, F.lit(moment), "1 MINUTE").collect()}
        for t in {t for t, ts, _ in got if ts == moment}:
            assert max(n for x, ts, n in got if (x, ts) == (t, moment)) == want[t]
    for t, ts, n in got:
        assert n <= sum(x == t and ts - timedelta(seconds=60) < y <= ts for y, x in times)


def test_ticks_of_the_queue(spark, sf_dir, tmp_path):
    """Candidates of the work table, a tick a batch: what the stream takes is what one batch tick takes."""
    found = queue.candidates(p.work(spark, sf_dir), p.budgets(spark, sf_dir), p.as_of(), "30 DAY")
    rows = [(r.lane, 0, 40, r.tenant_id, r.weight, r.headroom, r.pending) for r in found.collect()]
    feed = Feed(spark, tmp_path, CANDIDATES, stateful.fair_shares)
    feed.add(rows)
    feed.run()
    grants = spark.createDataFrame([(lane, 40) for lane in {r[0] for r in rows}], "lane string, grant long")
    want = {(r.lane, r.tenant_id): r["take"] for r in queue.fair_share(found, grants, queue.no_credits(found)).collect()}
    assert {(r.lane, r.tenant_id): r["take"] for r in feed.rows().collect()} == want and sum(want.values()) > 0


def test_a_manifest_grows_with_each_rung(spark, sf_dir, tmp_path):
    from sluicework.operators import fanout
    from sluicework.plans.queries import QUERIES

    jobs = QUERIES["chunk_rung_jobs"](spark, sf_dir).where("source < 25")
    want = {(r.source, r.rung): r.parts for r in fanout.join_parts(jobs).collect()}
    rows = [(r.source, r.rung, r.chunk_index, r.part, len(want[r.source, r.rung]), START) for r in jobs.collect()]
    rng = random.Random(3)
    landed = [(s, rung, i, at(rng.randrange(1, 3000))) for s, rung, i, *_ in rows]
    rng.shuffle(landed)
    (tmp_path / "landed").mkdir()
    other = Feed(spark, tmp_path / "landed", "source long, rung string, chunk_index int, landed_at timestamp", None)

    def operator(stream):
        parts = spark.readStream.schema(other.schema).parquet(str(other.path / "in"))
        return stateful.publish(stream, parts, late="1 hour")

    feed = Feed(spark, tmp_path, "source long, rung string, chunk_index int, part string, chunks int, planned_at timestamp", operator)
    feed.run = lambda: _append(feed)
    feed.add(rows[: len(rows) // 2])
    for k in range(2):
        other.add(landed[k::2][: len(landed) // 3] if k == 0 else [*landed[k::2], *landed[0::2][len(landed) // 3 :], *landed[:9]])
        if k:
            feed.add(rows[len(rows) // 2 :])
        feed.run()
    got = feed.rows().collect()
    assert {(r.source, r.rung): r.parts for r in got} == want and len(got) == len(want) > 20
    for s in {r.source for r in got}:
        versions = sorted(r.version for r in got if r.source == s)
        assert versions == list(range(1, len(versions) + 1))


@pytest.mark.parametrize("seed", [1, 2])
def test_submissions_in_any_batches(spark, tmp_path, seed):
    """Rows and budget changes in any order, some twice, restarted between batches: the last answers are those of the table."""
    from sluicework.operators import events

    rng = random.Random(seed)
    schema = "kind string, id string, tenant_id string, dedupe_key string, seq long, suspended boolean"
    subs = [("s", f"i{n}", f"t{rng.randrange(4)}", rng.choice([None, "", *"abcdefgh"]), n * 10, None) for n in range(120)]
    changes = [("b", None, f"t{t}", None, seq, rng.random() < 0.4) for t in range(3) for seq in [5 if t else 333, *rng.sample(range(7, 1200, 10), 3)]]
    rows = subs + changes
    rng.shuffle(rows)

    def operator(stream):
        return stateful.submit_outcomes(stream.where("kind = 's'").select("id", "tenant_id", "dedupe_key", "seq"), stream.where("kind = 'b'").select("tenant_id", "seq", "suspended"), 3)

    feed = Feed(spark, tmp_path, schema, operator)
    for a, b in ((0, 20), (20, 90), (80, len(rows))):
        feed.add(rows[a:b])
        feed.run()
    told = events.latest_wins(feed.rows().select("id", "outcome", "version"), ["id"], "version")
    table = spark.createDataFrame(rows, schema)
    history = table.where("kind = 'b'").select("tenant_id", "seq", "suspended", F.lit(1.0).alias("fairness_weight"))
    want = events.admitted_submissions(table.where("kind = 's'").select("id", "tenant_id", "dedupe_key", "seq"), history)
    assert {r.id: r.outcome for r in told.collect()} == {r.id: r.outcome for r in want.collect()}
    assert len({r.outcome for r in want.select("outcome").collect()}) == 4


def _append(feed):
    stream = feed.spark.readStream.schema(feed.schema).parquet(str(feed.path / "in"))
    writer = feed.operator(stream).writeStream.outputMode("append").option("checkpointLocation", str(feed.path / "checkpoint")).trigger(availableNow=True)
    q = writer.foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(str(feed.path / "out" / f"n={n}"))).start()
    assert q.awaitTermination(200) and q.exception() is None
