"""Operators whose state lives in the checkpoint of a stream: carried credits, timers and rolling limits.

Each is a processor for ``transformWithStateInPandas``, so a session needs the RocksDB state store (``STATE_STORE``). What a processor
knows between batches is in its state only: a query that is stopped and started again from its checkpoint goes on as if it had
never stopped. Late and repeated rows are told by their number or time.
"""

from __future__ import annotations

import bisect
import heapq
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from sluicework import model

STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: What ends the wait of a timer on an admitted item.
SETTLES = ["run", "release", "requeue", "finish", "fail", "cancel"]


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set(*STATE_STORE)


def share(slots: int, tenants: list[tuple[str, float, int]], credits: dict[str, float]) -> dict[str, int]:
    """Who of (tenant, weight, ceiling) takes how many of the slots; ``credits`` is brought up to date.

    Every tenant takes the whole slots that it is owed, in order, and what is left goes to whoever is owed most."""
    tenants = sorted(t for t in tenants if t[2] > 0 and t[1] > 0)
    if len(credits) > len(tenants):
        for gone in set(credits) - {t for t, _, _ in tenants}:
            del credits[gone]
    if slots <= 0 or not tenants:
        return {}
    total, left, took = sum(w for _, w, _ in tenants), slots, {}
    for t, weight, ceiling in tenants:
        credit = credits.get(t, 0.0) + slots * weight / total
        took[t] = min(max(math.floor(credit), 0), ceiling, left)
        credits[t], left = credit - took[t], left - took[t]
    waiting = [(-credits[t], t, ceiling - took[t]) for t, _, ceiling in tenants if took[t] < ceiling]
    heapq.heapify(waiting)
    while left and waiting:
        owed, t, room = heapq.heappop(waiting)
        credits[t], took[t], left = credits[t] - 1, took[t] + 1, left - 1
        if room > 1:
            heapq.heappush(waiting, (owed + 1, t, room - 1))
    for t, _, _ in tenants:
        credits[t] = min(max(credits[t], -model.CREDIT_BAND), model.CREDIT_BAND)
    return took


class _FairShare(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.done = handle.getValueState("done", "tick long")
        self.credits = handle.getMapState("credits", "tenant_id string", "credit double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows)
        done = self.done.get()[0] if self.done.exists() else None
        credits = {k[0]: v[0] for k, v in self.credits.iterator()}
        before, out = dict(credits), []
        for tick, mine in frame.groupby("tick", sort=True):
            if done is not None and tick <= done:  # delivered again
                continue
            ceiling = np.minimum(mine["headroom"], mine["pending"]).astype(int)
            took = share(int(mine["slots"].iloc[0]), list(zip(mine["tenant_id"], mine["weight"], ceiling, strict=True)), credits)
            out += [(key[0], int(tick), t, took.get(t, 0), c) for t, c in sorted(credits.items())]
            done = int(tick)
        if done is not None:
            self.done.update((done,))
        for gone in set(before) - set(credits):
            self.credits.removeKey((gone,))
        for t, c in credits.items():
            if before.get(t) != c:
                self.credits.updateValue((t,), (c,))
        yield pd.DataFrame(out, columns=["lane", "tick", "tenant_id", "take", "credit"])


def fair_shares(candidates: DataFrame) -> DataFrame:
    """(lane, tick, tenant_id, take, credit) of every tick of a stream (lane, tick, slots, tenant_id, weight, headroom, pending).

    Ticks are numbered upwards, and all rows of a lane's tick come in one batch. A lane remembers the last tick that it has
    done and the credit of each of its tenants."""
    rows = candidates.select("lane", "tick", "slots", "tenant_id", "weight", "headroom", "pending")
    schema = "lane string, tick long, tenant_id string, take long, credit double"
    return rows.groupBy("lane").transformWithStateInPandas(_FairShare(), schema, "Update", "None")


class _Timed(StatefulProcessor):
    """A clock that is the machine's or that of the rows: with the rows', a timer goes off when the watermark reaches it."""

    def __init__(self, event_time: bool):
        self.event_time = event_time

    def now(self, at: pd.Timestamp, timerValues) -> int:
        return at.value // 1_000_000 if self.event_time else timerValues.getCurrentProcessingTimeInMs()

    def stop_timers(self) -> None:
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)


class _Requeue(_Timed):
    def __init__(self, event_time: bool, after_ms: int):
        super().__init__(event_time)
        self.after_ms = after_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waits = handle.getValueState("waits", "tenant_id string, seq long")
        self.last = handle.getValueState("last", "seq long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last = self.last.get()[0] if self.last.exists() else -1
        for r in pd.concat(rows).sort_values("seq").itertuples(index=False):
            if r.seq <= last:
                continue
            last = int(r.seq)
            if r.event == "admit" or r.event in SETTLES:
                self.stop_timers()
                self.waits.clear()
            if r.event == "admit":
                self.waits.update((r.tenant_id, last))
                self.handle.registerTimer(self.now(r.ts, timerValues) + self.after_ms)
        self.last.update((last,))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.waits.exists():
            tenant, seq = self.waits.get()
            self.waits.clear()
            at = pd.Timestamp(expiredTimerInfo.getExpiryTimeInMs(), unit="ms")
            yield pd.DataFrame({"work_id": [key[0]], "tenant_id": [tenant], "after_seq": [seq], "event": ["requeue"], "ts": [at]})


def _timed(events: DataFrame, late: str | None) -> DataFrame:
    events = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return events if late is None else events.withWatermark("ts", late)


def requeue_stalled(events: DataFrame, late: str | None = None, after_ms: int = model.STALL_SECONDS * 1000) -> DataFrame:
    """(work_id, tenant_id, after_seq, event, ts): a requeue for each item of a stream (seq, work_id, tenant_id, event, ts) that
    has been admitted for ``after_ms`` and neither started nor ended since; it belongs after the admission ``after_seq``.

    Time is the machine's; with ``late`` it is that of the rows, up to that watermark."""
    rows = _timed(events.select("seq", "work_id", "tenant_id", "event", "ts"), late)
    schema = "work_id string, tenant_id string, after_seq long, event string, ts timestamp"
    mode = "ProcessingTime" if late is None else "EventTime"
    return rows.groupBy("work_id").transformWithStateInPandas(_Requeue(late is not None, after_ms), schema, "Append" if late else "Update", mode)


class _Reissue(_Timed):
    def __init__(self, event_time: bool, most: int):
        super().__init__(event_time)
        self.most = most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "attempt int, budget_ms long, ended boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for r in pd.concat(rows).sort_values(["ts", "event"], ascending=[True, False]).itertuples(index=False):
            if r.event == "issue" and not self.job.exists():
                self.job.update((1, int(r.budget_ms), False))
                self.handle.registerTimer(self.now(r.ts, timerValues) + int(r.budget_ms))
            elif r.event == "done":
                self.stop_timers()
                self.job.update((self.job.get()[0] if self.job.exists() else 0, 0, True))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        attempt, budget, ended = self.job.get()
        if not ended:
            at, again = expiredTimerInfo.getExpiryTimeInMs(), attempt < self.most
            self.job.update((attempt + 1, budget, False) if again else (attempt, 0, True))
            if again:
                self.handle.registerTimer(at + budget)
            yield pd.DataFrame({"source": [key[0]], "chunk_index": [key[1]], "attempt": [attempt + again], "event": ["reissue" if again else "gave_up"], "ts": [pd.Timestamp(at, unit="ms")]})


def reissue_stragglers(events: DataFrame, late: str | None = None, most: int = model.CHUNK_ATTEMPTS) -> DataFrame:
    """(source, chunk_index, attempt, event, ts) from a stream (source, chunk_index, event, budget_ms, ts) of chunks that are
    issued and done: a chunk that is not done within its budget is issued again, each time with the same budget, and
    given up after ``most`` attempts. A chunk is issued once; what is done stays done. Time as in ``requeue_stalled``."""
    rows = _timed(events.select("source", "chunk_index", "event", "budget_ms", "ts"), late)
    kind = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = f"source {kind['source']}, chunk_index {kind['chunk_index']}, attempt int, event string, ts timestamp"
    mode = "ProcessingTime" if late is None else "EventTime"
    return rows.groupBy("source", "chunk_index").transformWithStateInPandas(_Reissue(late is not None, most), schema, "Append" if late else "Update", mode)


class _Recent(StatefulProcessor):
    def __init__(self, window_us: int, late_us: int):
        self.window, self.late = window_us, late_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.times = handle.getListState("times", "at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows)
        new = frame["at"].to_numpy(np.int64)
        times = np.sort(np.concatenate([np.array([t[0] for t in self.times.get()], np.int64), new]))
        n = np.searchsorted(times, new, "right") - np.searchsorted(times, new - self.window, "right")
        # No later row may look further back than this.
        self.times.put([(int(t),) for t in times[times > times[-1] - self.window - self.late]])
        yield pd.DataFrame({"tenant_id": key[0], "at": new, "recent": n})


def recent_admissions(admissions: DataFrame, window_seconds: float = 60, late_seconds: float = 0) -> DataFrame:
    """(tenant_id, admitted_at, recent): for each row of a stream (tenant_id, admitted_at) how many admissions its tenant has had in
    the window that ends with it, both batches before and its own counted. A tenant remembers the times of one window, and rows may come up to
    ``late_seconds`` after later ones."""
    rows = admissions.select("tenant_id", F.unix_micros(F.col("admitted_at").cast("timestamp")).alias("at"))
    processor = _Recent(round(window_seconds * 1e6), round(late_seconds * 1e6))
    counted = rows.groupBy("tenant_id").transformWithStateInPandas(processor, "tenant_id string, at long, recent long", "Update", "None")
    return counted.select("tenant_id", F.timestamp_micros("at").cast(admissions.schema["admitted_at"].dataType).alias("admitted_at"), "recent")


class _Publish(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "n long")
        self.parts = handle.getMapState("parts", "rung string, chunk_index int", "part string")
        self.landed = handle.getMapState("landed", "rung string", "n int, complete boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        version, out = (self.version.get()[0] if self.version.exists() else 0), []
        for rung, mine in pd.concat(rows).groupby("rung", sort=True):
            n, complete = self.landed.getValue((rung,)) if self.landed.containsKey((rung,)) else (0, False)
            if complete:  # parts that land again
                continue
            for r in mine.itertuples(index=False):
                place = (rung, int(r.chunk_index))
                if not self.parts.containsKey(place):
                    self.parts.updateValue(place, (r.part,))
                    n += 1
            complete = n >= int(mine["chunks"].max())
            self.landed.updateValue((rung,), (n, complete))
            if complete:
                found = sorted((k[1], v[0]) for k, v in self.parts.iterator() if k[0] == rung)
                version += 1
                out.append((key[0], version, rung, [part for _, part in found]))
                for chunk, _ in found:
                    self.parts.removeKey((rung, chunk))
        self.version.update((version,))
        yield pd.DataFrame(out, columns=["source", "version", "rung", "parts"])


def publish(expected: DataFrame, landed: DataFrame, late: str = "10 minutes", horizon: str = "1 day") -> DataFrame:
    """(source, version, rung, parts): an asset's manifest as it grows, a version for each rung whose last part has landed.

    Streams: expected (source, rung, chunk_index, part, chunks, planned_at), ``chunks`` being how many a rung has, and landed
    (source, rung, chunk_index, landed_at). A part counts that lands within ``horizon`` of its plan, in whichever order the two
    come; parts that land twice count once. After the last part the versions hold what ``fanout.join_parts`` gives.
    """
    kind = expected.schema["source"].dataType.simpleString()
    plans = expected.withColumn("planned_at", F.col("planned_at").cast("timestamp")).withWatermark("planned_at", late).alias("e")
    parts = landed.withColumn("landed_at", F.col("landed_at").cast("timestamp")).withWatermark("landed_at", late).alias("l")
    keys = [F.col(f"e.{c}") == F.col(f"l.{c}") for c in ("source", "rung", "chunk_index")]
    in_time = (F.col("landed_at") >= F.col("planned_at")) & (F.col("landed_at") <= F.col("planned_at") + F.expr(f"INTERVAL {horizon}"))
    met = plans.join(parts, keys[0] & keys[1] & keys[2] & in_time).select("e.source", "e.rung", F.col("e.chunk_index").cast("int").alias("chunk_index"), "e.part", F.col("e.chunks").cast("int").alias("chunks"))
    return met.groupBy("source").transformWithStateInPandas(_Publish(), f"source {kind}, version long, rung string, parts array<string>", "Append", "None")


class _Submissions(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.version = handle.getValueState("version", "n long, last long")
        self.budgets = handle.getMapState("budgets", "seq long", "suspended boolean")
        self.items = handle.getMapState("items", "dedupe_key string", "items string")

    @staticmethod
    def outcomes(items: list, seqs: list, suspended: list) -> list:
        """Items (seq, id, outcome) of one key with the outcome that each has by the budgets in force."""
        first, out = True, []
        for seq, name, _ in sorted(items):
            at = bisect.bisect_right(seqs, seq) - 1
            if at < 0 or suspended[at]:
                outcome = "no_budget" if at < 0 else "suspended"
            else:
                outcome, first = "created" if first else "existing", False
            out.append([seq, name, outcome])
        return out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(rows)
        version, last = self.version.get() if self.version.exists() else (0, -1)
        changes, new = frame[frame["id"].isna()], frame[frame["id"].notna()]
        for r in changes.itertuples(index=False):
            self.budgets.updateValue((int(r.seq),), (bool(r.suspended),))
        held = sorted((int(k[0]), v[0]) for k, v in self.budgets.iterator())
        seqs, suspended = [s for s, _ in held], [x for _, x in held]
        touched = {k: [[int(x), i, None] for x, i in zip(g["seq"], g["id"], strict=True)] for k, g in new.groupby("dedupe_key")}
        if len(changes) and changes["seq"].min() <= last:  # a change that comes after submissions it holds for
            touched |= {k[0]: [] for k in self.items.keys() if k[0] not in touched}
        out = []
        for k, more in touched.items():
            before = json.loads(self.items.getValue((k,))[0]) if self.items.containsKey((k,)) else []
            known = {(seq, name) for seq, name, _ in before}
            now = self.outcomes(before + [x for x in more if (x[0], x[1]) not in known], seqs, suspended)
            if now != before:
                self.items.updateValue((k,), (json.dumps(now),))
                told = {(seq, name): outcome for seq, name, outcome in before}
                out += [(key[0], name, seq, outcome, version + 1) for seq, name, outcome in now if told.get((seq, name)) != outcome]
        self.version.update((version + 1, max(last, int(new["seq"].max())) if len(new) else last))
        yield pd.DataFrame(out, columns=["tenant_id", "id", "seq", "outcome", "version"])


def submit_outcomes(submissions: DataFrame, budgets: DataFrame, buckets: int = 64) -> DataFrame:
    """(tenant_id, id, seq, outcome, version): what each submission of a stream (id, tenant_id, dedupe_key, seq) comes to by the changes
    of a stream (tenant_id, seq, suspended), as in ``events.admitted_submissions``.

    Rows come in any order and any batches. A row that changes what was told before, such as a late change of a budget, gives a
    new row with a larger version; the last one of each submission holds. A submission that comes again changes nothing. The keys of a tenant
    are dealt to ``buckets``, each with the tenant's changes, so a large tenant is many tasks; a late change costs
    a pass over the keys of its tenant.
    """
    word = F.coalesce(F.concat(F.lit("="), "dedupe_key"), F.lit(""))
    rows = submissions.select("tenant_id", F.pmod(F.xxhash64("dedupe_key"), F.lit(buckets)).cast("int").alias("bucket"), "seq", "id", word.alias("dedupe_key"), F.lit(None).cast("boolean").alias("suspended"))
    spread = F.explode(F.sequence(F.lit(0), F.lit(buckets - 1)))
    changes = budgets.select("tenant_id", spread.alias("bucket"), "seq", F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("dedupe_key"), "suspended")
    schema = "tenant_id string, id string, seq long, outcome string, version long"
    return rows.unionByName(changes).groupBy("tenant_id", "bucket").transformWithStateInPandas(_Submissions(), schema, "Update", "None")
