"""Queries over the star-schema tables, one for each operator, and the same in SQL for another engine."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluicework import model
from sluicework.functions import media
from sluicework.functions.tables import LADDER, METRICS, TOLERANCE
from sluicework.operators import commands, events, fanout, queue, reports
from sluicework.operators import media as plan
from sluicework.plans import tick
from sluicework.sources import projections as p
from sluicework.sources import scopes, storage
from sluicework.sources.storage import cut

SLOTS, RECENT, STALL_DAYS = 8000, "30 DAY", 365
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORK = """work AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(c_nationkey AS VARCHAR) AS tenant_id,
    CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'realtime' WHEN '2' THEN 'standard' WHEN '3' THEN 'standard' ELSE 'bulk' END AS lane,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS priority_key, CAST(n_regionkey + 1 AS DOUBLE) AS fairness_weight,
    CASE WHEN o_orderstatus = 'O' THEN 'pending' WHEN o_orderstatus = 'F' THEN CASE WHEN o_orderkey % 10 = 0 THEN 'failed' ELSE 'done' END
         WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'admitted' END AS state,
    o_orderkey AS seq, o_orderdate AS created_at,
    CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 1 HOUR END AS admitted_at,
    CAST(c_nationkey AS VARCHAR) || '/' || strftime(o_orderdate, '%Y-%m-%d') AS dedupe_key
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
w AS (SELECT *, CASE WHEN state = 'running' OR (state = 'admitted' AND seq % 3 = 0) THEN 'wf-fake-' || id END AS workflow_id FROM work),
budgets AS (SELECT CAST(n_nationkey AS VARCHAR) AS tenant_id, 200 + 10 * n_regionkey AS max_concurrent_tasks, 5 + n_regionkey AS rate_limit_per_min,
  CAST(1 + n_regionkey AS DOUBLE) AS fairness_weight, n_nationkey % 7 = 0 AS suspended FROM nation)"""
AS_OF = f"TIMESTAMP '{p.AS_OF}'"
FLEET = """fleet AS (SELECT lane, count(*) FILTER (WHERE state IN ('admitted', 'running')) AS running, count(*) FILTER (WHERE state = 'pending') AS pending
  FROM w WHERE state IN ('pending', 'admitted', 'running') GROUP BY lane)"""
GRANTS = f"""f AS (SELECT {', '.join(f"coalesce(sum({c}) FILTER (WHERE lane = '{lane}'), 0) AS {c[0]}{i}" for c in ("running", "pending") for i, lane in enumerate(model.LANES))} FROM fleet),
g AS (SELECT *, greatest(0, {SLOTS} - r0 - r1 - r2) AS free,
  {', '.join(f"least(greatest(0, floor({SLOTS} * CAST(CAST({s} AS FLOAT) AS DOUBLE)) - r{i}), p{i}) AS owed{i}" for i, s in enumerate(model.LANE_SHARES))} FROM f),
g0 AS (SELECT *, least(p0, greatest(0, free - owed1 - owed2)) AS x0 FROM g),
g1 AS (SELECT *, least(p1, greatest(0, free - x0 - owed2)) AS x1 FROM g0),
g2 AS (SELECT *, least(p2, greatest(0, free - x0 - x1)) AS x2 FROM g1),
grants AS (SELECT 'realtime' AS lane, CAST(x0 AS BIGINT) AS "grant" FROM g2 UNION ALL SELECT 'standard', CAST(x1 AS BIGINT) FROM g2 UNION ALL SELECT 'bulk', CAST(x2 AS BIGINT) FROM g2)"""
CANDIDATES = f"""pend AS (SELECT lane, tenant_id, count(*) AS pending, max(fairness_weight) AS weight FROM w WHERE state = 'pending' GROUP BY ALL),
recent AS (SELECT tenant_id, count(*) AS n FROM w WHERE admitted_at > {AS_OF} - INTERVAL {RECENT} GROUP BY ALL),
held AS (SELECT tenant_id, count(*) AS n FROM w WHERE state IN ('admitted', 'running') GROUP BY ALL),
candidates AS (SELECT lane, p.tenant_id, weight, least(greatest(max_concurrent_tasks * 2 - coalesce(h.n, 0), 0), greatest(rate_limit_per_min * 4 - coalesce(r.n, 0), 0)) AS headroom, pending
  FROM pend p JOIN budgets b ON b.tenant_id = p.tenant_id LEFT JOIN recent r ON r.tenant_id = p.tenant_id LEFT JOIN held h ON h.tenant_id = p.tenant_id
  WHERE NOT suspended AND least(greatest(max_concurrent_tasks * 2 - coalesce(h.n, 0), 0), greatest(rate_limit_per_min * 4 - coalesce(r.n, 0), 0)) > 0)"""
FAIR = """e AS (SELECT c.lane, tenant_id, weight, least(headroom, pending) AS ceiling, "grant" AS slots FROM candidates c JOIN grants g ON g.lane = c.lane WHERE least(headroom, pending) > 0),
s5 AS (SELECT *, slots * weight / sum(weight) OVER (PARTITION BY lane) AS credit FROM e WHERE slots > 0),
s6 AS (SELECT *, least(CAST(floor(credit) AS BIGINT), ceiling) AS m FROM s5),
s7 AS (SELECT *, sum(m) OVER (PARTITION BY lane ORDER BY tenant_id ROWS UNBOUNDED PRECEDING) AS cum FROM s6),
s8 AS (SELECT *, least(cum, slots) - least(cum - m, slots) AS first FROM s7),
s9 AS (SELECT *, slots - sum(first) OVER (PARTITION BY lane) AS remaining, credit - first AS owed FROM s8),
u AS (SELECT lane, tenant_id, remaining, owed, unnest(range(0, CAST(least(ceiling - first, remaining) AS BIGINT))) AS j FROM s9),
x AS (SELECT lane, tenant_id, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY lane ORDER BY owed - j DESC, tenant_id, j) AS place FROM u) WHERE place <= remaining GROUP BY ALL),
shared AS (SELECT s9.lane, s9.tenant_id, CAST(first + coalesce(n, 0) AS BIGINT) AS take, greatest(least(owed - coalesce(n, 0), 1.0), -1.0) AS credit FROM s9 LEFT JOIN x ON x.lane = s9.lane AND x.tenant_id = s9.tenant_id)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _candidates(spark, d):
    limits = p.budgets(spark, d).withColumns({"max_concurrent_tasks": F.col("max_concurrent_tasks") * 2, "rate_limit_per_min": F.col("rate_limit_per_min") * 4})
    return queue.candidates(p.work(spark, d), limits, p.as_of(), RECENT)


def _grants(spark, d):
    return queue.lane_grants(queue.fleet_state(p.work(spark, d)), SLOTS)


def _shared(spark, d):
    return queue.fair_share(_candidates(spark, d), _grants(spark, d), queue.no_credits(p.budgets(spark, d)), cut)


@query(f"WITH {WORK}, {FLEET} SELECT * FROM fleet")
def fleet_state(spark, d):
    return queue.fleet_state(p.work(spark, d))


@query(f"""WITH {WORK} SELECT lane, count(*) FILTER (WHERE state = 'pending') AS waiting, count(*) FILTER (WHERE state IN ('admitted', 'running')) AS running,
  min(created_at) FILTER (WHERE state = 'pending') AS oldest FROM w WHERE state IN ('pending', 'admitted', 'running') GROUP BY lane""")
def lane_stats(spark, d):
    return queue.lane_stats(p.work(spark, d))


@query(f"""WITH {WORK}, l AS (SELECT unnest(['realtime', 'standard', 'bulk']) AS lane, unnest([0, 1, 2]) AS lane_rank),
  s AS (SELECT lane, count(*) FILTER (WHERE state = 'pending') AS waiting, count(*) FILTER (WHERE state IN ('admitted', 'running')) AS running,
    min(created_at) FILTER (WHERE state = 'pending') AS oldest FROM w GROUP BY lane)
  SELECT l.lane, lane_rank, coalesce(waiting, 0) AS waiting, coalesce(date_sub('second', oldest, {AS_OF}), 0) AS oldest_wait_seconds, coalesce(running, 0) AS running,
    CAST(sum(coalesce(running, 0)) OVER () AS BIGINT) AS fleet_running, sum(coalesce(running, 0)) OVER () / CAST({SLOTS} AS DOUBLE) AS utilization FROM l LEFT JOIN s ON s.lane = l.lane""")
def capacity_report(spark, d):
    return queue.capacity_report(p.work(spark, d), p.as_of(), SLOTS)


@query(f"WITH {WORK}, {FLEET}, {GRANTS} SELECT * FROM grants")
def lane_grants(spark, d):
    return _grants(spark, d)


@query(f"WITH {WORK}, {CANDIDATES} SELECT * FROM candidates")
def candidates(spark, d):
    return _candidates(spark, d)


@query(f"WITH {WORK}, {CANDIDATES}, {FLEET}, {GRANTS}, {FAIR} SELECT lane, tenant_id, take, round(credit, 6) AS credit FROM shared")
def fair_share_tick(spark, d):
    return _shared(spark, d).where(F.col("take") >= 0).join(_grants(spark, d).where(F.col("grant") > 0).select("lane"), "lane", "left_semi").withColumn("credit", F.round("credit", 6))


CARRIED = FAIR.replace("AS slots FROM candidates c JOIN grants g ON g.lane = c.lane WHERE", "AS slots, CASE WHEN CAST(tenant_id AS INTEGER) % 3 <> 0 THEN (CAST(tenant_id AS INTEGER) % 5 - 2) / CAST(4 AS DOUBLE) ELSE 0 END AS had FROM candidates c JOIN grants g ON g.lane = c.lane WHERE")
CARRIED = CARRIED.replace("slots * weight / sum(weight)", "had + slots * weight / sum(weight)").replace("least(CAST(floor(credit) AS BIGINT), ceiling)", "least(greatest(CAST(floor(credit) AS BIGINT), 0), ceiling)")


@query(f"WITH {WORK}, {CANDIDATES}, {FLEET}, {GRANTS}, {CARRIED} SELECT lane, tenant_id, take, round(credit, 6) AS credit FROM shared")
def fair_share_carried(spark, d):
    """A tick whose lanes carry credits, some below zero, from those before."""
    key = F.col("tenant_id").cast("int")
    lanes = F.explode(F.array(*map(F.lit, model.LANES)))
    had = p.budgets(spark, d).where(key % 3 != 0).select(lanes.alias("lane"), "tenant_id", ((key % 5 - 2) / 4).alias("credit"))
    waiting, grants = _candidates(spark, d), _grants(spark, d)
    turns = waiting.join(grants.where(F.col("grant") > 0).select("lane"), "lane", "left_semi").select("lane", "tenant_id")
    return queue.fair_share(waiting, grants, had, cut).join(turns, ["lane", "tenant_id"], "left_semi").withColumn("credit", F.round("credit", 6))


@query(f"""WITH {WORK}, {CANDIDATES}, {FLEET}, {GRANTS}, {FAIR}, r AS (
  SELECT w.*, take, row_number() OVER (PARTITION BY w.lane, w.tenant_id ORDER BY priority_key, created_at, id) AS claim_rank
  FROM w JOIN shared s ON s.lane = w.lane AND s.tenant_id = w.tenant_id WHERE state = 'pending' AND take > 0)
  SELECT id, tenant_id, lane, priority_key, claim_rank FROM r WHERE claim_rank <= take""")
def claim_topn(spark, d):
    return queue.claim(p.work(spark, d), _shared(spark, d)).select("id", "tenant_id", "lane", "priority_key", F.col("claim_rank").cast("long").alias("claim_rank"))


@query(f"WITH {WORK} SELECT id, tenant_id, lane, state, created_at FROM w WHERE state = 'pending' ORDER BY created_at DESC, id LIMIT 100")
def work_list(spark, d):
    return queue.work_list(p.work(spark, d), state="pending").select("id", "tenant_id", "lane", "state", "created_at")


@query(f"WITH {WORK} SELECT id, tenant_id, lane, admitted_at FROM w WHERE state = 'admitted' AND workflow_id IS NULL AND admitted_at < {AS_OF} - INTERVAL {STALL_DAYS} DAY")
def stalled(spark, d):
    return queue.stalled(p.work(spark, d), p.as_of(), STALL_DAYS * 86_400).select("id", "tenant_id", "lane", "admitted_at")


@query(f"WITH {WORK} SELECT id, tenant_id, admitted_at FROM w WHERE state = 'running' AND admitted_at < {AS_OF} - INTERVAL {STALL_DAYS} DAY")
def overdue_running(spark, d):
    return queue.overdue(p.work(spark, d), p.as_of(), STALL_DAYS * 86_400).select("id", "tenant_id", "admitted_at")


@query(f"""WITH {WORK}, held AS (SELECT tenant_id, count(*) AS n FROM w WHERE state IN ('admitted', 'running') GROUP BY ALL),
  b AS (SELECT budgets.tenant_id, CASE WHEN CAST(budgets.tenant_id AS INTEGER) % 3 = 0 THEN NULL WHEN CAST(budgets.tenant_id AS INTEGER) % 3 = 1 THEN coalesce(n, 0) ELSE coalesce(n, 0) + 1 END AS stored, coalesce(n, 0) AS actual
    FROM budgets LEFT JOIN held ON held.tenant_id = budgets.tenant_id)
  SELECT * FROM b WHERE stored IS DISTINCT FROM actual""")
def in_flight_drift(spark, d):
    work = p.work(spark, d)
    key, n = F.col("tenant_id").cast("int") % 3, F.coalesce("in_flight", F.lit(0))
    stored = p.budgets(spark, d).join(queue.in_flight(work), "tenant_id", "left").withColumn("in_flight", F.when(key == 0, F.lit(None)).when(key == 1, n).otherwise(n + 1))
    return queue.drift(stored, work)


@query(f"""WITH {WORK}, c AS (SELECT CAST(l_orderkey AS VARCHAR) AS work_id, l_quantity AS q, CAST(floor(l_extendedprice) AS BIGINT) AS b, CAST(l_suppkey AS VARCHAR) AS m,
    {{'a': l_linenumber, 'b': l_suppkey, 'c': l_partkey, 'd': l_extendedprice}} AS seq FROM lineitem)
  SELECT work_id, any_value(tenant_id) AS tenant_id, sum(q) AS encode_seconds, CAST(sum(b) AS BIGINT) AS bytes_written, max({{'s': c.seq, 'm': m}}).m AS machine FROM c JOIN w ON w.id = c.work_id GROUP BY work_id""")
def cost_rollup(spark, d):
    return queue.cost_rollup(p.work(spark, d), p.cost_events(spark, d))


@query(f"""WITH {WORK} SELECT id, tenant_id, dedupe_key, row_number() OVER (PARTITION BY tenant_id, dedupe_key ORDER BY seq) = 1 AS created FROM w""")
def dedupe_first_wins(spark, d):
    return events.first_wins(p.work(spark, d).select("id", "tenant_id", "dedupe_key", "seq"), ["tenant_id", "dedupe_key"], ["seq"]).drop("seq")


@query(f"""WITH {WORK}, o AS (SELECT id, w.tenant_id, dedupe_key, seq, suspended, row_number() OVER (PARTITION BY w.tenant_id, dedupe_key, coalesce(NOT suspended, false) ORDER BY seq) AS place
    FROM w LEFT JOIN budgets b ON b.tenant_id = w.tenant_id AND b.tenant_id <> '3')
  SELECT id, CASE WHEN suspended IS NULL THEN 'no_budget' WHEN suspended THEN 'suspended' WHEN place = 1 THEN 'created' ELSE 'existing' END AS outcome FROM o""")
def submit_outcomes(spark, d):
    rows = p.work(spark, d).select("id", "tenant_id", "dedupe_key", "seq")
    return events.admitted_submissions(rows, p.budgets(spark, d).where(F.col("tenant_id") != "3")).select("id", "outcome")


@query(f"""WITH {WORK} SELECT tenant_id, max({{'s': seq, 'l': lane, 'p': priority_key}}).s AS seq, max({{'s': seq, 'l': lane, 'p': priority_key}}).l AS lane, max({{'s': seq, 'l': lane, 'p': priority_key}}).p AS priority_key
  FROM w GROUP BY tenant_id""")
def budget_latest(spark, d):
    return events.latest_wins(p.work(spark, d).select("tenant_id", "seq", "lane", "priority_key"), ["tenant_id"], "seq")


@query(f"""WITH {WORK}, t AS (SELECT 'work' AS name, tenant_id FROM w UNION ALL SELECT 'tenant_budgets', tenant_id FROM budgets UNION ALL SELECT 'work_cost', tenant_id FROM lineitem JOIN w ON id = CAST(l_orderkey AS VARCHAR)),
  n AS (SELECT DISTINCT name FROM t) SELECT 'service' AS scope, name, count(*) AS n FROM t GROUP BY name UNION ALL SELECT 'tenant', name, count(*) FROM t WHERE tenant_id = '7' GROUP BY name UNION ALL SELECT 'none', name, 0 FROM n""")
def tenant_scope(spark, d):
    work = p.work(spark, d)
    costs = p.cost_events(spark, d).drop("seq").join(work.select(F.col("id").alias("work_id"), "tenant_id"), "work_id")
    scopes.open_views(spark, work=work, tenant_budgets=p.budgets(spark, d), work_cost=costs)
    seen = []
    for scope, tenant in (("service", None), (None, "7"), (None, None)):
        scopes.set_scope(spark, scope, tenant)
        shown = F.lit(scope or ("tenant" if tenant else "none"))
        seen += [spark.table(f"scoped_{t}").agg(F.count(F.lit(1)).alias("n")).select(shown.alias("scope"), F.lit(t).alias("name"), "n") for t in scopes.TABLES]
    scopes.set_scope(spark)
    return functools.reduce(DataFrame.unionByName, seen)


@query(f"""WITH {WORK}, fin AS (SELECT id, seq % 4 = 1 AS released, state IN ('running', 'done', 'failed') OR seq % 11 = 0 AS run, state IN ('done', 'failed') AS ended, state <> 'pending' AS admitted, created_at, seq FROM w),
  s AS (SELECT id, created_at, CASE WHEN ended THEN CASE WHEN seq % 10 = 0 THEN 'failed' WHEN seq % 17 = 0 THEN 'canceled' ELSE 'done' END
      WHEN NOT admitted OR released THEN 'pending' WHEN run THEN 'running' ELSE 'admitted' END AS state,
    CASE WHEN admitted THEN 1 ELSE 0 END AS attempts, CASE WHEN admitted AND NOT released THEN created_at + INTERVAL 1 HOUR END AS admitted_at, CASE WHEN ended THEN created_at + INTERVAL 4 HOUR END AS finished_at,
    CAST(run AND (NOT admitted OR released) AS BIGINT) + CAST(ended AND seq % 3 = 0 AS BIGINT) + CAST(seq % 13 = 0 AS BIGINT) AS ignored FROM fin)
  SELECT id AS work_id, state, attempts, admitted_at, finished_at, ignored FROM s""")
def state_fold(spark, d):
    return events.fold(p.work_events(spark, d)).select("work_id", "state", "attempts", "admitted_at", "finished_at", "ignored")


@query(f"WITH {WORK} SELECT tenant_id, count(*) AS recent FROM w WHERE admitted_at > {AS_OF} - INTERVAL {RECENT} GROUP BY tenant_id")
def rate_limit_recent(spark, d):
    return queue.recent_admissions(p.work(spark, d), p.as_of(), RECENT)


SOURCES = """src AS (SELECT p_partkey AS source, CAST(floor(p_size * 48 * 16 / 9) AS BIGINT) AS w0, CAST(p_size * 48 AS BIGINT) AS h0, CASE WHEN p_partkey % 5 <> 0 THEN CAST(floor(p_retailprice * 4000) AS BIGINT) END AS bit_rate,
    p_partkey % 4 = 0 AS turned, p_partkey % 6 = 0 AS wide FROM part),
  disp AS (SELECT source, bit_rate, CASE WHEN turned THEN h0 ELSE CASE WHEN wide THEN (w0 * 4 + 1) // 3 ELSE w0 END END AS dw, CASE WHEN turned THEN CASE WHEN wide THEN (w0 * 4 + 1) // 3 ELSE w0 END ELSE h0 END AS dh FROM src)"""
RUNGS = "rungs AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{n}', {h}, {b}, {c})" for i, (n, h, b, c) in enumerate(LADDER)) + ") t(k, rung, h, max_bitrate, crf))"
STEPS = f"""{SOURCES}, {RUNGS}, fit AS (SELECT source, dw, dh, k, rung, least(h, dh) AS h, max_bitrate, crf FROM disp JOIN rungs ON h <= dh AND (bit_rate IS NULL OR max_bitrate < bit_rate) WHERE dw > 0 AND dh > 0),
  small AS (SELECT source, dw, dh, 3 AS k, '{LADDER[-1][0]}' AS rung, least({LADDER[-1][1]}, dh - dh % 2) AS h, {LADDER[-1][2]} AS max_bitrate, {LADDER[-1][3]} AS crf FROM disp WHERE dw > 0 AND dh > 0 AND source NOT IN (SELECT source FROM fit)),
  chosen AS (SELECT * FROM fit UNION ALL SELECT * FROM small),
  steps AS (SELECT source, CAST(row_number() OVER (PARTITION BY source ORDER BY k) - 1 AS INTEGER) AS pos, rung, h - h % 2 AS height0, dw, dh, max_bitrate, crf FROM chosen),
  sized AS (SELECT source, pos, rung, greatest((height0 * dw + dh // 2) // dh + 1 - ((height0 * dw + dh // 2) // dh + 1) % 2, 2) AS width, greatest(height0, 2) AS height, max_bitrate, crf FROM steps)"""


@query(f"WITH {SOURCES} SELECT source, dw AS width, dh AS height FROM disp")
def display_size(spark, d):
    s = p.ladder_sources(spark, d)
    return s.select("source", media.display_size(*(F.col(c) for c in ("width", "height", "rotation", "sar_num", "sar_den"))).alias("d")).select("source", "d.width", "d.height")


@query(f"WITH {STEPS} SELECT * FROM sized")
def ladder_plan(spark, d):
    return plan.ladder_plan(p.ladder_sources(spark, d))


@query(f"WITH {STEPS} SELECT source, pos, rung, width, height FROM (SELECT *, count(*) OVER (PARTITION BY source) AS n FROM sized) WHERE pos = n // 2")
def fast_path(spark, d):
    return plan.fast_path(plan.ladder_plan(p.ladder_sources(spark, d)), ["source"]).select("source", "pos", "rung", "width", "height")


@query(f"WITH {STEPS} SELECT source, rung, CASE WHEN pos = count(*) OVER (PARTITION BY source) // 2 THEN 'fast' ELSE 'quality' END AS path FROM sized")
def two_paths(spark, d):
    return plan.two_paths(plan.ladder_plan(p.ladder_sources(spark, d)), ["source"]).select("source", "rung", "path")


@query(f"""WITH {SOURCES} SELECT source, greatest((h * dw + dh // 2) // dh + 1 - ((h * dw + dh // 2) // dh + 1) % 2, 2) AS width, greatest(h, 2) AS height
  FROM (SELECT *, least(480, dh) - least(480, dh) % 2 AS h FROM disp WHERE dw > 0 AND dh > 0)""")
def job_sizes(spark, d):
    s = display_size(spark, d).where((F.col("width") > 0) & (F.col("height") > 0))
    return s.select("source", media.job_size(F.lit(480), F.col("width"), F.col("height")).alias("s")).select("source", "s.width", "s.height")


TARGET, DURATION = 86_400_000, 30 * 86_400_000
KEYS = f"kf AS (SELECT user_id AS source, epoch_us(ts) // 1000 - {p.EPOCH_MS} AS ms FROM events), idx AS (SELECT source, list_sort(list_distinct(list(ms))) AS k FROM kf GROUP BY source)"
CHUNKS = f"""{KEYS}, cuts AS (SELECT source, list_reduce(k, lambda a, x: CASE WHEN x > a[-1] AND x - a[-1] >= {TARGET} THEN list_append(a, x) ELSE a END, [CAST(0 AS BIGINT)]) AS b FROM idx),
  ch AS (SELECT source, unnest(range(0, len(b))) AS i, b FROM cuts WHERE len(b) >= 2),
  chunks AS (SELECT source, CAST(i AS INTEGER) AS chunk_index, b[i + 1] AS start_ms, coalesce(b[i + 2], {DURATION}) AS end_ms FROM ch WHERE coalesce(b[i + 2], {DURATION}) > b[i + 1]
    UNION ALL SELECT source, 0, 0, {DURATION} FROM cuts WHERE len(b) < 2)"""


def _chunks(spark, d):
    return plan.split_keyframes(p.keyframes(spark, d).withColumn("duration_ms", F.lit(DURATION).cast("long")), TARGET)


@query(f"WITH {CHUNKS} SELECT * FROM chunks")
def split_plan(spark, d):
    return _chunks(spark, d).select("source", "chunk_index", "start_ms", "end_ms")


@query(f"""WITH {KEYS}, o AS (SELECT source, ms, lag(ms) OVER (PARTITION BY source ORDER BY ms) AS before_ms FROM (SELECT DISTINCT source, ms FROM kf))
  SELECT source, before_ms, ms, ms - before_ms AS gap_ms FROM o WHERE ms - before_ms > {model.SPARSE_GAP_MS}""")
def sparse_gaps(spark, d):
    return plan.sparse_gaps(p.keyframes(spark, d))


@query("""WITH x AS (SELECT user_id, event_id, CASE WHEN event_id % 5 <> 0 THEN value END AS dts FROM events),
  y AS (SELECT *, last_value(dts IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM x)
  SELECT user_id, event_id, dts, previous FROM y WHERE dts < previous""")
def monotonic_check(spark, d):
    rows = p.table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("dts"))
    return plan.backward_timestamps(rows, ["user_id"], ["event_id"])


REND = """r AS (SELECT l_orderkey AS asset, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS pos, CAST(l_quantity AS INTEGER) AS n,
    CASE WHEN l_partkey % 9 <> 0 THEN CAST(l_quantity AS BIGINT) END AS frames, CAST(floor(l_extendedprice) AS BIGINT) % 100 AS dur, CASE WHEN l_linenumber < 6 THEN 30.0 ELSE 25.0 END AS fps, l_partkey FROM lineitem),
  k AS (SELECT *, list_transform(range(0, n % 4 + 1), lambda i: CAST(i * 2000 AS VARCHAR)) AS keys FROM r),
  v AS (SELECT *, first_value(frames) OVER o AS rf, first_value(dur) OVER o AS rd, first_value(keys) OVER o AS rk, first_value(fps) OVER o AS rfps FROM k WINDOW o AS (PARTITION BY asset ORDER BY pos)),
  found AS (SELECT asset, pos, 'frame_count' AS problem, CAST(rf AS VARCHAR) AS expected, CAST(frames AS VARCHAR) AS actual FROM v WHERE pos > 1 AND rf <> frames
    UNION ALL SELECT asset, pos, 'keyframe_mismatch', array_to_string(rk, ','), array_to_string(keys, ',') FROM v WHERE pos > 1 AND rk <> keys
    UNION ALL SELECT asset, pos, 'duration', CAST(rd AS VARCHAR), CAST(dur AS VARCHAR) FROM v WHERE pos > 1 AND abs(dur - rd) > ceil(1000 / rfps)
    UNION ALL SELECT asset, pos, 'unexpected_warning', NULL, CASE WHEN l_partkey % 50 = 0 THEN 'rotation_metadata' ELSE 'variable_frame_rate' END FROM v WHERE l_partkey % 50 < 2)"""


@query(f"WITH {REND} SELECT asset, 'r' || pos AS name, problem, expected, actual FROM found")
def verify_findings(spark, d):
    return plan.verify(p.renditions(spark, d))


@query(f"""WITH {REND}, b AS (SELECT asset, count(*) AS n FROM found GROUP BY asset) SELECT r.asset, count(*) AS checked, coalesce(any_value(b.n), 0) AS findings, coalesce(any_value(b.n), 0) = 0 AS ok
  FROM r LEFT JOIN b ON b.asset = r.asset GROUP BY r.asset""")
def verify_verdicts(spark, d):
    rows = p.renditions(spark, d)
    return plan.verdicts(rows, plan.verify(rows))


HASH_SQL = "CAST(" + " + ".join(f"(CASE WHEN embedding[{r * 8 + c + 1}] > embedding[{r * 8 + c + 2}] THEN CAST({1 << (r * 7 + c)} AS BIGINT) ELSE 0 END)" for r in range(8) for c in range(7)) + " AS BIGINT)"
NEAR = 16


def _hashes(spark, d):
    return p.table(spark, d, "embeddings").select("vec_id", "label", media.dhash(F.col("embedding"), 8, 8).alias("phash"))


@query(f"SELECT vec_id, {HASH_SQL} AS phash FROM embeddings")
def dhash(spark, d):
    return _hashes(spark, d).select("vec_id", "phash")


@query(f"""WITH h AS (SELECT vec_id, label, {HASH_SQL} AS phash FROM embeddings), x AS (SELECT s.vec_id AS sample_id, b.vec_id AS pos, b.phash AS known, bit_count(xor(s.phash, b.phash)) AS distance
    FROM h s JOIN h b ON b.label = 0 AND s.label <> 0 WHERE bit_count(xor(s.phash, b.phash)) <= {NEAR})
  SELECT sample_id, known, CAST(distance AS INTEGER) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY distance, pos) AS rn FROM x) WHERE rn = 1""")
def blocklist_match(spark, d):
    h = _hashes(spark, d)
    return plan.blocklist_match(h.where("label <> 0").select(F.col("vec_id").alias("sample_id"), "phash"), h.where("label = 0").select(F.col("vec_id").alias("pos"), F.col("phash").alias("known")), NEAR)


@query(f"""WITH h AS (SELECT vec_id, label, {HASH_SQL} AS phash FROM embeddings), x AS (SELECT s.vec_id // 10 AS asset, s.vec_id % 10 AS i, b.phash AS known, bit_count(xor(s.phash, b.phash)) AS distance, b.vec_id AS pos
    FROM h s JOIN h b ON b.label = 0 AND s.label <> 0 WHERE bit_count(xor(s.phash, b.phash)) <= {NEAR})
  SELECT asset, CAST(distance AS INTEGER) AS distance, i AS sample_index, known FROM (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY distance, i, pos) AS rn FROM x) WHERE rn = 1""")
def blocklist_asset_hits(spark, d):
    samples = _hashes(spark, d).select(F.col("vec_id").alias("sample_id"), F.floor(F.col("vec_id") / 10).alias("asset"), (F.col("vec_id") % 10).alias("index"))
    return plan.asset_hits(samples, blocklist_match(spark, d))


@query("SELECT user_id, event_id, unnest(list_transform(range(0, 60), lambda i: CAST(floor(value * 1000) AS BIGINT) * (2 * i + 1) // 120)) AS sample_ms FROM events")
def sample_times(spark, d):
    return p.table(spark, d, "events").select("user_id", "event_id", F.explode(media.sample_times_ms(F.floor(F.col("value") * 1000))).alias("sample_ms"))


SCORES = f"""sc AS (SELECT l_returnflag AS run, 'part' || p_partkey AS file, p_brand AS brand, p_type || '-' || CAST(l_suppkey % 3 AS VARCHAR) AS rung, [{', '.join(f"'{m}'" for m in METRICS)}][l_linenumber % {len(METRICS)} + 1] AS metric, round(l_extendedprice, 0) AS value
  FROM lineitem JOIN part ON l_partkey = p_partkey),
  po AS (SELECT run, file, rung, metric, avg(value) AS mean, min(value) AS lo, max(value) AS hi, count(*) AS frames FROM sc GROUP BY ALL),
  bef AS (SELECT CASE run WHEN 'A' THEN 1 ELSE 2 END AS step, * FROM po WHERE run IN ('A', 'R')), aft AS (SELECT CASE run WHEN 'R' THEN 1 ELSE 2 END AS step, * FROM po WHERE run IN ('R', 'N')),
  tol AS (SELECT * FROM (VALUES {', '.join(f"('{m}', CAST({t} AS DOUBLE))" for m, t in TOLERANCE.items())}) t(metric, tolerance)),
  diff AS (SELECT b.step, b.file, b.rung, b.metric, b.mean AS "before", a.mean AS "after", a.mean - b.mean AS delta, CASE WHEN b.metric = 'cambi' THEN a.mean - b.mean ELSE b.mean - a.mean END AS worse, tolerance
    FROM bef b JOIN aft a ON a.step = b.step AND a.file = b.file AND a.rung = b.rung AND a.metric = b.metric JOIN tol ON tol.metric = b.metric),
  changed AS (SELECT coalesce(a.step, b.step) AS step, coalesce(a.file, b.file) AS file, coalesce(a.rung, b.rung) AS rung, CASE WHEN b.file IS NULL THEN 'missing' ELSE 'added' END AS change
    FROM (SELECT DISTINCT step, file, rung FROM bef) a FULL JOIN (SELECT DISTINCT step, file, rung FROM aft) b ON a.step = b.step AND a.file = b.file AND a.rung = b.rung WHERE a.file IS NULL OR b.file IS NULL)"""


def _pooled(spark, d):
    return reports.pooled(p.frame_scores(spark, d), ["run", "file", "rung"])


def _before_after(spark, d):
    """Two comparisons: step 1 of run A with R, step 2 of R with N."""
    rows = _pooled(spark, d).withColumn("value", F.col("mean"))
    step = lambda first: F.when(F.col("run") == first, 1).otherwise(2).alias("step")
    return rows.where("run IN ('A', 'R')").select(step("A"), "*"), rows.where("run IN ('R', 'N')").select(step("R"), "*")


@query(f"WITH {SCORES} SELECT run, file, rung, metric, round(mean, 4) AS mean, lo AS min, hi AS max, frames FROM po")
def pooled_metrics(spark, d):
    return _pooled(spark, d).withColumn("mean", F.round("mean", 4))


@query(f"""WITH {SCORES} SELECT step, file, rung, metric, round("before", 4) AS "before", round("after", 4) AS "after", round(delta, 4) AS delta, round(worse, 4) AS worse, worse > tolerance AS regression FROM diff""")
def report_diff(spark, d):
    rows = reports.compare(*_before_after(spark, d), by=["step"])
    return rows.withColumns({c: F.round(c, 4) for c in ("before", "after", "delta", "worse")})


@query(f"WITH {SCORES} SELECT * FROM changed")
def report_missing_added(spark, d):
    return reports.missing_and_added(*_before_after(spark, d), by=["step"])


@query(f"""WITH {SCORES}, n AS (SELECT step, CASE WHEN worse > tolerance THEN 'regression' END AS change FROM diff UNION ALL SELECT step, change FROM changed)
  SELECT step, count(*) FILTER (WHERE change = 'regression') AS regressions, count(*) FILTER (WHERE change = 'missing') AS missing, count(*) FILTER (WHERE change = 'added') AS added,
    count(*) FILTER (WHERE change IN ('regression', 'missing')) = 0 AS clean FROM n GROUP BY step""")
def report_verdict(spark, d):
    before, after = _before_after(spark, d)
    return reports.diff_verdict(reports.compare(before, after, by=["step"]), reports.missing_and_added(before, after, by=["step"]), by=["step"])


@query(f"WITH {SCORES} SELECT run, file, rung, round(mean, 4) AS mean, mean >= 50000 AS passed FROM po WHERE metric = 'vmaf'")
def gate(spark, d):
    return reports.gate(_pooled(spark, d), ["run", "file", "rung"], 50_000.0).withColumn("mean", F.round("mean", 4))


@query("SELECT user_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 2) AS value FROM events GROUP BY ALL")
def json_property_sum(spark, d):
    k = F.from_json("props", "k long")["k"]
    return p.table(spark, d, "events").groupBy("user_id", k.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("value"))


JOBS = f"""{CHUNKS}, {STEPS}, jobs AS (SELECT c.source, chunk_index, rung, start_ms, end_ms, rung || '-' || lpad(CAST(chunk_index AS VARCHAR), 5, '0') || '.mp4' AS part FROM chunks c JOIN sized s ON s.source = c.source)"""


def _jobs(spark, d):
    return fanout.chunk_rung_jobs(_chunks(spark, d), plan.ladder_plan(p.ladder_sources(spark, d)))


@query(f"WITH {JOBS} SELECT source, chunk_index, start_ms, end_ms, rung, part FROM jobs")
def chunk_rung_jobs(spark, d):
    return _jobs(spark, d)


@query(f"WITH {JOBS} SELECT source, rung, string_agg(part, ',' ORDER BY chunk_index) AS parts FROM jobs GROUP BY source, rung")
def join_parts(spark, d):
    return fanout.join_parts(_jobs(spark, d)).withColumn("parts", F.array_join("parts", ","))


@query(f"WITH {JOBS} SELECT source, rung, chunk_index, CAST(coalesce(sum(end_ms - start_ms) OVER (PARTITION BY source, rung ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset_ms FROM jobs")
def join_offsets(spark, d):
    rows = _jobs(spark, d).withColumn("duration_ms", F.col("end_ms") - F.col("start_ms"))
    return fanout.join_offsets(rows).select("source", "rung", "chunk_index", "offset_ms")


@query(f"WITH {JOBS} SELECT source, chunk_index, count(*) AS rungs, greatest(60000, (end_ms - start_ms) * 4 * count(*)) AS budget_ms FROM jobs GROUP BY source, chunk_index, start_ms, end_ms")
def straggler_budget(spark, d):
    return fanout.straggler_budgets(_jobs(spark, d))


@query(f"WITH {JOBS}, landed AS (SELECT DISTINCT source, rung FROM jobs WHERE source % 2 = 0 AND rung <> '1080p') SELECT source, rung FROM sized WHERE (source, rung) IN (SELECT source, rung FROM landed)")
def ready_rungs(spark, d):
    landed = _jobs(spark, d).where("source % 2 = 0 AND rung <> '1080p'").select("source", "rung").distinct()
    return fanout.ready(plan.ladder_plan(p.ladder_sources(spark, d)).select("source", "rung"), landed)


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS frames, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT)) AS BIGINT) AS bytes, sum(l_quantity) AS seconds FROM lineitem")
def chunk_totals(spark, d):
    rows = p.table(spark, d, "lineitem").select(F.col("l_linenumber").alias("frames"), F.floor("l_extendedprice").cast("long").alias("bytes"), F.col("l_quantity").alias("seconds"))
    return fanout.totals(rows)


@query("""SELECT p_partkey AS source, CASE WHEN w = 0 OR h = 0 THEN 'size.none' WHEN w % 2 <> 0 OR h % 2 <> 0 THEN 'size.uneven' WHEN p_partkey % 11 = 0 THEN 'rate.none'
  WHEN p_partkey % 13 = 0 THEN 'gop.none' WHEN p_partkey % 17 = 0 THEN 'gop.not_closed' WHEN p_partkey % 20 = 0 THEN 'threads.none' WHEN p_partkey % 20 > 16 THEN 'threads.over_limit' WHEN p_partkey % 60 > 51 THEN 'quality.over_scale'
  WHEN p_partkey % 3 = 0 AND p_size < 10 THEN 'depth.not_in_codec' END AS problem FROM (SELECT *, p_size * 7 AS w, p_size * 48 AS h FROM part)""")
def spec_validate(spark, d):
    k = F.col("p_partkey")
    spec = F.struct(
        (F.col("p_size") * 7).alias("width"), (F.col("p_size") * 48).alias("height"), F.when(k % 11 == 0, 0).otherwise(30).alias("fps_num"), F.lit(1).alias("fps_den"),
        F.when(k % 13 == 0, 0).otherwise(60).alias("gop_frames"), (k % 17 != 0).alias("closed_gop"), (k % 20).alias("threads"), F.lit("crf").alias("mode"), (k % 60).alias("crf"),
        F.lit(1000).alias("max_bitrate"), F.lit(2000).alias("buffer_size"), F.lit(0).alias("bitrate"), F.when(k % 3 == 0, "yuv420p10le").otherwise("yuv420p").alias("pixel_format"),
        F.when(F.col("p_size") < 10, "h264").otherwise("h265").alias("codec"),
    )
    return p.table(spark, d, "part").select(k.alias("source"), media.spec_problem(spec).alias("problem"))


@query("""SELECT event_id, CASE WHEN len(parts) >= 5 THEN array_to_string(parts[-5:], '-') END AS work_id FROM (SELECT event_id, string_split(CASE WHEN event_id % 3 = 0 THEN 'wf-' || event_type || '-a-b-c-' || user_id || '-' || event_id ELSE event_type || '-' || event_id END, '-') AS parts FROM events)""")
def workid_from_workflow(spark, d):
    name = F.when(F.col("event_id") % 3 == 0, F.concat_ws("-", F.lit("wf"), "event_type", F.lit("a-b-c"), "user_id", "event_id")).otherwise(F.concat_ws("-", "event_type", "event_id"))
    return p.table(spark, d, "events").select("event_id", media.work_id_of(name).alias("work_id"))


@query("""SELECT p_partkey AS source, CASE p_partkey % 4 WHEN 1 THEN 'transpose=clock,' WHEN 2 THEN 'hflip,vflip,' WHEN 3 THEN 'transpose=cclock,' ELSE '' END || 'fps=' || (p_size + 1) || '/1,scale=' || p_size * 2 || ':' || p_size || ':flags=bicubic,setsar=1/1,format=yuv420p' AS chain,
  greatest(1, CAST(round((p_size + 1) / 3.0 * 2) AS BIGINT)) AS gop, least(CAST(p_size AS BIGINT) * 100000000 * 2, 4294967295) AS buffer_size FROM part""")
def encode_settings(spark, d):
    size = F.col("p_size")
    return p.table(spark, d, "part").select(
        F.col("p_partkey").alias("source"), media.filter_chain(F.col("p_partkey") % 4 * 90, size + 1, F.lit(1), size * 2, size, F.lit("yuv420p")).alias("chain"),
        media.default_gop((size + 1) / 3.0).alias("gop"), media.vbv_buffer(size.cast("long") * 100_000_000).alias("buffer_size"),
    )


@query("""WITH o AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'error' THEN '✗ broken ' || event_id WHEN 'click' THEN '! odd ' || event_id WHEN 'view' THEN '✓ fine' ELSE ' plain ' || event_id || ' ' END AS m FROM events)
  SELECT user_id, CASE WHEN substr(m, 1, 1) = '✗' THEN 'error' WHEN substr(m, 1, 1) = '!' THEN 'warning' ELSE 'error' END AS severity, 'S / ' || event_type AS section, trim(CASE WHEN substr(m, 1, 1) IN ('✗', '!') THEN substr(m, 2) ELSE m END) AS message
  FROM o WHERE substr(m, 1, 1) <> '✓' AND event_id % 2 = 0""")
def conform_findings(spark, d):
    return reports.conform_findings(_reports(spark, d)).drop("part", "place")


def _reports(spark, d):
    """(user_id, part, report): reports of ten thousand events at most, so that no user makes one of any size."""
    text = F.col("event_id").cast("string")
    m = F.when(F.col("event_type") == "error", F.concat(F.lit("✗ broken "), text)).when(F.col("event_type") == "click", F.concat(F.lit("! odd "), text)).when(F.col("event_type") == "view", "✓ fine").otherwise(F.concat(F.lit(" plain "), text, F.lit(" ")))
    test = F.struct(F.lit("S").alias("spec"), F.lit("").alias("section"), F.col("event_type").alias("test"), F.when(F.col("event_id") % 2 == 0, "FAIL").otherwise("PASS").alias("state"), F.array(m).alias("messages"))
    rows = p.table(spark, d, "events").groupBy("user_id", F.floor(F.col("event_id") / 10_000).alias("part")).agg(F.collect_list(test).alias("test"))
    verdict = F.when(F.col("user_id") % 3 == 0, "FAIL").otherwise("PASS")
    built = F.to_json(F.struct(verdict.alias("verdict"), F.struct(F.array(F.struct("test")).alias("MPD")).alias("entries")))
    return rows.select("user_id", "part", built.alias("report"))


@query("""WITH o AS (SELECT user_id, event_id // 10000 AS part, count(*) AS tests_run, count(*) FILTER (WHERE event_id % 2 = 0 AND event_type NOT IN ('click', 'view')) AS errors,
    count(*) FILTER (WHERE event_id % 2 = 0 AND event_type = 'click') AS warnings, user_id % 3 <> 0 AS passed FROM events GROUP BY ALL)
  SELECT *, passed AND errors = 0 AS conformant FROM o""")
def conform_verdicts(spark, d):
    return reports.conform_verdict(_reports(spark, d)).select("user_id", "part", "tests_run", "errors", "warnings", "passed", "conformant")


@query("""WITH o AS (SELECT user_id, event_id, event_type, CASE event_type WHEN 'error' THEN '✗ broken ' || event_id WHEN 'click' THEN '! odd ' || event_id WHEN 'view' THEN '✓ fine' ELSE ' plain ' || event_id || ' ' END AS m FROM events)
  SELECT user_id, 'S / ' || event_type AS section, trim(CASE WHEN substr(m, 1, 1) = '✗' THEN substr(m, 2) ELSE m END) AS message FROM o WHERE event_type NOT IN ('click', 'view') AND event_id % 2 = 0""")
def conform_errors(spark, d):
    return reports.worst_first(reports.at_least(reports.conform_findings(_reports(spark, d)), "error")).select("user_id", "section", "message")


HISTORY = """hist AS (SELECT CAST(n_nationkey AS VARCHAR) AS tenant_id, 0 AS from_seq, n_nationkey % 7 = 0 AS suspended FROM nation WHERE n_nationkey % 5 <> 4
    UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 7000, n_nationkey % 2 = 0 FROM nation),
  spans AS (SELECT *, lead(from_seq) OVER (PARTITION BY tenant_id ORDER BY from_seq) AS until FROM hist)"""


@query(f"""WITH {WORK}, {HISTORY}, o AS (SELECT id, seq, suspended, row_number() OVER (PARTITION BY w.tenant_id, dedupe_key, coalesce(NOT suspended, false) ORDER BY seq) AS place
    FROM w LEFT JOIN spans b ON b.tenant_id = w.tenant_id AND seq >= from_seq AND (until IS NULL OR seq < until))
  SELECT id, CASE WHEN suspended IS NULL THEN 'no_budget' WHEN suspended THEN 'suspended' WHEN place = 1 THEN 'created' ELSE 'existing' END AS outcome FROM o""")
def submit_outcomes_as_of(spark, d):
    rows = p.work(spark, d).select("id", "tenant_id", "dedupe_key", "seq")
    now = p.budgets(spark, d).select("tenant_id", "fairness_weight", "suspended")
    key = F.col("tenant_id").cast("int")
    then = now.where(key % 5 != 4).withColumn("seq", F.lit(0).cast("long")).unionByName(now.withColumns({"suspended": key % 2 == 0, "seq": F.lit(7000).cast("long")}))
    return events.admitted_submissions(rows, then).select("id", "outcome")


@query(f"""WITH {STEPS}, a AS (SELECT source, rung AS name, CAST(row_number() OVER (PARTITION BY source ORDER BY width * height DESC, rung) - 1 AS INTEGER) AS pos FROM sized)
  SELECT s.source, s.pos, s.rung, a.name FROM sized s JOIN a ON a.source = s.source AND a.pos = s.pos""")
def zipped_renditions(spark, d):
    steps = plan.ladder_plan(p.ladder_sources(spark, d))
    placed = plan.by_area(steps.select(F.col("source").alias("asset"), F.col("rung").alias("name"), "width", "height"))
    placed = placed.select(F.col("asset").alias("source"), (F.col("pos") - 1).alias("pos"), "name")
    return fanout.zip_positions([steps.select("source", "pos", "rung"), placed], ["source"])


@query(f"WITH {WORK} SELECT id, tenant_id, lane, state FROM w WHERE id = '1'")
def work_by_id(spark, d):
    return queue.decoded(queue.work_by_id(p.work(spark, d), "1")).select("id", "tenant_id", "lane", "state")


@query(f"WITH {WORK} SELECT tenant_id, max_concurrent_tasks, suspended FROM budgets WHERE tenant_id = '7'")
def budget_of(spark, d):
    return queue.budget(p.budgets(spark, d), "7").select("tenant_id", "max_concurrent_tasks", "suspended")


@query(f"WITH {WORK} SELECT id AS work_id, tenant_id, 'requeue' AS event FROM w WHERE state = 'admitted' AND workflow_id IS NULL AND admitted_at < {AS_OF} - INTERVAL {STALL_DAYS} DAY")
def requeue_events(spark, d):
    rows = queue.stalled(p.work(spark, d), p.as_of(), STALL_DAYS * 86_400)
    return commands.requeue(rows, 10**9, p.as_of()).select("work_id", "tenant_id", "event")


@query(f"""WITH {WORK}, a AS (SELECT CAST(seq + 1 AS VARCHAR) AS work_id FROM w WHERE seq % 3 = 0)
  SELECT work_id, CASE WHEN state IS NULL THEN 'not_found' WHEN state IN ('done', 'failed', 'canceled') THEN state ELSE 'canceled' END AS outcome FROM a LEFT JOIN w ON w.id = work_id""")
def cancel_answers(spark, d):
    work = p.work(spark, d)
    asked = work.where("seq % 3 = 0").select((F.col("seq") + 1).cast("string").alias("work_id"), (F.col("seq") * 10 + 9).alias("seq"))
    return commands.cancel(work.withColumnRenamed("id", "work_id"), asked, p.as_of())[1]


@query(f"""WITH {WORK}, a AS (SELECT CAST(seq + 1 AS VARCHAR) AS work_id, seq * 10 + 9 AS seq, CASE WHEN seq % 4 = 0 THEN 'done' WHEN seq % 4 = 1 THEN 'failed' ELSE 'lost' END AS ended FROM w WHERE seq % 3 = 0)
  SELECT work_id, a.seq, CASE WHEN state IS NULL THEN 'not_found' WHEN ended = 'lost' THEN 'bad_request' WHEN state IN ('done', 'failed', 'canceled') THEN state ELSE ended END AS outcome FROM a LEFT JOIN w ON w.id = work_id""")
def finish_answers(spark, d):
    work = p.work(spark, d)
    ended = F.when(F.col("seq") % 4 == 0, "done").when(F.col("seq") % 4 == 1, "failed").otherwise("lost")
    asked = work.where("seq % 3 = 0").select((F.col("seq") + 1).cast("string").alias("work_id"), (F.col("seq") * 10 + 9).alias("seq"), ended.alias("state"), F.lit(1.0).alias("cpu_seconds"), F.lit(10).alias("bytes_written"), F.lit("m").alias("machine"))
    return commands.finish(work.withColumnRenamed("id", "work_id"), asked, p.as_of())[2]


@query("""SELECT event_id, CAST(round(greatest(event_id % 700 - 5, 0) * CAST(0.001 AS DOUBLE) * 1000) AS BIGINT) AS key_ms, CASE WHEN event_id % 700 < 100 THEN 'before' WHEN event_id % 700 >= 300 THEN 'after' ELSE 'inside' END AS place,
  CAST(-(event_id % 5 - 2) * 90 AS INTEGER) % 360 AS rotation, CASE WHEN event_id % 3 <> 0 THEN 'lang' || event_id % 3 END AS language, (event_id % 7) || '/' || (event_id % 4) AS rate, CASE WHEN event_id % 4 = 0 THEN 0.0 ELSE (event_id % 7) / CAST(event_id % 4 AS DOUBLE) END AS fps,
  ['h264', 'h265', 'av1'][event_id % 3 + 1] AS codec, event_id % 2 = 1 OR event_id % 5 = 0 AS mezzanine, 't/sources/' || user_id AS source_key FROM events""")
def media_scalars(spark, d):
    e = F.col("event_id")
    name = F.element_at(F.array(F.lit("AVC"), F.lit("Libx265"), F.lit("av1")), (e % 3 + 1).cast("int"))
    warned = F.when(e % 5 == 0, F.array(F.lit("interlaced"))).otherwise(F.array(F.lit("no_audio")))
    return p.table(spark, d, "events").select(
        "event_id", media.keyframe_ms(e % 700 - 5, F.lit(0.001)).alias("key_ms"), media.place_in_range(e % 700, F.lit(100), F.lit(300)).alias("place"), media.rotation_of((e % 5 - 2) * 90).alias("rotation"),
        media.published_language(F.when(e % 3 == 0, "und").otherwise(F.concat(F.lit("lang"), (e % 3).cast("string")))).alias("language"), media.rate_text(e % 7, e % 4).alias("rate"), media.rate(e % 7, e % 4).alias("fps"),
        media.codec_of(name).alias("codec"), media.needs_mezzanine(e % 2 + 1, warned).alias("mezzanine"), media.source_key(F.lit("t"), F.col("user_id").cast("string")).alias("source_key"),
    )


@query()
def admission_ticks(spark, d):
    """Three ticks over the whole queue; one tick is checked in SQL by claim_topn."""
    limits = p.budgets(spark, d).withColumns({"max_concurrent_tasks": F.col("max_concurrent_tasks") * 4, "rate_limit_per_min": F.col("rate_limit_per_min") * 4})
    config = tick.Config(total_slots=SLOTS, rate_window=RECENT, stall_seconds=STALL_DAYS * 86_400)
    work, _ = tick.run(cut(p.work(spark, d)), limits, p.as_of(), 3, config, cut)
    return work.groupBy("lane", "tenant_id", "state").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"))


@query("""WITH m AS (SELECT CAST(floor(l_extendedprice) AS BIGINT) % 50 AS dur, l_linenumber % 4 AS st, l_suppkey % 4 AS rot, l_partkey AS k, l_linenumber % 3 AS nv, l_suppkey % 2 AS na FROM lineitem),
  x AS (SELECT array_to_string(list_filter([
    CASE WHEN nv > 0 AND k % 7 = 0 THEN 'variable_frame_rate' END, CASE WHEN nv > 0 AND rot > 0 THEN 'rotation_metadata' END, CASE WHEN nv > 0 AND k % 9 = 0 THEN 'non_monotonic_timestamps' END,
    CASE WHEN nv > 0 AND st > 0 THEN 'start_time_offset' END, CASE WHEN nv > 0 AND k % 8 = 0 THEN 'no_keyframe_index' END, CASE WHEN nv > 0 AND k % 8 = 1 THEN 'sparse_keyframes' END, CASE WHEN dur = 0 THEN 'unknown_duration' END,
    CASE WHEN nv > 1 THEN 'multiple_video_streams' END, CASE WHEN na = 0 THEN 'no_audio' END, CASE WHEN nv > 0 AND k % 6 = 0 THEN 'non_square_pixels' END, CASE WHEN nv > 0 AND k % 10 < 2 THEN 'hdr_transfer' END], lambda w: w IS NOT NULL), ',') AS warnings,
    nv > 0 AND (k % 7 = 0 OR rot > 0 OR k % 9 = 0 OR st > 0 OR k % 6 = 0) AS normalise FROM m)
  SELECT warnings, normalise, count(*) AS n FROM x GROUP BY ALL""")
def probe_warnings(spark, d):
    k = F.col("l_partkey")
    pick = lambda n, when, other, *more: F.when(k % n == 0, when).otherwise(other if not more else F.when(k % n == 1, more[0]).otherwise(other))
    longs = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    m = F.struct(
        (F.floor("l_extendedprice") % 50).alias("duration_ms"), (F.col("l_linenumber") % 4).alias("start_time"), (F.col("l_suppkey") % 4 * 90).alias("rotation"), pick(6, 4, 1).alias("sar_num"), pick(6, 3, 1).alias("sar_den"),
        F.lit(30).alias("avg_num"), F.lit(1).alias("avg_den"), pick(7, 25, 30).alias("real_num"), F.lit(1).alias("real_den"), pick(10, "smpte2084", "bt709", "arib-std-b67").alias("transfer"),
        (F.col("l_linenumber") % 3).alias("n_video"), (F.col("l_suppkey") % 2).alias("n_audio"), pick(8, F.array().cast("array<bigint>"), longs(0, 10_000), longs(0, 20_000)).alias("keyframes"), pick(9, longs(1, None, 0), longs(0, None, 2)).alias("dts"),
    )
    rows = p.table(spark, d, "lineitem").select(media.warnings_of(m).alias("w"))
    return rows.groupBy(F.array_join("w", ",").alias("warnings"), media.needs_normalising(F.col("w")).alias("normalise")).agg(F.count(F.lit(1)).alias("n"))


@query("""WITH s AS (SELECT p_partkey AS source, p_size % 2 = 1 AS h265, p_partkey % 3 <> 0 AS crf, p_size AS g, p_partkey AS b FROM part)
  SELECT source, array_to_string(list_sort(list_filter(['preset=medium', CASE WHEN crf THEN 'crf=23' END, CASE WHEN crf AND h265 THEN 'x265-params=vbv-maxrate=' || b || ':vbv-bufsize=' || 2 * b || ':keyint=' || g || ':min-keyint=' || g || ':scenecut=0:open-gop=0' END,
    CASE WHEN crf AND NOT h265 THEN 'maxrate=' || b * 1000 END, CASE WHEN crf AND NOT h265 THEN 'bufsize=' || b * 2000 END, CASE WHEN NOT crf THEN 'b=' || b END, CASE WHEN NOT h265 THEN 'keyint_min=' || g END,
    CASE WHEN NOT h265 THEN 'sc_threshold=0' END, CASE WHEN NOT h265 THEN 'x264-params=open-gop=0:scenecut=0' END, 'tune=film'], lambda x: x IS NOT NULL)), ';') AS options FROM s""")
def encoder_options(spark, d):
    k = F.col("p_partkey")
    spec = F.struct(
        F.when(F.col("p_size") % 2 == 1, "h265").otherwise("h264").alias("codec"), F.lit("medium").alias("preset"), F.when(k % 3 != 0, "crf").otherwise("cbr").alias("mode"), F.lit(23).alias("crf"),
        (k * 1000).alias("max_bitrate"), (k * 2000).alias("buffer_size"), k.alias("bitrate"), F.col("p_size").alias("gop_frames"), F.create_map(F.lit("tune"), F.lit("film")).alias("extra"),
    )
    entries = F.transform(F.map_entries(media.encoder_options(spec)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return p.table(spark, d, "part").select(k.alias("source"), F.array_join(F.array_sort(entries), ";").alias("options"))


@query(f"""WITH {SCORES}, f AS (SELECT 'part' || p_partkey AS file, p_partkey AS b FROM part), e AS (SELECT file, CASE WHEN b % 4 = 0 THEN 'unreadable' WHEN b % 5 = 0 THEN 'no video' END AS finding FROM f)
  SELECT e.file, finding, rung, coalesce(scored, false) AS scored FROM e LEFT JOIN (SELECT DISTINCT file, rung, true AS scored FROM po) s ON s.file = e.file AND finding IS NULL""")
def report_build(spark, d):
    files = p.table(spark, d, "part").select(F.concat(F.lit("part"), F.col("p_partkey").cast("string")).alias("file"), F.col("p_partkey").alias("b"))
    scores = _pooled(spark, d).withColumn("value", F.col("mean"))
    return reports.build(files.select("file"), files.where("b % 4 <> 0").select("file", (F.col("b") % 5).alias("n_video")), scores)


@query(f"""WITH {CHUNKS}, {STEPS}, c AS (SELECT source, count(*) AS chunks FROM chunks GROUP BY source), r AS (SELECT source, count(*) AS rungs, max(CASE WHEN pos = mid THEN rung END) AS fast_rung
    FROM (SELECT *, count(*) OVER (PARTITION BY source) // 2 AS mid FROM sized) GROUP BY source)
  SELECT c.source, chunks, rungs, fast_rung, chunks * rungs AS jobs, 'asset:' || c.source AS dedupe_key FROM c JOIN r ON r.source = c.source""")
def asset_plan(spark, d):
    return plan.asset_plan(p.ladder_sources(spark, d), _chunks(spark, d)).drop("whole")


@query(f"""WITH {STEPS} SELECT source AS asset, rung AS name, CAST(row_number() OVER (PARTITION BY source ORDER BY width * height DESC, rung) AS INTEGER) AS place,
  't' || source % 7 || '/assets/' || source || '/' || rung || '/' AS prefix FROM sized""")
def renditions_by_area(spark, d):
    rows = plan.ladder_plan(p.ladder_sources(spark, d)).select(F.col("source").alias("asset"), F.col("rung").alias("name"), "width", "height")
    tenant = F.concat(F.lit("t"), (F.col("asset") % 7).cast("string"))
    return plan.by_area(rows).select("asset", "name", F.col("pos").alias("place"), media.rendition_prefix(tenant, F.col("asset").cast("string"), F.col("name")).alias("prefix"))


@query(f"""WITH {WORK}, v AS (SELECT seq, id, tenant_id, dedupe_key, seq % 5 AS verb FROM w), sub AS (SELECT *, row_number() OVER (PARTITION BY v.tenant_id, dedupe_key ORDER BY seq) AS place FROM v WHERE verb = 0 AND seq % 35 <> 0 AND seq % 25 <> 0),
  o AS (SELECT seq, CASE WHEN suspended IS NULL THEN 'no_budget' WHEN suspended THEN 'suspended' WHEN place = 1 THEN 'created' ELSE 'existing' END AS outcome FROM sub LEFT JOIN budgets b ON b.tenant_id = sub.tenant_id AND b.tenant_id <> '3'
    UNION ALL SELECT seq, 'bad_request' FROM v WHERE verb = 0 AND (seq % 35 = 0 OR seq % 25 = 0)
    UNION ALL SELECT v.seq, CASE WHEN verb = 2 AND v.seq % 3 = 0 THEN 'bad_request' WHEN w.id IS NULL THEN 'not_found' ELSE 'found' END FROM v LEFT JOIN w ON w.seq = v.seq + 1 WHERE verb IN (1, 2, 4)
    UNION ALL SELECT seq, CASE WHEN seq % 4 = 0 THEN 'bad_request' ELSE 'stored' END FROM v WHERE verb = 3)
  SELECT seq, outcome, CASE outcome WHEN 'created' THEN 201 WHEN 'existing' THEN 200 WHEN 'found' THEN 200 WHEN 'stored' THEN 204 WHEN 'not_found' THEN 404 WHEN 'no_budget' THEN 422 WHEN 'suspended' THEN 403 ELSE 400 END AS status FROM o""")
def request_statuses(spark, d):
    work, k = p.work(spark, d), F.col("seq")
    verb = F.element_at(F.array(*map(F.lit, ("submit", "get", "finish", "budget", "cancel"))), (k % 5 + 1).cast("int"))
    body = F.to_json(F.struct(
        "tenant_id", "dedupe_key", F.when(k % 25 == 0, "slow").otherwise(F.col("lane")).alias("lane"), F.when(k % 3 == 0, "lost").otherwise("done").alias("state"),
        F.when(k % 4 == 0, -1).otherwise(5).alias("max_concurrent_tasks"), F.lit(7).alias("rate_limit_per_min"),
    ))
    asked = work.select("seq", verb.alias("verb"), (k + 1).cast("string").alias("target"), F.when(k % 35 == 0, F.substring(body, 1, 20)).otherwise(body).alias("body"))
    return commands.answered(asked, work.select(F.col("id").alias("work_id"), "state"), p.budgets(spark, d).where("tenant_id <> '3'"))


@query(f"""WITH {WORK} SELECT tenant_id, max(seq) AS seq, CAST(max(seq) % 50 AS INTEGER) AS max_concurrent_tasks, CAST(max(seq) % 9 AS INTEGER) AS rate_limit_per_min FROM w GROUP BY tenant_id""")
def budgets_put(spark, d):
    changes = p.work(spark, d).select("tenant_id", "seq", (F.col("seq") % 50).cast("int").alias("max_concurrent_tasks"), (F.col("seq") % 9).cast("int").alias("rate_limit_per_min"))
    return events.latest_wins(commands.set_budgets(changes), ["tenant_id"], "seq")


@query("""SELECT user_id, count(*) AS frames, round(avg(value), 4) AS vmaf, min(value) AS vmaf_min, max(value) AS psnr_max, CASE WHEN user_id % 3 = 0 THEN round(avg(value), 4) END AS cambi FROM events GROUP BY user_id""")
def vmaf_metrics(spark, d):
    stat = F.struct(F.avg("value").alias("mean"), F.min("value").alias("min"), F.max("value").alias("max"))
    rows = p.table(spark, d, "events").groupBy("user_id").agg(stat.alias("s"), F.transform(F.collect_list("event_id"), lambda e: F.struct(e.alias("frameNum"))).alias("frames"))
    pooled = F.struct(F.col("s").alias("vmaf"), F.col("s").alias("psnr_y"), F.when(F.col("user_id") % 3 == 0, F.col("s")).alias("cambi"))
    found = reports.vmaf_metrics(rows.select("user_id", F.to_json(F.struct("frames", pooled.alias("pooled_metrics"))).alias("report")))
    return found.select("user_id", F.col("frames").cast("long").alias("frames"), F.round("vmaf.mean", 4).alias("vmaf"), F.col("vmaf.min").alias("vmaf_min"), F.col("psnr_y.max").alias("psnr_max"), F.round("cambi.mean", 4).alias("cambi"))


@query("SELECT DISTINCT 't' || user_id % 7 AS tenant, 'a' || user_id AS asset, event_type AS rendition FROM events WHERE event_id % 4 <> 0")
def landed_renditions(spark, d):
    tail = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("/other/"), "event_type")).otherwise(F.concat(F.lit("/assets/a"), "user_id", F.lit("/"), "event_type", F.lit("/"), "event_id", F.lit(".mp4")))
    return storage.landed(p.table(spark, d, "events").select(F.concat(F.lit("s3://bucket/t"), F.col("user_id") % 7, tail).alias("path")))


@query("""SELECT event_id, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12) AS id FROM (SELECT event_id, md5('/in/' || event_type || '/' || event_id) AS h FROM events)""")
def path_ids(spark, d):
    return p.table(spark, d, "events").select("event_id", media.path_id(F.concat(F.lit("/in/"), "event_type", F.lit("/"), "event_id")).alias("id"))


@query(f"""WITH {SCORES}, pb AS (SELECT run, brand AS file, rung, metric, avg(value) AS mean, count(*) AS frames FROM sc GROUP BY ALL), f AS (SELECT run, file, CAST(substr(file, 7) AS INTEGER) AS b, sum(frames) AS n FROM pb GROUP BY ALL), g AS (SELECT run, file, rung, CAST(sum(frames) AS BIGINT) AS frames, {', '.join(f"round(max(mean) FILTER (WHERE metric = '{m}'), 4) AS {m}" for m in METRICS)} FROM pb GROUP BY ALL)
  SELECT f.run, 1700000000 AS created_unix, 'n7' AS ffmpeg, 5 AS subsample, dense_rank() OVER (PARTITION BY f.run ORDER BY b, f.file) - 1 AS entry, f.file, CAST(n * 40 AS BIGINT) AS duration_ms, n / 10.0 AS encode_seconds, CASE WHEN b % 2 = 1 THEN 'no_audio' ELSE '' END AS warnings,
    CASE WHEN b % 5 = 0 THEN 'odd size' ELSE '' END AS findings, rung, 1280 AS width, frames, {', '.join(METRICS)} FROM f JOIN g ON g.run = f.run AND g.file = f.file""")
def report_documents(spark, d):
    """Reports put together, written out as JSON text, read again and taken apart."""
    # A report is one row, so its files are the brands, whose number does not grow with the tables.
    pooled = reports.pooled(p.frame_scores(spark, d).drop("file").withColumnRenamed("brand", "file"), ["run", "file", "rung"])
    rungs = pooled.groupBy("run", "file", "rung").agg(F.sum("frames").alias("frames"))
    placed = rungs.select("*", F.col("rung").alias("pos"), F.lit(1280).alias("width"), F.lit(720).alias("height"), (F.col("frames") * 1000).alias("bytes"))
    b = F.substring("file", 7, 10).cast("int")
    files = pooled.groupBy("run", "file").agg(F.sum("frames").alias("n")).select(
        "run", "file", F.struct(b, "file").alias("pos"), (F.col("n") * 40).alias("duration_ms"), (F.col("n") / 10).alias("encode_seconds"),
        F.when(b % 2 == 1, F.array(F.lit("no_audio"))).otherwise(F.array().cast("array<string>")).alias("warnings"), F.when(b % 5 == 0, F.array(F.lit("odd size"))).otherwise(F.array().cast("array<string>")).alias("findings"),
    )
    runs = pooled.select("run").distinct().select("run", F.lit(1_700_000_000).cast("long").alias("created_unix"), F.lit("n7").alias("ffmpeg"), F.lit("slow").alias("preset"), F.lit(5).alias("subsample"))
    whole = reports.assemble(runs, files, placed, pooled.select("run", "file", "rung", "metric", F.col("mean").alias("value")))
    again = whole.select("run", F.from_json(F.to_json("report", {"pretty": "true"}), storage.REPORT).alias("r"))
    rows = again.select("run", "r.created_unix", "r.ffmpeg", "r.subsample", F.posexplode("r.entries").alias("entry", "e"))
    rows = rows.select("*", F.explode("e.rungs").alias("x"))
    listed = lambda c: F.array_join(f"e.{c}", ",").alias(c)
    return rows.select(
        "run", "created_unix", "ffmpeg", "subsample", F.col("entry").cast("long").alias("entry"), "e.file", "e.duration_ms", "e.encode_seconds", listed("warnings"), listed("findings"), F.col("x.name").alias("rung"), "x.width", "x.frames",
        *[F.round(f"x.scores.{m}", 4).alias(m) for m in METRICS],
    )
