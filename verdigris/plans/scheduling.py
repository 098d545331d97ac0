"""Queries over ``events`` and ``orders`` as request logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from verdigris.operators import pool_runs as P
from verdigris.operators import scheduling as S
from verdigris.session import load

WEIGHTS = {2: 5, 1: 3, 0: 1}


def _reqs(spark, d):
    return S.requests(load(spark, d, "events"))


def _bound(reqs, how):
    """A time of the log as a literal: one row of aggregates."""
    lo, hi = reqs.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    return F.timestamp_micros(F.lit(hi if how == "end" else (lo + hi) // 2))


def sched_wrr_order(spark, d):
    return S.weighted_round_robin(_reqs(spark, d), WEIGHTS)


def sched_wrr_orders_priority(spark, d):
    return S.weighted_round_robin(S.order_requests(load(spark, d, "orders")), WEIGHTS, F.date_trunc("day", F.col("ts").cast("timestamp")))


def sched_fair_order(spark, d):
    return S.fair_order(_reqs(spark, d))


def sched_aging(spark, d):
    r = _reqs(spark, d)
    return S.aged_priority(r, _bound(r, "end"))


def _full(policy):
    return lambda spark, d: S.full_queue(_reqs(spark, d), 200, policy)


def sched_idle_partitions(spark, d):
    return S.idle_evictions(_reqs(spark, d), "6 hours")


def sched_snapshot(spark, d):
    r = _reqs(spark, d)
    return S.snapshot(r.withColumn("seconds", F.col("seconds") * 1000), _bound(r, "middle"))


def sched_health(spark, d):
    return S.health(sched_snapshot(spark, d), {"high": 5, "normal": 20, "low": 50}, {"high": 50, "normal": 100, "low": 500})


def _tries(r):
    return S.attempts(r, F.col("request_id") % 5, 3, F.col("event_type") != "error")


def sched_retry_deadletter(spark, d):
    return S.outcome_counts(_tries(_reqs(spark, d)), ["priority"])


def sched_conservation(spark, d):
    r = _reqs(spark, d)
    gone = r.filter("seconds > 90 AND event_type = 'view'")
    return S.conservation(r, _tries(S.cancel(r, gone)), gone)


def sched_concurrency(spark, d):
    return S.peak_concurrency(_reqs(spark, d).withColumn("seconds", F.col("seconds") * 100))


def sched_validate_ids(spark, d):
    e = load(spark, d, "events")
    own = F.when(F.col("event_type") == "signup", "").when(F.col("event_type") == "error", F.concat(F.lit("bad\t"), F.col("user_id").cast("string"))).when(F.col("event_type") == "purchase", F.repeat(F.lit("x"), F.lit(200) + F.col("user_id").cast("int") % 100)).otherwise(F.concat_ws("-", "event_type", F.col("user_id").cast("string")))
    return S.validate_ids(e.select(own.alias("id")))


def sched_cancel(spark, d):
    r = _reqs(spark, d)
    return S.cancel(r, r.filter("event_type = 'error'")).groupBy("priority").agg(F.count(F.lit(1)).alias("n"))


def sched_timeouts(spark, d):
    own = F.when(F.col("event_type") == "view", F.lit(-1.0)).when(F.col("event_type") == "click", F.lit(20.0))
    return S.timed_out(_reqs(spark, d), 50.0, own).groupBy("event_type").agg(F.count_if("timed_out").alias("n_timed_out"), F.count(F.lit(1)).alias("n"))


def sched_duration_stats(spark, d):
    return S.duration_stats(_reqs(spark, d), ["priority"])


def sched_mediator_routes(spark, d):
    handlers = {"click": F.concat(F.lit("c"), F.col("request_id")), "purchase": F.format_string("%.1f", "seconds"), "signup": F.col("partition_key")}
    r = S.route(_reqs(spark, d), handlers)
    return r.groupBy("event_type", "error").agg(F.count("output").alias("n_handled"), F.count(F.lit(1)).alias("n"), F.min("output").alias("least_output"))


def sched_quantum_order(spark, d):
    r = _reqs(spark, d).withColumn("run", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd HH"))
    return S.quantum_schedule(r, "run", {0: 2, 1: 1, 2: 1})


def sched_wait_for_room(spark, d):
    return P.wait_for_room(_reqs(spark, d), 200)


def sched_retry_queue(spark, d):
    return P.retry_queue(_tries(_reqs(spark, d)), 30.0)


def sched_cancel_lanes(spark, d):
    r = P.cancel_lanes(_reqs(spark, d), [0, 2]).groupBy("priority").agg(F.count_if("cancelled").alias("cancelled"), F.count_if(~F.col("cancelled")).alias("left_over"))
    return r


def sched_ledger(spark, d):
    r = _reqs(spark, d)
    kept = S.full_queue(r, 300, "drop_write").select("request_id", "kept")
    return P.ledger(r.join(kept, "request_id"), F.col("kept"), F.col("event_type") == "signup", F.col("event_type") == "error", _bound(r, "middle"), 3600.0)


def sched_worker_pool(spark, d):
    r = _reqs(spark, d).withColumn("day", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd")).withColumn("seconds", F.col("seconds") * 60)
    return P.worker_pool(r, "day", 3, {2: 1})


def sched_callbacks(spark, d):
    def callback(row: dict) -> None:
        if row["event_type"] == "error":
            raise ValueError("bad callback")

    called = P.notify(_reqs(spark, d).select("request_id", "event_type"), callback)
    return called.groupBy("callback_error").agg(F.count(F.lit(1)).alias("n"))


def sched_meters(spark, d):
    r = _reqs(spark, d)
    gone = r.filter("event_type = 'signup'")
    return P.meters(r, _tries(r), S.full_queue(r, 200, "drop_oldest"), S.aged_priority(r, _bound(r, "end")), S.idle_evictions(r, "6 hours"), gone, sched_snapshot(spark, d), sched_concurrency(spark, d))


QUERIES = {
    f.__name__: f
    for f in (
        sched_wrr_order, sched_wrr_orders_priority, sched_fair_order, sched_aging, sched_idle_partitions, sched_snapshot, sched_health, sched_retry_deadletter, sched_conservation, sched_concurrency,
        sched_validate_ids, sched_cancel, sched_timeouts, sched_duration_stats, sched_mediator_routes, sched_quantum_order,
        sched_wait_for_room, sched_retry_queue, sched_cancel_lanes, sched_ledger, sched_worker_pool, sched_callbacks, sched_meters,
    )
}
for _p in ("drop_oldest", "drop_newest", "drop_write"):
    QUERIES[f"sched_{_p}"] = _full(_p)

R = """WITH r AS (SELECT event_id AS request_id, ts, CASE WHEN event_type IN ('purchase', 'error') THEN 2 WHEN event_type IN ('click', 'signup') THEN 1 ELSE 0 END AS priority,
  coalesce(CAST(user_id AS VARCHAR), '__default') AS partition_key, value AS seconds, event_type FROM events)"""
_WRR = """, w(priority, weight) AS (VALUES (2, 5), (1, 3), (0, 1)),
k AS (SELECT request_id, priority, row_number() OVER (PARTITION BY priority ORDER BY ts, request_id) - 1 AS lane_rank FROM r)
SELECT request_id, priority, lane_rank, lane_rank // weight AS cycle, row_number() OVER (ORDER BY lane_rank // weight, priority DESC, lane_rank) - 1 AS dispatch_pos FROM k JOIN w USING (priority)"""
_SNAP = """, t AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS t0 FROM r), x AS (SELECT priority, epoch_us(ts) <= t0 AS came, epoch_us(ts) <= t0 AND epoch_us(ts) + CAST(round(seconds * 1000 * 1000000) AS BIGINT) > t0 AS waiting FROM r, t),
s AS (SELECT count(*) FILTER (waiting AND priority = 2) AS high, count(*) FILTER (waiting AND priority = 1) AS normal, count(*) FILTER (waiting AND priority = 0) AS low, count(*) FILTER (waiting) AS total, count(*) FILTER (came) AS enqueued FROM x)"""
_TRY = """, l AS (SELECT *, request_id % 5 AS f, CASE WHEN event_type <> 'error' THEN 3 ELSE 1 END AS most FROM {}), a AS (SELECT priority, f, most, unnest(range(1, least(most, f + 1) + 1)) AS attempt FROM l)"""
_FULL = """, k AS (SELECT request_id, priority, row_number() OVER (PARTITION BY priority ORDER BY ts, request_id) AS a, count(*) OVER (PARTITION BY priority) AS n FROM r) SELECT request_id, priority, {} AS kept FROM k"""
ORACLE_SQL = {
    "sched_wrr_order": R + _WRR,
    "sched_wrr_orders_priority": "WITH r AS (SELECT o_orderkey AS request_id, o_orderdate AS ts, CASE WHEN o_orderpriority[1] <= '2' THEN 2 WHEN o_orderpriority[1] = '3' THEN 1 ELSE 0 END AS priority FROM orders)" + _WRR,
    "sched_fair_order": R + """, k AS (SELECT *, row_number() OVER (PARTITION BY priority, partition_key ORDER BY ts, request_id) - 1 AS partition_rank FROM r)
SELECT request_id, priority, partition_key, partition_rank, row_number() OVER (PARTITION BY priority ORDER BY partition_rank, partition_key) - 1 AS fair_pos FROM k""",
    "sched_aging": R + """, t AS (SELECT max(epoch_us(ts)) AS t0 FROM r)
SELECT request_id, priority, CAST(least(2, priority + greatest(0, CAST(floor((t0 - epoch_us(ts) - 3600000000) / 600000000.0) AS BIGINT) + 1)) AS INT) AS aged_priority FROM r, t""",
    "sched_idle_partitions": R + """, g AS (SELECT partition_key, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY partition_key ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS opens FROM r)
SELECT partition_key, CAST(sum(opens) AS BIGINT) AS sessions, CAST(sum(opens) - 1 AS BIGINT) AS evictions, count(*) AS requests FROM g GROUP BY 1""",
    "sched_snapshot": R + _SNAP + " SELECT * FROM s",
    "sched_health": R + _SNAP + " SELECT *, CASE WHEN high >= 50 OR normal >= 100 OR low >= 500 THEN 'Unhealthy' WHEN high >= 5 OR normal >= 20 OR low >= 50 THEN 'Degraded' ELSE 'Healthy' END AS status FROM s",
    "sched_retry_deadletter": R + _TRY.format("r") + " SELECT priority, count(*) FILTER (attempt > f) AS completed, count(*) FILTER (attempt <= f AND attempt = most) AS dead_lettered, count(*) FILTER (attempt <= f AND attempt < most) AS retried, count(*) AS attempts FROM a GROUP BY 1",
    "sched_conservation": R + ", q AS (SELECT * FROM r WHERE NOT (seconds > 90 AND event_type = 'view'))" + _TRY.format("q") + """, c AS (SELECT (SELECT count(*) FROM r) AS enqueued, count(*) FILTER (attempt > f) AS completed, count(*) FILTER (attempt <= f AND attempt = most) AS failed, (SELECT count(*) FROM r WHERE seconds > 90 AND event_type = 'view') AS cancelled FROM a)
SELECT *, enqueued = completed + failed + cancelled AS holds FROM c""",
    "sched_concurrency": R + """, e AS (SELECT priority, epoch_us(ts) AS t, 1 AS step FROM r UNION ALL SELECT priority, epoch_us(ts) + CAST(round(seconds * 100 * 1000000) AS BIGINT), -1 FROM r),
s AS (SELECT priority, sum(step) OVER (PARTITION BY priority ORDER BY t, step ROWS UNBOUNDED PRECEDING) AS running FROM e) SELECT priority, CAST(max(running) AS BIGINT) AS peak FROM s GROUP BY 1""",
    "sched_validate_ids": """WITH i AS (SELECT CASE WHEN event_type = 'signup' THEN '' WHEN event_type = 'error' THEN 'bad' || chr(9) || user_id WHEN event_type = 'purchase' THEN repeat('x', CAST(200 + user_id % 100 AS INT)) ELSE event_type || '-' || user_id END AS id FROM events),
s AS (SELECT CASE WHEN length(id) = 0 THEN 'empty' WHEN length(id) > 256 THEN 'too long' WHEN regexp_matches(id, '[\\x00-\\x1F]') THEN 'control character' WHEN row_number() OVER (PARTITION BY id) > 1 THEN 'duplicate' ELSE 'accepted' END AS status FROM i) SELECT status, count(*) AS n FROM s GROUP BY 1""",
    "sched_cancel": R + " SELECT priority, count(*) AS n FROM r WHERE request_id NOT IN (SELECT request_id FROM r WHERE event_type = 'error') GROUP BY 1",
    "sched_timeouts": R + " SELECT event_type, count(*) FILTER (CASE event_type WHEN 'view' THEN false WHEN 'click' THEN seconds > 20 ELSE seconds > 50 END) AS n_timed_out, count(*) AS n FROM r GROUP BY 1",
    "sched_duration_stats": R + " SELECT priority, count(*) AS n, round(sum(seconds), 3) AS total, round(avg(seconds), 6) AS mean, min(seconds) AS least, max(seconds) AS most, count(*) FILTER (seconds < 10) AS under_10, count(*) FILTER (seconds >= 10 AND seconds < 100) AS from_10, count(*) FILTER (seconds >= 100) AS from_100 FROM r GROUP BY 1",
    "sched_mediator_routes": R + """, o AS (SELECT event_type, CASE event_type WHEN 'click' THEN 'c' || request_id WHEN 'purchase' THEN printf('%.1f', seconds) WHEN 'signup' THEN partition_key END AS output, CASE WHEN event_type NOT IN ('click', 'purchase', 'signup') THEN 'no handler: ' || event_type END AS error FROM r)
SELECT event_type, error, count(output) AS n_handled, count(*) AS n, min(output) AS least_output FROM o GROUP BY 1, 2""",
    "sched_drop_oldest": R + _FULL.format("n - a < 200"),
    "sched_drop_newest": R + _FULL.format("a < 200 OR a = n"),
    "sched_drop_write": R + _FULL.format("a <= 200"),
    "sched_wait_for_room": R + """, k AS (SELECT request_id, priority, row_number() OVER (PARTITION BY priority ORDER BY ts, request_id) - 1 AS arrival FROM r)
SELECT request_id, priority, arrival, arrival >= 200 AS waited, greatest(0, arrival - 199) AS admitted_after FROM k""",
    "sched_retry_queue": R + """, l AS (SELECT *, request_id % 5 AS f, CASE WHEN event_type <> 'error' THEN 3 ELSE 1 END AS most FROM r), a AS (SELECT request_id, priority, CAST(ts AS TIMESTAMP) AS ts, unnest(range(1, least(most, f + 1) + 1)) AS attempt FROM l),
t AS (SELECT request_id, priority, attempt, ts + (attempt - 1) * INTERVAL 30 SECOND AS ready FROM a) SELECT request_id, priority, attempt, ready, row_number() OVER (PARTITION BY priority ORDER BY ready, attempt, request_id) - 1 AS lane_pos FROM t""",
    "sched_cancel_lanes": R + " SELECT priority, count(*) FILTER (priority IN (0, 2)) AS cancelled, count(*) FILTER (priority = 1) AS left_over FROM r GROUP BY 1",
    "sched_ledger": R + """, t AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS t0 FROM r), k AS (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY ts, request_id) <= 300 AS kept, epoch_us(ts) + 3600000000 AS s FROM r),
x AS (SELECT CASE WHEN NOT kept THEN 'd' WHEN event_type = 'signup' THEN 'c' WHEN s > t0 THEN 'q' WHEN s + CAST(round(seconds * 1000000) AS BIGINT) > t0 THEN 'i' WHEN event_type = 'error' THEN 'f' ELSE 'o' END AS st FROM k, t WHERE epoch_us(ts) <= t0)
SELECT count(*) AS enqueued, count(*) FILTER (st = 'o') AS completed, count(*) FILTER (st = 'f') AS failed, count(*) FILTER (st = 'c') AS cancelled, count(*) FILTER (st = 'd') AS dropped, count(*) FILTER (st = 'i') AS in_flight, count(*) FILTER (st = 'q') AS queued, true AS holds FROM x""",
    "sched_callbacks": "SELECT CASE WHEN event_type = 'error' THEN 'ValueError: bad callback' END AS callback_error, count(*) AS n FROM events GROUP BY 1",
    "sched_meters": R + """, l AS (SELECT *, request_id % 5 AS f, CASE WHEN event_type <> 'error' THEN 3 ELSE 1 END AS most FROM r), a AS (SELECT priority, f, most, unnest(range(1, least(most, f + 1) + 1)) AS attempt FROM l),
z AS (SELECT (min(epoch_us(ts)) + max(epoch_us(ts))) // 2 AS t0, max(epoch_us(ts)) AS t1 FROM r),
e AS (SELECT priority, epoch_us(ts) AS t, 1 AS step FROM r UNION ALL SELECT priority, epoch_us(ts) + CAST(round(seconds * 100 * 1000000) AS BIGINT), -1 FROM r),
pk AS (SELECT priority, max(running) AS peak FROM (SELECT priority, sum(step) OVER (PARTITION BY priority ORDER BY t, step ROWS UNBOUNDED PRECEDING) AS running FROM e) GROUP BY 1),
g AS (SELECT partition_key, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY partition_key ORDER BY ts) < 21600000000 THEN 0 ELSE 1 END AS opens FROM r)
SELECT 'enqueued' AS name, priority::VARCHAR AS tag, count(*)::DOUBLE AS value FROM r GROUP BY 2
UNION ALL SELECT 'completed', CASE WHEN attempt <= f THEN 'failed' ELSE 'succeeded' END, count(*)::DOUBLE FROM a WHERE attempt > f OR attempt = most GROUP BY 2
UNION ALL SELECT 'duration_count', NULL, count(*)::DOUBLE FROM r
UNION ALL SELECT 'duration_sum', NULL, round(sum(seconds), 3)::DOUBLE FROM r
UNION ALL SELECT 'active_workers_peak', NULL, sum(peak)::DOUBLE FROM pk
UNION ALL SELECT 'cancelled', priority::VARCHAR, count(*)::DOUBLE FROM r WHERE event_type = 'signup' GROUP BY 2
UNION ALL SELECT 'retry', priority::VARCHAR, count(*)::DOUBLE FROM a WHERE attempt <= f AND attempt < most GROUP BY 2
UNION ALL SELECT 'dead_letter', priority::VARCHAR, count(*)::DOUBLE FROM a WHERE attempt <= f AND attempt = most GROUP BY 2
UNION ALL SELECT 'dropped', priority::VARCHAR, count(*)::DOUBLE FROM (SELECT priority, row_number() OVER (PARTITION BY priority ORDER BY ts DESC, request_id DESC) AS back FROM r) WHERE back > 200 GROUP BY 2
UNION ALL SELECT 'priority_promoted', priority::VARCHAR, (count(*) FILTER (least(2, priority + greatest(0, CAST(floor((t1 - epoch_us(ts) - 3600000000) / 600000000.0) AS BIGINT) + 1)) > priority))::DOUBLE FROM r, z GROUP BY 2
UNION ALL SELECT 'partition_evicted', NULL, (sum(opens) - count(DISTINCT partition_key))::DOUBLE FROM g
UNION ALL SELECT 'partitions_active', priority::VARCHAR, count(DISTINCT partition_key)::DOUBLE FROM r GROUP BY 2
UNION ALL SELECT 'queue_depth', NULL, (count(*) FILTER (epoch_us(ts) <= t0 AND epoch_us(ts) + CAST(round(seconds * 1000 * 1000000) AS BIGINT) > t0))::DOUBLE FROM r, z""",
}
