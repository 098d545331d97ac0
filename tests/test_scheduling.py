import random

import pytest
from pyspark.sql import functions as F

from verdigris.operators import scheduling as S


def served(sizes, weights):
    """A token scheduler played step by step."""
    left, at, out = dict(sizes), dict.fromkeys(sizes, 0), []
    tokens = dict(weights)
    while any(left.values()):
        for p in sorted(left, reverse=True):
            if left[p] and tokens[p]:
                tokens[p] -= 1
                left[p] -= 1
                out.append((p, at[p]))
                at[p] += 1
                break
        else:
            tokens = dict(weights)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_weighted_round_robin(spark, seed):
    rng = random.Random(seed)
    sizes, weights = {p: rng.randint(0, 40) for p in range(3)}, {p: rng.randint(1, 5) for p in range(3)}
    rows = [(p * 1000 + i, f"2024-01-0{1 + i // 20} 00:00:{i % 20:02d}", p) for p, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "request_id long, ts string, priority int").withColumn("ts", F.to_timestamp("ts"))
    got = [(r.priority, r.lane_rank) for r in S.weighted_round_robin(df, weights).orderBy("dispatch_pos").collect()]
    want, cycle = [], 0
    while len(want) < len(rows):  # whole cycles, high lanes first
        for p in sorted(sizes, reverse=True):
            want += [(p, i) for i in range(cycle * weights[p], min(sizes[p], (cycle + 1) * weights[p]))]
        cycle += 1
    assert got == want
    assert sorted(served(sizes, weights)) == sorted(want)


def test_quantum_order():
    items = [(p, f"{p}-{i}") for p in range(3) for i in range(4)]
    order = S.quantum_order(items, {0: 2, 1: 1, 2: 1})
    assert sorted(order) == sorted(items)
    assert [p for p, _ in order[:4]] == [0, 0, 1, 0]
    assert S.quantum_order([], {}) == []


def test_options_report_every_problem():
    S.PoolOptions()
    with pytest.raises(ValueError) as e:
        S.PoolOptions(max_concurrency=0, capacity=0, weights=(0, 1, 1), full_mode="x")
    assert str(e.value).count(";") == 3
    S.PoolOptions(timeout_s=-1, drain_timeout_s=-1, partition_capacity=1, aging_threshold_s=5, tier_limits=(0, None, 3))
    wrong = {"weights": None, "drain_timeout_s": -2, "timeout_s": 0, "partition_capacity": 0, "idle_eviction_s": -1, "max_attempts": 0, "retry_delay_s": -1, "aging_threshold_s": 0, "aging_scan_s": 0, "tier_limits": (1, 2)}
    for name, value in wrong.items():
        with pytest.raises(ValueError, match=name.replace("tier_limits", "tier limits")):
            S.PoolOptions(**{name: value})
    with pytest.raises(ValueError, match="negative"):
        S.PoolOptions(tier_limits=(1, -2, 1))


def test_conservation(spark):
    rows = [(i, i % 3, float(i), "error" if i % 5 == 0 else "view") for i in range(50)]
    df = spark.createDataFrame(rows, "request_id long, priority int, seconds double, event_type string")
    gone = df.filter("request_id < 7")
    tries = S.attempts(S.cancel(df, gone), F.col("request_id") % 4, 2)
    assert S.conservation(df, tries, gone).first().holds


def test_attempts(spark):
    df = spark.createDataFrame([(0, 0), (1, 1), (2, 5)], "request_id long, f int")
    rows = S.attempts(df, F.col("f"), 3).groupBy("request_id").agg(F.count("*").alias("n"), F.max("dead").alias("dead")).orderBy("request_id").collect()
    assert [(r.n, r.dead) for r in rows] == [(1, False), (2, False), (3, True)]


def test_ranks_in_ranges(spark):
    """Places by range buckets equal a plain sort, with repeated and null keys."""
    from verdigris.functions.ranking import bucketed_rank, range_bucket

    rows = [(i, f"https://one.example/{i * 7919 % 1000}") for i in range(1000)] + [(1000, None), (1001, "https://one.example/5")]
    df = spark.createDataFrame(rows, "id long, path string")
    ranked = bucketed_rank(df, [], range_bucket(df, "path", buckets=9, rows=10), ["path", "id"], "place")
    want = [i for i, _ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0]))]
    assert [r.id for r in ranked.orderBy("place").collect()] == want


def test_worker_pool(spark):
    """Start times against a plain simulation; caps hold, nobody waits while a worker and the cap are free."""
    from verdigris.operators import pool_runs as P

    rng = random.Random(3)
    rows = [(i, f"2024-01-01 00:00:{rng.randrange(60):02d}", rng.randrange(3), rng.choice((1.0, 7.5, 30.0)), rng.choice("ab")) for i in range(200)]
    df = spark.createDataFrame(rows, "request_id long, ts string, priority int, seconds double, run string").withColumn("ts", F.to_timestamp("ts"))
    got = {r.request_id: r for r in P.worker_pool(df, "run", 4, {2: 2}).collect()}
    assert len(got) == 200
    for run in "ab":
        own = sorted((r for r in rows if r[4] == run), key=lambda r: (r[1], r[0]))
        free, ends = [0.0] * 4, []
        base = got[own[0][0]].start_s - int(own[0][1][-2:])
        for i, ts, tier, seconds, _ in own:
            w = min(range(4), key=free.__getitem__)
            start = max(base + int(ts[-2:]), free[w])
            if tier == 2:
                running = sorted(e for e in ends)
                if len(running) >= 2:
                    start = max(start, running[0])
                    ends.remove(running[0])
                ends.append(start + seconds)
            free[w] = start + seconds
            assert abs(got[i].start_s - start) < 1e-6 and abs(got[i].end_s - start - seconds) < 1e-6
        edges = sorted([(got[r[0]].start_s, 1) for r in own if r[2] == 2] + [(got[r[0]].end_s, -1) for r in own if r[2] == 2])
        running = most = 0
        for _, step in sorted(edges):
            running += step
            most = max(most, running)
        assert most <= 2


def test_callbacks_and_phases(spark):
    from verdigris.operators import pool_runs as P

    df = spark.range(6).withColumnRenamed("id", "request_id")
    errors = {r.request_id: r.callback_error for r in P.notify(df, lambda r: 1 // (r["request_id"] % 3)).collect()}
    assert [errors[i] is None for i in range(6)] == [False, True, True] * 2 and errors[0].startswith("ZeroDivisionError")
    steps = P.phase_steps(spark.createDataFrame([(1, "sms"), (2, "other")], "job long, handler string")).orderBy("step").collect()
    assert [(r.percent, r.message) for r in steps] == [(20, "Routing to carrier"), (40, "Sending message (1/2)"), (60, "Sending message (2/2)"), (80, "Awaiting delivery (1/2)"), (100, "Awaiting delivery (2/2)")]


def test_ledger_adds_up(spark):
    from verdigris.operators import pool_runs as P

    rows = [(i, f"2024-01-01 00:{i % 60:02d}:00", float(i % 7) * 100, i % 11 == 0, i % 5 == 0, i % 4 == 0) for i in range(300)]
    df = spark.createDataFrame(rows, "request_id long, ts string, seconds double, full boolean, gone boolean, bad boolean").withColumn("ts", F.to_timestamp("ts"))
    r = P.ledger(df, ~F.col("full"), F.col("gone"), F.col("bad"), F.lit("2024-01-01 00:40:00").cast("timestamp"), 120.0).first()
    assert r.holds and r.enqueued == 205 and all(r[k] > 0 for k in ("completed", "failed", "cancelled", "dropped", "in_flight", "queued"))
