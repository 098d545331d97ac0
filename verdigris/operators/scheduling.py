"""Request-pool analytics: the order in which queued requests are served, what is dropped, retried or unhealthy.

Requests are rows ``request_id, ts, priority (0 low, 1 normal, 2 high), partition_key, seconds``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.ranking import bucketed_rank, bucketed_sum



def hour() -> Column:
    return F.date_trunc("hour", F.col("ts").cast("timestamp"))


def priority_of(event_type: Column) -> Column:
    return F.when(event_type.isin("purchase", "error"), 2).when(event_type.isin("click", "signup"), 1).otherwise(0)


def requests(events: DataFrame) -> DataFrame:
    return events.select(F.col("event_id").alias("request_id"), "ts", priority_of(F.col("event_type")).alias("priority"), F.coalesce(F.col("user_id").cast("string"), F.lit("__default")).alias("partition_key"), F.col("value").alias("seconds"), "event_type")


def order_requests(orders: DataFrame) -> DataFrame:
    tier = F.substring("o_orderpriority", 1, 1).cast("int")
    return orders.select(F.col("o_orderkey").alias("request_id"), F.col("o_orderdate").alias("ts"), F.when(tier <= 2, 2).when(tier == 3, 1).otherwise(0).alias("priority"))


def weighted_round_robin(reqs: DataFrame, weights: dict[int, int] | None = None, bucket: Column | None = None) -> DataFrame:
    """``lane_rank, cycle, dispatch_pos`` of a static backlog served by one worker.

    A cycle serves up to its weight from each lane, high lanes first. The place of a request follows from its rank
    in the lane and the lanes' lengths alone, so there is no global sort.
    """
    weights = weights or {2: 5, 1: 3, 0: 1}
    ranked = bucketed_rank(reqs.select("request_id", "ts", "priority"), ["priority"], hour() if bucket is None else bucket, ["ts", "request_id"], "lane_rank")
    sizes = {r["priority"]: r["n"] for r in reqs.groupBy("priority").agg(F.count(F.lit(1)).alias("n")).collect()}
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])[F.col("priority")]
    cycle = F.floor(F.col("lane_rank") / weight).cast("long")
    pos = F.col("lane_rank") - F.col("cycle") * weight
    for p, w in weights.items():
        n = sizes.get(p, 0)
        before = F.least(F.lit(n), F.col("cycle") * w)
        pos = pos + before + F.when(F.lit(p) > F.col("priority"), F.greatest(F.lit(0), F.least(F.lit(w), F.lit(n) - F.col("cycle") * w))).otherwise(0)
    return ranked.withColumn("cycle", cycle).withColumn("dispatch_pos", pos.cast("long")).select("request_id", "priority", "lane_rank", "cycle", "dispatch_pos")


def fair_order(reqs: DataFrame, bucket: Column | None = None) -> DataFrame:
    """Partitions of a lane take turns: ``partition_rank`` in the partition, ``fair_pos`` in the lane.

    A partition with a large share of all requests is ranked in many tasks, by ``bucket`` of its time.
    """
    own = reqs.select("request_id", "ts", "priority", "partition_key")
    r = bucketed_rank(own, ["priority", "partition_key"], hour() if bucket is None else bucket, ["ts", "request_id"], "partition_rank")
    return bucketed_rank(r, ["priority"], F.col("partition_rank"), ["partition_key"], "fair_pos").select("request_id", "priority", "partition_key", "partition_rank", "fair_pos")


def aged_priority(reqs: DataFrame, now: Column, threshold_s: int = 3600, scan_s: int = 600) -> DataFrame:
    """One tier up for each scan (at now, now - scan, ...) that finds the request waiting ``threshold_s`` or longer; at most 2."""
    waited = F.unix_micros(now) - F.unix_micros(F.col("ts").cast("timestamp"))
    scans = F.greatest(F.lit(0), F.floor((waited - threshold_s * 1_000_000) / (scan_s * 1_000_000)) + 1)
    return reqs.select("request_id", "priority", F.least(F.lit(2), F.col("priority") + scans).cast("int").alias("aged_priority"))


def full_queue(reqs: DataFrame, capacity: int, policy: str, bucket: Column | None = None) -> DataFrame:
    """Requests of a burst that a bounded lane keeps. drop_oldest: the last; drop_write: the first; drop_newest: the first
    and, in the last place, the newest arrival."""
    ranked = bucketed_rank(reqs.select("request_id", "ts", "priority"), ["priority"], hour() if bucket is None else bucket, ["ts", "request_id"], "arrival")
    sizes = reqs.groupBy("priority").agg(F.count(F.lit(1)).alias("n"))
    r = ranked.join(F.broadcast(sizes), "priority")  # one row for each tier
    last = F.col("n") - F.col("arrival")
    kept = {"drop_oldest": last <= capacity, "drop_write": F.col("arrival") < capacity, "drop_newest": (F.col("arrival") < capacity - 1) | (last == 1)}[policy]
    return r.select("request_id", "priority", kept.alias("kept"))


def idle_evictions(reqs: DataFrame, idle: str = "5 minutes") -> DataFrame:
    """Sessions of each partition key; between two of them the idle partition was evicted."""
    s = reqs.groupBy("partition_key", F.session_window(F.col("ts").cast("timestamp"), idle)).agg(F.count(F.lit(1)).alias("n"))
    return s.groupBy("partition_key").agg(F.count(F.lit(1)).alias("sessions"), (F.count(F.lit(1)) - 1).alias("evictions"), F.sum("n").alias("requests"))


def snapshot(reqs: DataFrame, at: Column) -> DataFrame:
    """Depth by tier at a time: enqueued by then, not finished (``seconds`` after enqueueing)."""
    t = F.col("ts").cast("timestamp")
    waiting = (t <= at) & (F.unix_micros(t) + F.round(F.col("seconds") * 1_000_000).cast("long") > F.unix_micros(at))
    return reqs.agg(*[F.count_if(waiting & (F.col("priority") == p)).alias(n) for p, n in ((2, "high"), (1, "normal"), (0, "low"))], F.count_if(waiting).alias("total"), F.count_if(t <= at).alias("enqueued"))


def health(depths: DataFrame, degraded: dict[str, int], unhealthy: dict[str, int]) -> DataFrame:
    """Status of a snapshot: the worst of its tiers, unhealthy before degraded."""
    level = F.greatest(*[F.when(F.col(t) >= unhealthy[t], 2).when(F.col(t) >= degraded[t], 1).otherwise(0) for t in degraded])
    return depths.withColumn("status", F.element_at(F.array(*map(F.lit, ("Healthy", "Degraded", "Unhealthy"))), level + 1))


def attempts(reqs: DataFrame, failures: Column, most: int = 3, retryable: Column | None = None) -> DataFrame:
    """One row an attempt: fails while its number is up to ``failures``; ``dead`` where the last allowed attempt failed."""
    allowed = F.when(retryable if retryable is not None else F.lit(True), F.lit(most)).otherwise(1)
    r = reqs.withColumn("_fail", failures).withColumn("_most", allowed)
    r = r.withColumn("attempt", F.explode(F.sequence(F.lit(1), F.least(F.col("_most"), F.col("_fail") + 1))))
    return r.withColumn("failed", F.col("attempt") <= F.col("_fail")).withColumn("dead", F.col("failed") & (F.col("attempt") == F.col("_most"))).drop("_fail", "_most")


def outcome_counts(tries: DataFrame, by: list[str]) -> DataFrame:
    return tries.groupBy(*by).agg(
        F.count_if(~F.col("failed")).alias("completed"), F.count_if(F.col("dead")).alias("dead_lettered"), F.count_if(F.col("failed") & ~F.col("dead")).alias("retried"), F.count(F.lit(1)).alias("attempts")
    )


def conservation(reqs: DataFrame, tries: DataFrame, cancelled: DataFrame) -> DataFrame:
    """Enqueued = completed + failed + cancelled (dead letters are among the failed)."""
    total = reqs.agg(F.count(F.lit(1)).alias("enqueued"))
    ended = outcome_counts(tries, []).select("completed", F.col("dead_lettered").alias("failed"))
    gone = cancelled.agg(F.count(F.lit(1)).alias("cancelled"))
    e, c, g = total.first()[0], ended.first(), gone.first()[0]
    row = (e, c["completed"], c["failed"], g, e == c["completed"] + c["failed"] + g)
    return reqs.sparkSession.createDataFrame([row], "enqueued long, completed long, failed long, cancelled long, holds boolean")


def peak_concurrency(reqs: DataFrame) -> DataFrame:
    """Most requests of a tier running at once; an end at the same instant comes before a start."""
    start = F.unix_micros(F.col("ts").cast("timestamp"))
    end = start + F.round(F.col("seconds") * 1_000_000).cast("long")
    edges = reqs.select("priority", F.explode(F.array(F.struct(start.alias("t"), F.lit(1).alias("step")), F.struct(end.alias("t"), F.lit(-1).alias("step")))).alias("e")).select("priority", "e.t", "e.step")
    run = bucketed_sum(edges, ["priority"], F.floor(F.col("t") / 3_600_000_000), ["t", "step"], "step", "running")
    return run.groupBy("priority").agg(F.max("running").cast("long").alias("peak"))


def validate_ids(reqs: DataFrame) -> DataFrame:
    """Counts by outcome: empty, too long, control character, duplicate (all but the first pending), accepted."""
    first = reqs.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    reason = F.when(F.coalesce(F.length("id"), F.lit(0)) == 0, "empty").when(F.length("id") > 256, "too long").when(F.col("id").rlike("[\\x00-\\x1F]"), "control character").otherwise("accepted")
    split = first.withColumn("status", reason).withColumn("accepted", F.when(F.col("status") == "accepted", 1).otherwise(F.col("n"))).withColumn("duplicates", F.col("n") - F.col("accepted"))
    s = split.groupBy("status").agg(F.sum("accepted").alias("n")).unionByName(split.agg(F.lit("duplicate").alias("status"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("n")))
    return s.filter("n > 0")


def cancel(reqs: DataFrame, ids: DataFrame) -> DataFrame:
    """What stays queued after cancelling ids."""
    return reqs.join(ids.select("request_id").distinct(), "request_id", "left_anti")


def timed_out(reqs: DataFrame, default_s: float, own: Column) -> DataFrame:
    """A request's own timeout holds, else the default; a negative one never ends it."""
    limit = F.coalesce(own, F.lit(default_s))
    return reqs.withColumn("timed_out", (limit >= 0) & (F.col("seconds") > limit))


def duration_stats(reqs: DataFrame, by: list[str]) -> DataFrame:
    return reqs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 3).alias("total"), F.round(F.avg("seconds"), 6).alias("mean"), F.min("seconds").alias("least"), F.max("seconds").alias("most"),
        F.count_if(F.col("seconds") < 10).alias("under_10"), F.count_if((F.col("seconds") >= 10) & (F.col("seconds") < 100)).alias("from_10"), F.count_if(F.col("seconds") >= 100).alias("from_100"),
    )


def route(reqs: DataFrame, handlers: dict[str, Column], kind: str = "event_type") -> DataFrame:
    """Apply the handler registered for a row's kind; a kind without one is an error in ``error``."""
    out, error = F.lit(None).cast("string"), F.concat(F.lit("no handler: "), F.col(kind))
    for k, h in handlers.items():
        out = F.when(F.col(kind) == k, h).otherwise(out)
    return reqs.withColumn("output", out).withColumn("error", F.when(~F.coalesce(F.col(kind).isin(*handlers), F.lit(False)), error))


@dataclass(frozen=True)
class PoolOptions:
    """Options of a pool; every problem is reported at once."""

    max_concurrency: int = 8
    capacity: int = 1000
    weights: tuple[int, int, int] = (1, 3, 5)
    tier_limits: tuple[int | None, int | None, int | None] = (None, None, None)
    timeout_s: float = -1
    max_attempts: int = 1
    retry_delay_s: float = 0
    aging_threshold_s: float | None = None
    aging_scan_s: float = 1
    idle_eviction_s: float = 300
    drain_timeout_s: float = 30
    full_mode: str = "wait"
    partition_capacity: int | None = None
    problems: tuple[str, ...] = field(default=(), init=False)

    def __post_init__(self) -> None:
        bad = [
            m
            for wrong, m in (
                (self.max_concurrency < 1, "max_concurrency must be positive"),
                (self.capacity < 1, "capacity must be positive"),
                (self.weights is None, "weights must be given"),
                (self.weights is not None and len(self.weights) != 3, "three weights are needed, for low, normal and high"),
                (any(w < 1 for w in self.weights or ()), "weights must be positive"),
                (self.full_mode not in ("wait", "drop_oldest", "drop_newest", "drop_write"), "full_mode is unknown"),
                (self.drain_timeout_s < 0 and self.drain_timeout_s != -1, "drain_timeout_s must be -1 or not negative"),
                (self.timeout_s <= 0 and self.timeout_s != -1, "timeout_s must be -1 or positive"),
                (self.partition_capacity is not None and self.partition_capacity < 1, "partition_capacity must be positive"),
                (self.idle_eviction_s < 0, "idle_eviction_s must not be negative"),
                (self.max_attempts < 1, "max_attempts must be positive"),
                (self.retry_delay_s < 0, "retry_delay_s must not be negative"),
                (self.aging_threshold_s is not None and self.aging_threshold_s <= 0, "aging_threshold_s must be positive"),
                (self.aging_scan_s <= 0, "aging_scan_s must be positive"),
                (len(self.tier_limits) != 3, "three tier limits are needed"),
                (any(x is not None and x < 0 for x in self.tier_limits), "tier limits must not be negative"),
            )
            if wrong
        ]
        if bad:
            raise ValueError("; ".join(bad))


def quantum_order(items: list[tuple[int, str]], quanta: dict[int, int]) -> list[tuple[int, str]]:
    """Order in which a quantum scheduler serves (priority, item) queued in FIFO order; lower priorities first.

    A priority that has used its quantum is reset and passed over once; when all are passed over, the first with items
    is served without being charged.
    """
    queues: dict[int, list[str]] = {}
    for p, x in items:
        queues.setdefault(p, []).append(x)
    served, heads, out = dict.fromkeys(queues, 0), dict.fromkeys(queues, 0), []
    order = sorted(queues)
    while len(out) < len(items):
        for p in order:
            if heads[p] < len(queues[p]):
                if served[p] >= quanta.get(p, 1):
                    served[p] = 0
                    continue
                served[p] += 1
                break
        else:
            p = next(p for p in order if heads[p] < len(queues[p]))
        out.append((p, queues[p][heads[p]]))
        heads[p] += 1
    return out


def quantum_schedule(reqs: DataFrame, run: str, quanta: dict[int, int]) -> DataFrame:
    """``request_id, run, position`` by the quantum scheduler, simulated within each run."""
    import pandas as pd

    def simulate(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "request_id"])
        order = quantum_order(list(zip((2 - pdf["priority"]).tolist(), pdf["request_id"].tolist())), quanta)
        return pd.DataFrame({"run": key[0], "request_id": [x for _, x in order], "position": range(len(order))})

    return reqs.select(F.col(run).alias("run"), "request_id", "ts", "priority").groupBy("run").applyInPandas(simulate, f"run {reqs.schema[run].dataType.simpleString()}, request_id long, position long")
