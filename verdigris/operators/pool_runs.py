"""What a pool of workers does over time: admission to full queues, retries, start times, callbacks, meters, job phases."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigris.functions.ranking import bucketed_rank
from verdigris.operators.scheduling import hour
from verdigris.session import ship


def wait_for_room(reqs: DataFrame, capacity: int, bucket: Column | None = None) -> DataFrame:
    """A burst into lanes that make producers wait: nothing is dropped; a request enters once ``admitted_after`` others
    of its lane have been taken out."""
    ranked = bucketed_rank(reqs.select("request_id", "ts", "priority"), ["priority"], hour() if bucket is None else bucket, ["ts", "request_id"], "arrival")
    after = F.greatest(F.lit(0), F.col("arrival") - capacity + 1)
    return ranked.select("request_id", "priority", "arrival", (after > 0).alias("waited"), after.cast("long").alias("admitted_after"))


def retry_queue(tries: DataFrame, backoff_s: float) -> DataFrame:
    """Places of attempts in their lanes: each retry joins the tail ``backoff_s`` after the attempt before it."""
    ready = F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + ((F.col("attempt") - 1) * int(backoff_s * 1_000_000)).cast("long"))
    r = tries.select("request_id", "priority", "attempt", ready.alias("ready"))
    return bucketed_rank(r, ["priority"], F.date_trunc("hour", F.col("ready")), ["ready", "attempt", "request_id"], "lane_pos")


def cancel_lanes(reqs: DataFrame, priorities: list[int] | None = None) -> DataFrame:
    """Queued requests marked ``cancelled``: those of the lanes given, or all."""
    return reqs.withColumn("cancelled", F.lit(True) if priorities is None else F.col("priority").isin(priorities))


def ledger(reqs: DataFrame, kept: Column, cancelled: Column, failed: Column, at: Column, wait_s: float) -> DataFrame:
    """Where every request enqueued by a time is then, and whether the terms add up.

    A kept, uncancelled request starts ``wait_s`` after its arrival and takes its ``seconds``.
    """
    came = F.unix_micros(F.col("ts").cast("timestamp"))
    start = came + int(wait_s * 1_000_000)
    end = start + F.round(F.col("seconds") * 1_000_000).cast("long")
    now = F.unix_micros(at)
    state = (
        F.when(~kept, "dropped").when(cancelled, "cancelled").when(start > now, "queued").when(end > now, "in_flight").when(failed, "failed").otherwise("completed")
    )
    names = ("completed", "failed", "cancelled", "dropped", "in_flight", "queued")
    n = reqs.filter(came <= now).withColumn("state", state).agg(F.count(F.lit(1)).alias("enqueued"), *[F.count_if(F.col("state") == s).alias(s) for s in names])
    return n.withColumn("holds", F.col("enqueued") == sum((F.col(s) for s in names), F.lit(0)))


def worker_pool(reqs: DataFrame, run: str, workers: int, tier_limits: dict[int, int] | None = None) -> DataFrame:
    """``request_id, worker, start_s, end_s`` of requests served in order of arrival by ``workers`` of each run.

    A tier in ``tier_limits`` has no more than so many requests running at once. Rows come sorted to the task of their
    run and stream through it; only the workers' clocks are held.
    """
    ship(reqs.sparkSession)
    limits = tier_limits or {}
    kind = reqs.schema[run].dataType.simpleString()
    source = reqs.select(F.col(run).alias("run"), "request_id", "priority", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "seconds")

    def serve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, free, busy = None, [], {}
        for b in batches:
            rows = []
            for key, i, tier, at, seconds in zip(b["run"], b["request_id"], b["priority"], b["at"], b["seconds"]):
                if key != now:
                    now, free, busy = key, [(float("-inf"), w) for w in range(workers)], {}
                since, worker = heapq.heappop(free)
                start = max(at, since)
                if limits.get(tier):
                    ends = busy.setdefault(tier, [])
                    if len(ends) >= limits[tier]:
                        start = max(start, heapq.heappop(ends))
                    heapq.heappush(ends, start + seconds)
                heapq.heappush(free, (start + seconds, worker))
                rows.append((key, i, worker, start, start + seconds))
            yield pd.DataFrame(rows, columns=["run", "request_id", "worker", "start_s", "end_s"])

    ordered = source.repartition("run").sortWithinPartitions("run", "at", "request_id")
    return ordered.mapInPandas(serve, f"run {kind}, request_id long, worker int, start_s double, end_s double")


def notify(results: DataFrame, callback: Callable[[dict], None], key: str = "request_id") -> DataFrame:
    """Call back for every result; one that raises has its ``callback_error``, and the others go on."""
    ship(results.sparkSession)

    def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            errors = []
            for r in b.to_dict("records"):
                try:
                    callback(r)
                    errors.append(None)
                except Exception as e:  # a bad callback never ends a worker
                    errors.append(f"{type(e).__name__}: {e}")
            yield pd.DataFrame({key: b[key], "callback_error": pd.Series(errors, dtype=object)})

    return results.mapInPandas(call, f"`{key}` {results.schema[key].dataType.simpleString()}, callback_error string")


def meters(reqs: DataFrame, tries: DataFrame, kept: DataFrame, aged: DataFrame, sessions: DataFrame, cancelled: DataFrame, depth: DataFrame, peak: DataFrame) -> DataFrame:
    """All counters, the duration histogram's count and sum, and gauges as rows ``name, tag, value``."""

    def by(df: DataFrame, name: str, tag: Column, value: Column) -> DataFrame:
        return df.groupBy(tag.cast("string").alias("tag")).agg(value.cast("double").alias("value")).select(F.lit(name).alias("name"), "tag", "value")

    every, lane = F.count(F.lit(1)), F.col("priority")
    none = F.lit(None)
    outcome = F.when(F.col("dead"), "failed").when(~F.col("failed"), "succeeded")
    old = F.when(F.col("aged_priority") > F.col("priority"), 1).otherwise(0)
    rows = [
        by(reqs, "enqueued", lane, every), by(tries.filter(outcome.isNotNull()), "completed", outcome, every), by(reqs, "duration_count", none, every), by(reqs, "duration_sum", none, F.round(F.sum("seconds"), 3)),
        by(peak, "active_workers_peak", none, F.sum("peak")), by(cancelled, "cancelled", lane, every), by(tries.filter("failed AND NOT dead"), "retry", lane, every), by(tries.filter("dead"), "dead_letter", lane, every),
        by(kept.filter("NOT kept"), "dropped", lane, every), by(aged, "priority_promoted", lane, F.sum(old)), by(sessions, "partition_evicted", none, F.sum("evictions")),
        by(reqs.select("priority", "partition_key").distinct(), "partitions_active", lane, every), by(depth, "queue_depth", none, F.max("total")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


#: Phases of each handler's jobs; ``x3``: in three steps.
_PHASES = {
    "job": "Initializing x2; Loading data x3; Processing x6; Validating results x3; Finalizing x2",
    "scheduled": "validate-schedule x2; acquire-resources x2; execute x5; post-process x3; cleanup",
    "email": "Composing message x2; Validating address x2; Connecting to SMTP; Delivering x2; Confirming receipt",
    "sms": "Routing to carrier; Sending message x2; Awaiting delivery x2",
    "push": "Validating token; Dispatching x2; Awaiting ack",
    "generate": "Collecting data x3; Building structure x3; Applying formatting x2; Finalising x2",
    "review": "Validating content x3; Compliance check x3; Approval workflow x2",
    "publish": "Packaging report x2; Uploading to target x3; Notifying recipients x2",
    "extract": "Reading source x2; Tokenising x3; Cleaning tokens x3; Summarising x2",
    "transform": "Parsing raw text x2; Extracting keywords x4; Scoring sentiment x2; Normalising x2",
    "index": "Preparing index entry x2; Writing tags x3; Committing index x2; Verifying entry",
}
PHASES: dict[str, list[tuple[str, int]]] = {h: [(name, int(n or 1)) for name, _, n in (p.partition(" x") for p in own.split("; "))] for h, own in _PHASES.items()}


def phase_steps(jobs: DataFrame, handler: str = "handler") -> DataFrame:
    """Jobs with one row for each step of their handler: ``phase, step, total_steps, percent, message``; a message numbers
    the steps of phases with several. The tables of phases are constants, so there is no join."""
    rows = {h: [(name, i, n, step, total) for step, (name, i, n) in enumerate(((name, i, n) for name, n in own for i in range(1, n + 1)), 1)] for h, own in PHASES.items() for total in [sum(n for _, n in own)]}
    struct = lambda r: F.struct(*[F.lit(x).alias(c) for x, c in zip(r, ("phase", "i", "n", "step", "total_steps"))])
    steps = F.create_map(*[x for h, own in rows.items() for x in (F.lit(h), F.array(*map(struct, own)))])
    out = jobs.withColumn("_s", F.explode(steps[F.col(handler)]))
    s = F.col("_s")
    message = F.when(s["n"] > 1, F.concat(s["phase"], F.lit(" ("), s["i"], F.lit("/"), s["n"], F.lit(")"))).otherwise(s["phase"])
    percent = F.floor(s["step"] * 100 / s["total_steps"]).cast("int")
    return out.withColumns({"phase": s["phase"], "step": s["step"], "total_steps": s["total_steps"], "percent": percent, "message": message}).drop("_s")
