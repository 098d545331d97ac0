import shutil
import time

from pyspark.sql import functions as F

from verdigris.streaming import pool


def test_stream(spark, sf_dir, tmp_path):
    shutil.copy(f"{sf_dir}/events.parquet", tmp_path / "a.parquet")
    batch = spark.read.parquet(str(tmp_path))
    s = pool.request_stream(spark, str(tmp_path))
    got = pool.run_once(pool.throughput(s, "1 day", "30 days"), "windows", "complete")
    want = batch.groupBy(F.window(F.col("ts").cast("timestamp"), "1 day").start.alias("start")).count()
    assert got.agg(F.sum("n")).first()[0] == batch.count() and got.select("start").distinct().count() == want.count()
    once = pool.run_once(pool.pending_once(s.union(s)), "once")
    assert once.count() == batch.select("event_id").distinct().count()
    jobs = {r.partition_key: r for r in pool.run_once(pool.tracker(s), "jobs", "update").collect()}
    want = {r.k: (r.n, r.f, r.e) for r in batch.groupBy(F.col("user_id").cast("string").alias("k")).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("f"), F.max_by("event_type", F.struct("ts", "event_id")).alias("e")).collect()}
    assert {k: (r.n, r.failed, r.last_event) for k, r in jobs.items()} == want
    assert pool.run_once(pool.sessions(s, "1 hour", "1 day"), "open_sessions").columns == ["partition_key", "start", "end", "n"]


def test_idle_jobs_expire(spark, tmp_path):
    """A job that the watermark has left behind is told as expired, starts anew with its next event, and others go on."""
    for i, rows in enumerate(([(1, "2024-01-01 00:00:00", 1), (2, "2024-01-01 00:00:00", 2)], [(3, "2024-01-01 03:00:00", 2)], [(4, "2024-01-01 03:00:01", 2)], [(5, "2024-01-01 03:00:02", 1)])):
        df = spark.createDataFrame([(e, t, u, "view", 1.0) for e, t, u in rows], "event_id long, ts string, user_id long, event_type string, value double").withColumn("ts", F.to_timestamp("ts"))
        df.coalesce(1).write.parquet(str(tmp_path / f"b{i}"))
        part = next((tmp_path / f"b{i}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        shutil.copy(part, tmp_path / "in" / f"{i}.parquet")
        time.sleep(0.05)
    got = pool.run_once(pool.tracker(pool.request_stream(spark, str(tmp_path / "in")), 3600, "1 minute"), "idle_jobs", "update").collect()
    own = [(r.n, r.expired) for r in got if r.partition_key == "1"]
    assert own[:2] == [(1, False), (1, True)] and own[2] == (1, False)
    assert max(r.n for r in got if r.partition_key == "2") == 3
