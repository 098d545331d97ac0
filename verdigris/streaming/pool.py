"""The request pool as a stream: throughput windows, pending duplicates, idle partitions and job trackers."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from verdigris.operators.scheduling import priority_of
from verdigris.session import ship


def request_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1) -> DataFrame:
    """Requests from parquet files of events as they arrive; times are instants, so that they can carry a watermark."""
    ship(spark)
    schema = spark.read.parquet(folder).schema
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.select(F.col("event_id").alias("request_id"), F.col("ts").cast("timestamp").alias("ts"), priority_of(F.col("event_type")).alias("priority"), F.coalesce(F.col("user_id").cast("string"), F.lit("__default")).alias("partition_key"), "event_type", F.col("value").alias("seconds"))


def throughput(requests: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Requests and seconds by tier and window; rows later than the watermark are left out."""
    w = requests.withWatermark("ts", late).groupBy(F.window("ts", width), "priority")
    return w.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("seconds"), 3).alias("seconds")).select(F.col("window.start").alias("start"), "priority", "n", "seconds")


def pending_once(requests: DataFrame, pending: str = "1 hour") -> DataFrame:
    """The first of requests with the same id while it is pending."""
    return requests.withWatermark("ts", pending).dropDuplicatesWithinWatermark(["request_id"])


def sessions(requests: DataFrame, idle: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity of each partition between idle evictions."""
    s = requests.withWatermark("ts", late).groupBy("partition_key", F.session_window("ts", idle))
    return s.agg(F.count(F.lit(1)).alias("n")).select("partition_key", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def tracker(requests: DataFrame, idle_s: int = 86_400, late: str = "10 minutes") -> DataFrame:
    """Each job's count, failures and last event, updated with every batch; state is one row a key.

    A job without events for ``idle_s`` seconds of the watermark is told once more, as ``expired``, and forgotten.
    """

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, failed, last_ts, last = state.get if state.exists else (0, 0, 0, "")
        expired = state.hasTimedOut
        if expired:
            state.remove()
        else:
            for b in batches:
                n += len(b)
                failed += int((b["event_type"] == "error").sum())
                b = b.sort_values(["ts", "request_id"])
                at = int(b["ts"].iloc[-1].value // 1000)
                if at >= last_ts:
                    last_ts, last = at, str(b["event_type"].iloc[-1])
            state.update((n, failed, last_ts, last))
            state.setTimeoutTimestamp(max(last_ts // 1000 + idle_s * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"partition_key": [key[0]], "n": [n], "failed": [failed], "last_event": [last], "expired": [expired]})

    return requests.withWatermark("ts", late).groupBy("partition_key").applyInPandasWithState(
        update, "partition_key string, n long, failed long, last_event string, expired boolean", "n long, failed long, last_ts long, last string", "update", GroupStateTimeout.EventTimeTimeout
    )


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Everything that is there now, through the stream into a table in memory (for tests and small reports)."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
