"""Roll-ups of orchestrated work: batches, pipelines, jobs, trackers and the views a dashboard polls.

Statuses: 0 Unknown, 1 Pending, 2 Processing, 3 Completed, 4 Failed, 5 Cancelled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

STATUSES = ["Unknown", "Pending", "Processing", "Completed", "Failed", "Cancelled"]


def status_name(code: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, STATUSES)), code.cast("int") + 1)


def fan_out(items: DataFrame, workers: int, batch: str = "batch", item: str = "item") -> DataFrame:
    """Item i goes to worker i mod ``workers``; with the keys of both."""
    w = F.pmod(F.col(item), F.lit(workers))
    return items.withColumns({"worker": w, "item_key": F.concat(F.col(batch), F.lit(":item-"), F.col(item)), "worker_key": F.concat(F.col(batch), F.lit(":worker-"), w)})


def result_status(cancelled: Column, error: Column) -> Column:
    return F.when(cancelled, "Cancelled").when(error.isNotNull(), "Failed").otherwise("Completed")


def overall(n: Column, done: Column, failed: Column, cancelled: Column, batch_cancelled: Column, running: str = "Processing") -> Column:
    """A batch's status: cancelled itself; when all items ended, Failed before Cancelled before Completed; else running."""
    return F.when(batch_cancelled, "Cancelled").when(done < n, running).when(failed > 0, "Failed").when(cancelled > 0, "Cancelled").otherwise("Completed")


def batch_summary(items: DataFrame, batch: str = "batch") -> DataFrame:
    """Counts by status and the overall status of each batch; ``batch_cancelled`` marks cancelled batches."""
    s = F.col("status")
    counts = items.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(s == x).alias(x.lower()) for x in STATUSES[1:]], F.coalesce(F.bool_or("batch_cancelled"), F.lit(False)).alias("batch_cancelled")
    )
    done = F.col("completed") + F.col("failed") + F.col("cancelled")
    return counts.withColumn("overall", overall(F.col("n"), done, F.col("failed"), F.col("cancelled"), F.col("batch_cancelled")))


def worker_counts(items: DataFrame, batch: str = "batch") -> DataFrame:
    return items.groupBy(batch, "worker").agg(F.count(F.lit(1)).alias("assigned"), F.count_if(F.col("status") == "Completed").alias("completed"))


def cancel_batches(items: DataFrame, batches: DataFrame, batch: str = "batch") -> DataFrame:
    """Pending and running items of the batches become Cancelled."""
    hit = batches.select(batch, F.lit(True).alias("_hit")).dropDuplicates([batch])
    s = F.when(F.col("_hit") & F.col("status").isin("Pending", "Processing"), "Cancelled").otherwise(F.col("status"))
    return items.join(hit, batch, "left").withColumn("status", s).drop("_hit")


def cancel_worker(items: DataFrame, worker: int) -> DataFrame:
    s = F.when((F.col("worker") == worker) & F.col("status").isin("Pending", "Processing"), "Cancelled").otherwise(F.col("status"))
    return items.withColumn("status", s)


def latest(updates: DataFrame, key: str, values: list[str], order: list[str]) -> DataFrame:
    """A tracker: the last update of each key, by ``order``; no window, so it combines before the shuffle."""
    return updates.groupBy(key).agg(F.max_by(F.struct(*values), F.struct(*order)).alias("_last")).select(key, *[F.col(f"_last.{v}").alias(v) for v in values])


def lookup(ids: DataFrame, tracked: DataFrame, key: str, default: str = "Unknown") -> DataFrame:
    """Statuses of requested ids; an id without updates is Unknown."""
    return ids.join(tracked, key, "left").withColumn("status", F.coalesce("status", F.lit(default)))


def accepts(kind: Column, status: Column) -> Column:
    """Whether a job may be submitted again in its last status."""
    blocked = F.when(kind == "job", status == "Processing").when(kind == "report", status.isin("Processing", "Completed")).when(kind == "notification", status.isin("Pending", "Processing", "Completed"))
    return ~F.coalesce(blocked, F.lit(False))


def pivot_status(updates: DataFrame, key: str, channel: str, channels: list[str]) -> DataFrame:
    """One row for each key with its channels' last statuses, Unknown where there is none."""
    last = updates.groupBy(key, channel).agg(F.max_by("status", F.struct("ts", "seq")).alias("status"))
    wide = last.groupBy(key).pivot(channel, channels).agg(F.first("status"))
    return wide.select(key, *[F.coalesce(F.col(c), F.lit("Unknown")).alias(c) for c in channels])


def pipeline_outputs(docs: DataFrame) -> DataFrame:
    """Extract (words), transform (keywords: a fiftieth of the words, three at least; a sentiment from -1 to 1 by the
    document's number, where a service would score it), index (first three)."""
    words = F.when(F.trim(F.coalesce("text", F.lit(""))) == "", 0).otherwise(F.size(F.split(F.trim("text"), r"[ \n\t\r]+")))
    n = F.greatest(F.lit(3), F.floor(F.col("n_words") / 50)).cast("int")
    keys = F.transform(F.sequence(F.lit(1), F.least(F.col("n_keywords"), F.lit(3))), lambda i: F.concat(F.lit("kw-"), i))
    return docs.select("doc_id", words.cast("long").alias("n_words")).withColumn("n_keywords", n).withColumn("sentiment", F.round(F.pmod(F.col("doc_id") * 7919, F.lit(2001)) / 1000.0 - 1, 3)).withColumn("preview", F.array_join(keys, ", "))


def step_status(extract: Column, transform: Column, index: Column) -> Column:
    """A three-step pipeline: the first failed step stops it; a running one blocks a restart."""
    steps = [("extract", extract), ("transform", transform), ("index", index)]
    out = F.lit("Completed")
    for name, s in reversed(steps):
        out = F.when(s == "Failed", F.lit(f"Failed at {name}")).when(s.isin("Pending", "Processing"), F.lit(f"Running {name}")).otherwise(out)
    return out


def progress(phases: DataFrame, key: str) -> DataFrame:
    """Percent after each step of a job's phases (name, steps), with labels ``name (i/n)``; two ways to round."""
    rows = phases.withColumn("i", F.explode(F.sequence(F.lit(1), F.col("steps"))))
    step = F.col("before") + F.col("i")
    return rows.select(key, F.concat(F.col("name"), F.lit(" ("), F.col("i"), F.lit("/"), F.col("steps"), F.lit(")")).alias("label"), F.floor(step * 100 / F.col("total")).cast("long").alias("percent"), F.bround(step * 100.0 / F.col("total"), 0).cast("long").alias("percent_rounded"))


def cluster_stats(nodes: DataFrame, counters: list[str]) -> DataFrame:
    """Counters of all nodes added up, zeros without nodes, and the number of nodes."""
    return nodes.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counters], F.count_distinct("node").alias("n_nodes"))


def inject_faults(steps: DataFrame, per_thousand: int, key: Column) -> DataFrame:
    """Deterministic faults: a multiplicative scramble of a key instead of a random number; kinds in turn."""
    h = F.pmod(key * 7919 + 104729, F.lit(1000))
    return steps.withColumn("fault", F.when(h < per_thousand, F.element_at(F.array(*map(F.lit, ("timeout", "invalid", "io", "unexpected"))), (F.pmod(key, F.lit(4)) + 1).cast("int"))))


def bootstrap_kind(i: Column) -> Column:
    return F.when(F.pmod(i, F.lit(3)) == 0, "import").when(F.pmod(i, F.lit(3)) == 1, "export").otherwise("scheduled")


def preview(items: DataFrame, key: str, value: str, order: str, n: int = 3) -> DataFrame:
    """The first ``n`` values joined, with an ellipsis where there are more; ranks beyond n + 1 go before the shuffle."""
    rank = F.row_number().over(W.partitionBy(key).orderBy(order))
    few = items.select(key, order, value).withColumn("_rank", rank).filter(F.col("_rank") <= n + 1)
    first = F.transform(F.array_sort(F.collect_list(F.when(F.col("_rank") <= n, F.struct("_rank", value)))), lambda x: x[value])
    return few.groupBy(key).agg(F.concat(F.array_join(first, ", "), F.when(F.max("_rank") > n, "…").otherwise("")).alias("preview"))
