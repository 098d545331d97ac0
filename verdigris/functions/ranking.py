"""Positions and running sums over large ordered groups, without a group in one task.

A window over a whole lane sorts the lane in one task. Here rows are first put in buckets that follow the order (hours of
a timestamp, say); a small table of bucket totals gives what lies before each bucket, and the window runs inside buckets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def range_bucket(df: DataFrame, key: str, buckets: int = 255, rows: int = 20_000) -> Column:
    """A bucket that follows the order of a string column: about as many rows in each, by bounds from a sample.

    Tables of up to ``rows`` rows are one bucket. The bounds only spread the work; they don't change a rank.
    """
    n = df.count()
    if n <= rows:
        return F.lit(0)
    found = sorted(r[0] for r in df.select(key).filter(F.col(key).isNotNull()).sample(min(1.0, 40 * buckets / n), seed=7).collect())
    bounds = sorted({found[len(found) * (i + 1) // (buckets + 1)] for i in range(buckets)}) if found else []

    def search(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(key) < bounds[mid], search(lo, mid)).otherwise(search(mid + 1, hi))

    return F.when(F.col(key).isNull(), -1).otherwise(search(0, len(bounds)))


def bucketed_rank(df: DataFrame, by: list[str], bucket: Column, order: list, name: str) -> DataFrame:
    """0-based position of each row within ``by`` in ``order``; ``bucket`` must be monotone in the order."""
    df = df.withColumn("_bucket", bucket)
    counts = df.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy(*by).orderBy("_bucket")) - F.col("_n")).drop("_n")
    local = F.row_number().over(W.partitionBy(*by, "_bucket").orderBy(*order)) - 1
    return df.withColumn("_local", local).join(before, [*by, "_bucket"]).withColumn(name, (F.col("_before") + F.col("_local")).cast("long")).drop("_bucket", "_before", "_local")


def bucketed_sum(df: DataFrame, by: list[str], bucket: Column, order: list, value: str, name: str) -> DataFrame:
    """Running sum of ``value`` within ``by``, in the same way."""
    df = df.withColumn("_bucket", bucket)
    totals = df.groupBy(*by, "_bucket").agg(F.sum(value).alias("_n"))
    before = totals.withColumn("_before", F.sum("_n").over(W.partitionBy(*by).orderBy("_bucket")) - F.col("_n")).drop("_n")
    local = F.sum(value).over(W.partitionBy(*by, "_bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn("_local", local).join(before, [*by, "_bucket"]).withColumn(name, F.col("_before") + F.col("_local")).drop("_bucket", "_before", "_local")
