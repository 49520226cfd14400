"""Latency over any period from stored sketches, without the records.

A day's latencies of a category become one KLL sketch of a few kilobytes, written once; the
quantiles of any run of days come from merging their sketches. The rank of an answer is off by a
normalised error that depends on ``k`` alone (about 2.3 / k^0.9 at 99 % confidence), whatever the records.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accuracy of a sketch; the size of one follows it.
K = 400


def rank_error(k: int = K) -> float:
    """Bound of the normalised rank error, single-sided, at 99 % confidence."""
    return 2.296 / k**0.9021


def latency_seconds(records: DataFrame) -> DataFrame:
    lat = F.timestamp_diff("MICROSECOND", F.col("received_ts"), F.col("processed_ts")) / F.lit(1e6)
    return records.select(F.to_date("received_ts").alias("received_date"), "category", lat.alias("latency_s"))


def daily_sketches(records: DataFrame, k: int = K) -> DataFrame:
    """One row per received day and category: ``n``, ``max_s`` and the sketch. Records without a latency
    are counted in no sketch; partial sketches are made where the records are, so a hot category is no hot task."""
    known = latency_seconds(records).where("latency_s IS NOT NULL")
    return known.groupBy("received_date", "category").agg(
        F.count(F.lit(1)).alias("n"), F.max("latency_s").alias("max_s"), F.kll_sketch_agg_double("latency_s", k).alias("sketch"))


def write_sketches(records: DataFrame, path: str, k: int = K) -> None:
    """Write the days of ``records``, which must be whole; a day that is written again is replaced."""
    (daily_sketches(records, k).repartition("received_date").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("received_date").parquet(path))


def latency_between(spark: SparkSession, path: str, first_day: str, last_day: str, quantiles: tuple[float, ...] = (0.5, 0.95), k: int = K) -> DataFrame:
    """Per category over the days from ``first_day`` to ``last_day``: ``n``, ``max_s`` and a column ``p<percent>_s``
    for each quantile. Only the sketches of those days are read."""
    days = F.col("received_date").between(F.to_date(F.lit(first_day)), F.to_date(F.lit(last_day)))
    merged = spark.read.parquet(path).where(days).groupBy("category").agg(
        F.sum("n").alias("n"), F.max("max_s").alias("max_s"), F.kll_merge_agg_double("sketch", k).alias("sketch"))
    named = [F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(f"p{round(100 * q)}_s") for q in quantiles]
    return merged.select("category", "n", *named, "max_s")
