"""Latency figures of a workload: counts, quantiles, correction for coordinated omission."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import log


def count_and_rate(samples: DataFrame, seconds: float) -> DataFrame:
    return samples.agg(F.count("*").alias("requests"), (F.count("*").cast("double") / F.lit(float(seconds))).alias("per_second"), F.sum(F.when(F.col("error"), 1).otherwise(0)).cast("long").alias("errors"))


def corrected(samples: DataFrame, interval: int) -> DataFrame:
    """A latency v above the interval also stands for v - interval, v - 2 interval, ... down to interval."""
    v, i = F.col("latency_us"), F.lit(interval).cast("long")
    every = F.when(v - i >= i, F.concat(F.array(v), F.sequence(v - i, i, -i))).otherwise(F.array(v))
    return samples.withColumn("latency_us", F.explode(every))


def quantiles(samples: DataFrame) -> DataFrame:
    """Exact p50, p95 and p99: partial histograms of the distinct values are merged by Spark."""
    q = lambda p: F.expr(f"percentile_disc({p}) within group (order by latency_us)")
    return samples.agg(q(0.5).alias("p50"), q(0.95).alias("p95"), q(0.99).alias("p99"))


def false_positive_rate(probes: DataFrame) -> DataFrame:
    return probes.agg(F.avg(F.col("hit").cast("double")).alias("rate"))


def paced_requests(keys: DataFrame, requests: int, per_second: float, workers: int, seed: int = 1) -> DataFrame:
    """When each worker asks for which key: workers pace themselves from a random start, and every request
    picks one of the distinct keys at random, each alike. Without keys there are no requests."""
    spark, every = keys.sparkSession, int(1_000_000.0 * workers / per_second)
    numbered = log.append(0, keys.select("key").distinct(), ["key"])
    n = numbered.agg(F.max("seq")).first()[0] or 1
    asked = spark.range(requests).select((F.col("id") % workers).alias("worker"), F.floor(F.col("id") / workers).alias("turn"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(n)) + 1).alias("seq"))
    start = F.pmod(F.xxhash64("worker", F.lit(seed)), F.lit(max(every, 1)))
    return asked.join(numbered, "seq").select("worker", (start + F.col("turn") * F.lit(every)).alias("at_us"), "key")
