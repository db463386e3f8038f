"""Reads: newest versions, layers, time travel, lookups of many keys, seeks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import NOT_FOUND, OK, key_status
from . import log


def _first(df: DataFrame, *order: Column) -> DataFrame:
    """The first row of each key. Spark pushes the limit of one below the shuffle."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy("key").orderBy(*order))).where("__rn = 1").drop("__rn")


def _newest(df: DataFrame) -> list[Column]:
    return [F.desc("ts"), *([F.desc("seq")] if "seq" in df.columns else [])]


def latest_version(df: DataFrame) -> DataFrame:
    """Of each key the version with the largest ts, tombstones included; ties by the later seq."""
    return _first(df, *_newest(df))


def as_of(df: DataFrame, ts: int) -> DataFrame:
    """Of each key the newest version at or before ts."""
    return latest_version(df.where(F.col("ts") <= ts))


def live(df: DataFrame) -> DataFrame:
    """Drops tombstones. Only after the versions were chosen, or older values would come back."""
    return df.where(F.col("value").isNotNull())


def live_view(df: DataFrame) -> DataFrame:
    return live(latest_version(df))


def layered(df: DataFrame) -> DataFrame:
    """Of each key the version in the upper-most layer (0 first) that has any, the newest one there. From layer 2 on, the
    runs', of versions with the same ts the first run's, within a run the later seq; above, the later seq. A tombstone
    above hides what is below, whatever its ts."""
    return _first(df, F.asc("layer"), F.desc("ts"), F.when(F.col("layer") >= 2, F.col("run")).asc(), *_newest(df)[1:])


def point_get(df: DataFrame, key: str) -> DataFrame:
    """The newest visible version of one key, or no row. Where the key is a stored column, as in runs, it reaches the scan
    as a pushed filter."""
    return live_view(df.where(F.col("key") == key))


def multi_get(df: DataFrame, probes: DataFrame, by_layer: bool = False) -> DataFrame:
    """For each probe key: status, ts, value. Only probed keys go through the version choice, by layers or by
    time alone."""
    asked = probes.select("key").distinct()
    found = df.join(asked, "key", "left_semi")
    newest = live(layered(found) if by_layer else latest_version(found)).select("key", "ts", "value")
    status = F.when(key_status(F.col("key")) != OK, key_status(F.col("key"))).when(F.col("value").isNull(), F.lit(NOT_FOUND)).otherwise(F.lit(OK))
    return probes.join(newest, "key", "left").withColumn("status", status)


def scan(df: DataFrame) -> DataFrame:
    """All versions in the order of the store: key ascending, ts descending."""
    return df.orderBy("key", *_newest(df))


def key_range(df: DataFrame, start: str | None = None, stop: str | None = None) -> DataFrame:
    """Extension: live rows with start <= key < stop."""
    if start is not None:
        df = df.where(F.col("key") >= start)
    return live_view(df.where(F.col("key") < stop) if stop is not None else df)


def seek_ge(df: DataFrame, key: str, ts: int) -> DataFrame:
    """The first row at or after (key, ts) in the order of the store."""
    return df.where((F.col("key") > key) | ((F.col("key") == key) & (F.col("ts") <= ts))).orderBy("key", *_newest(df)).limit(1)


def sparse_index_find(probes: DataFrame, blocks: DataFrame) -> DataFrame:
    """For each probe key the least last_key that isn't below it, or null.

    A forward as-of join without a range join: probes and blocks are range-sorted together and written, and each probe
    takes the least last_key that follows in its range; what a range lacks comes from the next ranges' least ones, one row
    per range. Ranges are as many as the session's shuffle partitions."""
    both = probes.select("key", F.lit(0).alias("block")).distinct().union(blocks.where("last_key is not null").select(F.col("last_key").alias("key"), F.lit(1).alias("block")).distinct())
    both = log.placed(both, ["key", "block"]).withColumn("part", F.shiftright("__m", 33))
    least = both.groupBy("part").agg(F.min(F.when(F.col("block") == 1, F.col("key"))).alias("least"))
    rest = least.select("part", F.min("least").over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing)).alias("rest"))
    ahead = Window.partitionBy("part").orderBy("key", "block").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("own", F.min(F.when(F.col("block") == 1, F.col("key"))).over(ahead)).where("block = 0").join(rest, "part")
    return found.select("key", F.coalesce("own", "rest").alias("last_key"))
