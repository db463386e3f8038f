"""Sorted runs: writing, merging, statistics, prefix coding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import common_prefix
from ..schema import PAGE_ROWS, RESTART
from .log import numbered, placed


def ordered(df: DataFrame, files: int) -> DataFrame:
    """Range-partitioned by key and sorted as the store is, so that row groups have narrow key ranges."""
    return df.repartitionByRange(files, "key", "ts").sortWithinPartitions("key", F.desc("ts"))


def write_run(df: DataFrame, path: str, files: int = 1, bloom_keys: int = 1_000_000, bloom: bool = True) -> None:
    """Pages are short and carry their least and greatest keys: a lookup reads the rows of one, as the keys are sorted."""
    (
        ordered(df, files)
        .write.option("parquet.bloom.filter.enabled#key", str(bloom).lower())
        .option("parquet.bloom.filter.expected.ndv#key", str(bloom_keys))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .option("parquet.page.write-checksum.enabled", "true")
        .parquet(path)
    )


def kway_merge(inputs: list[DataFrame]) -> DataFrame:
    """All rows of all inputs in the order of the store: a bag, tombstones and repeats stay."""
    return reduce(DataFrame.unionByName, inputs).orderBy("key", F.desc("ts"))


def compact(inputs: list[DataFrame], files: int, drop_old: bool = False) -> DataFrame:
    """The content of one new run. drop_old (extension): only each key's newest version, without tombstones;
    safe only when no older run stays behind."""
    merged = reduce(DataFrame.unionByName, inputs)
    if drop_old:
        from .read import live_view

        merged = live_view(merged)
    return ordered(merged, files)


def run_stats(df: DataFrame) -> DataFrame:
    return df.groupBy("run").agg(F.max("seq").alias("applied_until"), F.count("*").alias("records"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def list_blocks(df: DataFrame) -> DataFrame:
    """df: runs as read from their files. One row per block that Spark reads in one piece: run, file,
    first_byte, records, first_key, last_key."""
    at = df.select("key", "_metadata.file_path", "_metadata.file_name", F.col("_metadata.file_block_start").alias("first_byte"))
    at = at.withColumn("run", F.regexp_extract("file_path", "([^/]+)/[^/]+$", 1))
    return at.groupBy("run", F.col("file_name").alias("file"), "first_byte").agg(F.count("*").alias("records"), F.min("key").alias("first_key"), F.max("key").alias("last_key"))


def prefix_encode(df: DataFrame, by: str = "run", restart: int = RESTART) -> DataFrame:
    """Each run's distinct keys, numbered by a range sort, with the length they share with the key before, none at a
    restart. Only the keys of one restart group meet in a window, so a run is coded by many tasks."""
    keys = numbered(0, placed(df.select(by, "key").distinct(), [by, "key"]))
    first = keys.groupBy(by).agg(F.min("seq").alias("__first"))
    keys = keys.join(first, by).withColumn("n", F.col("seq") - F.col("__first") + 1).withColumn("__g", F.floor((F.col("n") - 1) / restart))
    before = F.lag("key").over(Window.partitionBy(by, "__g").orderBy("n"))
    shared = F.when(F.col("prev").isNull(), 0).otherwise(common_prefix(F.col("prev"), F.col("key"))).cast("long")
    return keys.withColumn("prev", before).select(by, "key", "n", shared.alias("shared")).withColumn("suffix", F.expr("substring(key, cast(shared as int) + 1)"))


def prefix_decode(df: DataFrame, by: str = "run", restart: int = RESTART) -> DataFrame:
    """Inverts prefix_encode: within a restart group, keys are rebuilt one from the other. A key that shares more than
    the one before it has is an error."""
    group = df.withColumn("g", F.floor((F.col("n") - 1) / restart)).groupBy(by, "g").agg(F.sort_array(F.collect_list(F.struct("n", "shared", "suffix"))).alias("rows"))

    def step(done, r):
        before = F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))
        whole = r["shared"].between(0, F.length(before))
        return F.concat(done, F.array(F.when(whole, F.concat(F.substring(before, F.lit(1), r["shared"].cast("int")), r["suffix"])).otherwise(F.raise_error(F.lit("the coded keys are damaged")))))

    keys = F.aggregate("rows", F.array().cast("array<string>"), step)
    return group.select(by, F.explode(keys).alias("key"))
