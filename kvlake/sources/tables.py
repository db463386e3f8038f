"""Sources: the mutation view over an events table, rows from memory, synthetic load."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import DELETE, PUT, RECORD


def mutations(events: DataFrame) -> DataFrame:
    """seq, key, ts, type, value (text), layer, run."""
    gone = F.col("event_type") == "error"
    e = F.col("event_id")
    return events.select(
        (e + 1).alias("seq"),
        F.col("user_id").cast("string").alias("key"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"),
        F.when(gone, F.lit(DELETE)).otherwise(F.lit(PUT)).alias("type"),
        F.when(~gone, F.col("props")).alias("value"),
        F.when(e % 10 == 9, 0).when(e % 10 == 8, 1).otherwise(2).alias("layer"),
        (e % 8).alias("run"),
    )


def rows(spark: SparkSession, records: list[tuple]) -> DataFrame:
    return spark.createDataFrame(records, RECORD)


def load_data(spark: SparkSession, n: int = 1000, key_size: int = 10, value_size: int = 800, seed: int = 1) -> DataFrame:
    """n synthetic records with random keys of letters and digits, made on the executors."""
    alphabet = F.lit("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    pick = lambda k: F.substring(alphabet, (F.pmod(F.xxhash64("id", F.lit(seed), F.lit(k)), F.lit(62)) + 1).cast("int"), F.lit(1))
    block = lambda k: F.unhex(F.sha2(F.concat_ws("/", F.lit(seed), F.col("id"), F.lit(k)), 512))
    value = F.concat(*[block(k) for k in range(-(-value_size // 64))]) if value_size else F.unhex(F.lit(""))
    return spark.range(n).select(F.concat(*[pick(k) for k in range(key_size)]).alias("key"), F.substring(value, 1, value_size).alias("value"))
