"""The mutation log: sequences, segments, replay, truncation, sizes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import applied, number_in, record_size
from ..sources.shared import written


def with_running_max(df: DataFrame, column: str, order: str, block: int, name: str) -> DataFrame:
    """The largest value of the rows before, in the order of a whole number. Rows are cut into blocks of
    that order: the blocks' maxima run on over a table of one row per block, rows within their block."""
    df = df.withColumn("__b", F.floor(F.col(order) / block))
    blocks = df.groupBy("__b").agg(F.max(column).alias("__m"))
    before = blocks.withColumn("__before", F.max("__m").over(Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1))).drop("__m")
    inside = Window.partitionBy("__b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.join(before, "__b").withColumn(name, F.greatest(F.max(column).over(inside), "__before")).drop("__b", "__before")


def replay(log: DataFrame, applied_until: int, order: str = "pos", block: int = 1_000_000) -> DataFrame:
    """What recovery applies: records whose seq is above applied_until and above every seq before them.
    Records without a key (no mutation) move the sequence on and are skipped. A type other than PUT and
    DELETE is an error. The result has the applied value."""
    kept = with_running_max(log, "seq", order, block, "__prev")
    kept = kept.where(F.col("seq") > F.greatest(F.coalesce("__prev", F.lit(applied_until)), F.lit(applied_until))).drop("__prev")
    return kept.where(F.col("key").isNotNull()).withColumn("value", applied(F.col("type"), F.col("value")))


def placed(batch: DataFrame, order: list[str]) -> DataFrame:
    """The batch range-sorted and written, with the partition and the row of each record."""
    number = F.monotonically_increasing_id()  # the partition in the upper bits, the row in the lower 33
    return written(batch.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", number), "append")


def numbered(log_end: int, placed: DataFrame) -> DataFrame:
    """Gives placed records the sequences after log_end: rows move up by the counts of the partitions before."""
    spark = placed.sparkSession
    placed = placed.select("*", F.shiftright("__m", 33).cast("int").alias("__p"))
    counts = {r["__p"]: r["n"] for r in placed.groupBy("__p").agg(F.count("*").alias("n")).collect()}
    offsets, total = {}, log_end
    for p in sorted(counts):
        offsets[p] = total
        total += counts[p]
    if not offsets:
        return placed.drop("__p", "__m").withColumn("seq", F.lit(None).cast("long"))
    first = spark.createDataFrame(list(offsets.items()), "__p int, __o long")
    inside = F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return placed.join(F.broadcast(first), "__p").withColumn("seq", F.col("__o") + inside).drop("__p", "__o", "__m")


def append(log_end: int, batch: DataFrame, order: list[str]) -> DataFrame:
    """Gives the batch the sequences after log_end, in the given order."""
    return numbered(log_end, placed(batch, order))


def seq_violations(log: DataFrame, order: str = "pos", block: int = 1_000_000) -> DataFrame:
    """Records whose seq is below one before them."""
    return with_running_max(log, "seq", order, block, "prev").where("seq < prev")


def verify(log: DataFrame) -> DataFrame:
    """log: start_seq (of the segment) and seq. One row per segment: start_seq, records, last_seq. A segment
    that doesn't begin with the record it is named by, has gaps or repeats, or isn't followed by the next
    one, is an error. The window runs over one row per segment."""
    per = log.groupBy("start_seq").agg(F.count("*").alias("records"), F.count_distinct("seq").alias("__d"), F.min("seq").alias("__lo"), F.max("seq").alias("last_seq"))
    following = F.lead("start_seq").over(Window.orderBy("start_seq"))
    whole = (F.col("__lo") == F.col("start_seq")) & (F.col("records") == F.col("__d")) & (F.col("last_seq") - F.col("__lo") + 1 == F.col("records"))
    whole = whole & F.coalesce(F.col("__next") == F.col("last_seq") + 1, F.lit(True))
    broken = F.raise_error(F.concat(F.lit("the log is broken at "), F.col("start_seq"))).cast("long")
    return per.withColumn("__next", following).select("start_seq", F.when(whole, F.col("records")).otherwise(broken).alias("records"), "last_seq")


def list_segments(names: DataFrame) -> DataFrame:
    """Names wal-<n>.log with their start, by number; other names are left out, but wal-x.log is an error."""
    return names.select("name", number_in(F.col("name"), "wal-", ".log").alias("start_seq")).where("start_seq is not null").orderBy("start_seq")


def truncatable(segments: DataFrame, applied_until: int) -> DataFrame:
    """Segments all of whose records are applied: the next one starts below applied_until. One row per
    file of the log, so the window may run over all of them."""
    following = F.lead("start_seq").over(Window.orderBy("start_seq"))
    return segments.withColumn("next_seq", following).where(F.col("next_seq") < applied_until).select("start_seq", "next_seq")


def rollover(log: DataFrame, target: int, by: str, order: str = "seq") -> DataFrame:
    """The segment of each record: named by its first seq; a record opens a new one if the current segment
    is over target before it. Every log (by) is folded in order by itself, in batches: where a segment begins depends on all
    before it, so one task reads one log, a batch at a time."""
    names = [by, order, "size", "segment"]

    def fold(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        which, held, start = None, 0, 0
        for f in frames:
            out = []
            for log_, seq, size in zip(f[by].tolist(), f[order].tolist(), f["size"].tolist()):
                if which != log_ or held > target:
                    which, held, start = log_, 0, seq
                held += size
                out.append(start)
            yield f.assign(segment=out)[names]

    sized = log.select(by, order, record_size(F.col("key"), F.col("value")).alias("size"))
    return sized.repartition(by).sortWithinPartitions(by, order).mapInPandas(fold, f"{by} {log.schema[by].dataType.simpleString()}, {order} long, size long, segment long")


def size_estimate(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.sum(record_size(F.col("key"), F.col("value"))).alias("bytes"), F.count("*").alias("records"))
