"""Exact deduplication by a tree merge of sorted digest runs, in DataFrame operations only.

Every input partition is a run: its rows' digests, sorted and written. In each round the runs of a group of
``fan_in`` exchange their rows and are merged into one run. A merge is a sort of pieces that are sorted already
and a sort aggregate over it, never a hash table, first within each task and then between them: per digest only
the keeper's id and the count go on, so a group of copies is one row per run before it meets the others. A
group's rows are dealt by (run, digest), so no task holds a whole run.

Every merge verifies: rows of one SHA-256 must agree in length and in a second, independent hash, or the job
stops. The ids and counts that leave a merge are made from that comparison, so no later step can leave it out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, named

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(text: Column) -> Column:
    """The text by which documents are equal: A-Z lower-cased, null as empty."""
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def digest(text: Column) -> Column:
    return F.sha2(normal(text).cast("binary"), 256)


def marked(text: Column) -> Column:
    """What must be equal for texts of one digest: the length in bytes and a hash of another kind."""
    t = normal(text)
    return F.struct(F.octet_length(t).cast("long").alias("bytes"), F.xxhash64(t).alias("hash"))


def merged(rows: DataFrame, keep: str) -> DataFrame:
    """One row per run and digest. rows: run, text_sha256, mark, keep_id, group_size. Least and greatest marks are
    structs, which Spark aggregates over sorted rows only: this is the merge of the sorted pieces."""
    pick = {"min": F.min, "max": F.max}[keep]
    met = rows.groupBy("run", "text_sha256").agg(pick("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"), F.min("mark").alias("mark"), F.max("mark").alias("other"))

    def verified(c: str) -> Column:
        return F.when(F.col("mark") == F.col("other"), F.col(c)).otherwise(F.raise_error(F.lit("two texts share a digest")).cast(met.schema[c].dataType)).alias(c)

    return met.select("run", "text_sha256", "mark", verified("keep_id"), verified("group_size"))


def merge_digest_runs(rows: DataFrame, runs: int, id_col: str, keep: str, fan_in: int) -> DataFrame:
    """rows: run, text_sha256, mark and the id. One row per digest: text_sha256, keep_id, group_size."""
    level = rows.select("run", "text_sha256", "mark", named(id_col).alias("keep_id"), F.lit(1).cast("long").alias("group_size"))
    while True:
        level = merged(level.withColumn("run", F.expr(f"run div {fan_in}")), keep)
        runs = -(-runs // fan_in)
        if runs <= 1:
            return level.select("text_sha256", "keep_id", "group_size")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min", fan_in: int = 32) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. keep says
    whether the smallest or the largest id of a group stays. Rows without an id never stay while their
    group has an id; in a group without any, all stay (keep_id null). Rows that repeat an id and a text
    are one document: they count in group_size and share ``kept``. Other columns are not read."""
    scratch = Scratch(docs.sparkSession, "exact")
    rows = docs.select(named(id_col), digest(named(text_col)).alias("text_sha256"), marked(named(text_col)).alias("mark"), F.spark_partition_id().cast("long").alias("run"))
    rows = scratch.save(rows.sortWithinPartitions("text_sha256", named(id_col)), "rows")
    runs = (rows.agg(F.max("run")).first()[0] or 0) + 1
    groups = merge_digest_runs(rows, runs, id_col, keep, fan_in)
    return rows.join(groups, "text_sha256").select(named(id_col), "keep_id", "group_size", named(id_col).eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")
