"""Sharding by sampled splitters, in DataFrame operations only.

Records have a total order: 60 bits of the text's MD5, then id. A size-weighted sample of the keys gives
splitters that cut the order into ranges of about equal bytes; a range that turns out overfull is
sampled anew, more densely, and subdivided. The ranges' exact counts (a bounded number of rows) give
each range its place in the whole order, and a window inside each range gives each record its exact
place, so shards are cut at exact quantiles of the bytes and no window ever spans more than a range.
Equal texts are neighbours in the order. A group of them that is no larger than the largest record goes whole to
the shard that its first byte falls in; only larger groups are parted, each boundary parting one at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, named


def _range_of(splitters: list[tuple], key: Column, ident: Column) -> Column:
    """The number of splitters at or before (key, ident), by a balanced tree of comparisons. A splitter without an ident
    comes before all of its key."""

    def tree(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        k, i = splitters[mid]
        before = key < F.lit(k)
        if i is not None:
            before = before | ((key == F.lit(k)) & (ident.isNull() | (ident < F.lit(i))))
        return F.when(before, tree(lo, mid)).otherwise(tree(mid + 1, hi))

    return tree(0, len(splitters))


def _draw(rows: DataFrame, total: int, ranges: int, per_range: int, salt: int, within: bool) -> list[tuple]:
    """At most about ranges * per_range rows are sampled, with a chance in proportion to their size;
    the sample's quantiles by weight are the splitters. Only ``within`` do they part rows of one key."""
    want = ranges * per_range
    chance = F.least(F.lit(1.0), F.col("size") * (want / max(total, 1)))
    u = F.shiftrightunsigned(F.xxhash64("key", "ident", F.lit(salt)), 11) / float(2**53)
    sample = rows.where(u < chance).select("key", "ident", (F.col("size") / chance).alias("w"))
    order = Window.orderBy("key", F.col("ident").asc_nulls_first())
    step = F.lit(max(total, 1) / ranges)
    cut = sample.withColumn("c", F.sum("w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    cut = cut.where(F.floor(F.col("c") / step) > F.floor((F.col("c") - F.col("w")) / step))
    drawn = cut.select("key", F.col("ident") if within else F.lit(None).alias("ident")).distinct().collect()
    return _sorted({(r["key"], r["ident"]) for r in drawn})


def _sorted(splitters: set[tuple]) -> list[tuple]:
    return sorted(splitters, key=lambda x: (x[0], x[1] is not None, x[1] if x[1] is not None else 0))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = 256 << 20, per_range: int = 32, max_ranges: int = 1024) -> DataFrame:
    """One row per input row: id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Size: UTF-8 bytes of the text (null: none) plus 1. Shards hold near equal sizes: a shard's bytes
    differ from the mean by two records' at most. slot is the record's place in its shard, from 0
    without gaps. Records with equal text and id are interchangeable; null ids come first among equal
    texts. The driver sees at most 4 * max_ranges splitters and counts. An empty table gives none."""
    scratch = Scratch(docs.sparkSession, "shard")
    text = F.coalesce(named(text_col), F.lit(""))
    rows = docs.select(
        named(id_col).alias("ident"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long").alias("key"),
    )
    rows = scratch.save(rows, "rows")
    total, largest = (x or 0 for x in rows.agg(F.sum("size"), F.max("size")).first())
    ranges = int(min(max_ranges, max(8 * shards, -(-total // range_bytes))))
    splitters = _draw(rows, total, ranges, per_range, 0, False)
    ideal = total / ranges
    for again in range(1, 5):
        rid = _range_of(splitters, F.col("key"), F.col("ident"))
        counts = {r["rid"]: r for r in rows.groupBy(rid.alias("rid")).agg(F.count("*").alias("n"), F.sum("size").alias("b")).collect()}
        over = {k: r for k, r in counts.items() if r["b"] > 2 * ideal and r["n"] > 1}
        if not over or len(splitters) > 3 * max_ranges or again == 4:
            break
        heavy = rows.where(rid.isin(*over))
        size = sum(r["b"] for r in over.values())
        more = _draw(heavy, size, max(2, round(2 * size / max(ideal, 1))), 2 * per_range, again, True)
        drawn = docs.sparkSession.createDataFrame([(k,) for k in {k for k, _ in more}], "key long")
        parted = {r["key"] for r in rows.join(F.broadcast(drawn), "key").groupBy("key").agg(F.sum("size").alias("b")).where(F.col("b") > largest).collect()}
        more, known = {(k, i if k in parted else None) for k, i in more}, set(splitters)
        if not (new := [x for x in more if x not in known]):
            break
        splitters = _sorted({*splitters, *new})
    bytes_before, rows_before, b, n = [], [], 0, 0
    for k in range(len(splitters) + 1):
        bytes_before.append(b)
        rows_before.append(n)
        b, n = b + (counts[k]["b"] if k in counts else 0), n + (counts[k]["n"] if k in counts else 0)

    def at(values: list[int], index: Column) -> Column:
        return F.element_at(F.array(*[F.lit(int(v)).cast("long") for v in values]), index + 1)

    inside, group = Window.partitionBy("rid").orderBy("key", F.col("ident").asc_nulls_first()), Window.partitionBy("rid", "key")
    parted = F.col("key").isin([k for k, i in splitters if i is not None])  # a range may end within their groups, larger than any record
    placed = rows.withColumn("rid", _range_of(splitters, F.col("key"), F.col("ident"))).select(
        "ident",
        "size",
        "text_crc32",
        "rid",
        "key",
        (at(bytes_before, F.col("rid")) + F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")).alias("byte_place"),
        (at(rows_before, F.col("rid")) + F.row_number().over(inside) - 1).alias("place"),
    )
    whole = (F.sum("size").over(group) <= largest) & ~parted
    placed = placed.withColumn("byte_place", F.when(whole, F.min("byte_place").over(group)).otherwise(F.col("byte_place")))
    placed = placed.select("ident", "size", "text_crc32", "place", F.expr(f"cast(least({shards - 1}, byte_place * {shards} div {max(total, 1)}) as int)").alias("shard"))
    placed = scratch.save(placed, "placed")
    first = {r["shard"]: r["p"] for r in placed.groupBy("shard").agg(F.min("place").alias("p")).collect()}
    return placed.select(
        F.col("ident").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("place") - at([first.get(s, 0) for s in range(shards)], F.col("shard"))).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
