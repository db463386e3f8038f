"""Exact top-k search over binary codes by incremental multi-index hashing.

A code is the signs of a vector, cut into segments. Two codes that differ in d bits agree in some
segment up to d // segments bits, so probing every segment with all values within a radius r finds all
codes up to distance segments * (r + 1) - 1. A search starts at radius 0 and grows it until its k-th
verified distance is covered. Equal codes are one entry that carries its k smallest ids, so a very common
vector costs one entry, not one for each copy.

Entries and queries are dealt out in blocks of bounded size; each pair of an entry block and a query block
is searched by itself, with an index of its entries in numpy, and gives k results a query at most. The
results of a query's blocks are merged by Spark.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, named, parts


def codes(vectors: DataFrame, id_col: str, vector_col: str, bits: int, width: int, segments: int) -> DataFrame:
    """id and segs: the segments' values, ``width`` bits each: one for each of the first ``bits`` places that is over 0.
    Rows without a vector are left out; places a vector lacks, nulls and NaN count as 0."""

    def segment(s: int) -> F.Column:
        value = F.lit(0).cast("long")
        for j in range(min(width, bits - s * width)):
            x = F.get(named(vector_col), F.lit(s * width + j))
            value = value + F.when((x > 0) & ~F.isnan(x), F.lit(1 << j)).otherwise(F.lit(0))
        return value

    return vectors.where(named(vector_col).isNotNull() & named(id_col).isNotNull()).select(named(id_col).alias("id"), F.array(*[segment(s) for s in range(segments)]).alias("segs"))


def flips(width: int, radius: int) -> np.ndarray:
    """The masks of exactly ``radius`` bits."""
    return np.array([sum(1 << b for b in bs) for bs in itertools.combinations(range(width), radius)], np.int64)


class MultiIndex:
    """Segment tables of a block of codes (a row of segment values each)."""

    def __init__(self, segs: np.ndarray, width: int):
        self.segs, self.width, self.masks = segs, width, {}
        self.order = [np.argsort(col, kind="stable") for col in segs.T]
        self.first = [np.searchsorted(col[o], np.arange((1 << width) + 1)) for col, o in zip(segs.T, self.order)]

    def search(self, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Entries and distances: at least the k nearest (ties included), all if there are no more."""
        n, m = self.segs.shape
        seen, found, dist = np.zeros(n, bool), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for radius in range(self.width + 1):
            if radius not in self.masks:
                self.masks[radius] = flips(self.width, radius)
            if len(self.masks[radius]) * m > n:  # more probes than entries: look at all the rest
                new, covered = np.flatnonzero(~seen), m * self.width
            else:
                hits = []
                for s in range(m):
                    at = q[s] ^ self.masks[radius]
                    lo, size = self.first[s][at], self.first[s][at + 1] - self.first[s][at]
                    ends = np.cumsum(size)
                    hits.append(self.order[s][np.repeat(lo - ends + size, size) + np.arange(ends[-1])])
                new = np.unique(np.concatenate(hits))
                new, covered = new[~seen[new]], m * (radius + 1) - 1
            seen[new] = True
            found = np.concatenate([found, new])
            dist = np.concatenate([dist, np.bitwise_count(self.segs[new] ^ q).sum(axis=1, dtype=np.int64)])
            if len(found) == n or len(found) >= k and np.partition(dist, k - 1)[k - 1] <= covered:
                break
        if len(found) > k:
            near = dist <= np.partition(dist, k - 1)[k - 1]
            found, dist = found[near], dist[near]
        return found, dist


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", bits: int | None = None, segments: int | None = None, entry_block: int | None = None, query_block: int = 1 << 14) -> DataFrame:
    """For each query its k nearest rows: query_id, rank (from 1), id, distance (bits that differ).

    Ties go to the smaller id; a query that is itself a row finds itself. Fewer rows than k give fewer
    results. Rows and queries without a vector or an id are left out; repeated ids count once per code.
    Queries with equal codes are searched for once. bits: the places that count, without it all that any vector
    has. Segments are bits / segments wide, 16 at most; without segments their width is next to the logarithm of the number
    of rows, at which a segment's value finds about one row by chance. Other columns are not read."""
    if bits is None:
        bits = max([1, *(f.agg(F.max(F.size(named(vector_col)))).first()[0] or 0 for f in (vectors, queries))])
    width = min(16, max(1, round(math.log2(max(2, vectors.count()))))) if segments is None else -(-bits // segments)
    if width > 16:
        raise ValueError("segments are 16 bits wide at most")
    segments, spark = segments or -(-bits // width), vectors.sparkSession
    s = Scratch(spark, "topk")
    rows = s.save(codes(vectors, id_col, vector_col, bits, width, segments).distinct(), "rows")
    # the k smallest ids of each code: first per salt, so that a code with a third of all rows is never in one task
    salted = Window.partitionBy("segs", F.pmod(F.xxhash64("id"), F.lit(64))).orderBy("id")
    few = rows.withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k)
    whole = Window.partitionBy("segs").orderBy("id")
    few = few.select("segs", "id").withColumn("r", F.row_number().over(whole)).where(F.col("r") <= k)
    entries = s.save(few.groupBy("segs").agg(F.sort_array(F.collect_list("id")).alias("ids")), "entries")
    asked = s.save(codes(queries, id_col, vector_col, bits, width, segments).distinct(), "asked")
    each = s.save(asked.select(F.col("segs").alias("q")).distinct(), "each")
    n, m = entries.count(), each.count()
    entry_block = entry_block or min(1 << 20, max(1 << 14, n // (4 * parts(spark))))
    e, q = max(1, -(-n // entry_block)), max(1, -(-m // query_block))
    dealt = entries.select("segs", "ids", F.pmod(F.xxhash64("segs"), F.lit(e)).alias("e"), F.explode(F.sequence(F.lit(0), F.lit(q - 1))).alias("b"))
    asking = each.select("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(e - 1).cast("long"))).alias("e"), F.pmod(F.xxhash64("q"), F.lit(q)).cast("int").alias("b"))

    def matrix(table: pa.Table, name: str) -> np.ndarray:
        return np.array(table.column(name).to_pylist(), np.int64).reshape(-1, segments)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if left.num_rows and right.num_rows:
            index, ids = MultiIndex(matrix(left, "segs"), width), left.column("ids").to_pylist()
            for code in matrix(right, "q"):
                found, dist = index.search(code, k)
                best = sorted((d, i) for f, d in zip(found.tolist(), dist.tolist()) for i in ids[f])[:k]
                out += [(code.tolist(), d, i) for d, i in best]
        return pa.table([pa.array([x[0] for x in out], pa.list_(pa.int64())), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], left.schema.field("ids").type.value_type)], names=["q", "distance", "near"])

    kind = rows.schema["id"].dataType.simpleString()
    found = dealt.groupBy("e", "b").cogroup(asking.groupBy("e", "b")).applyInArrow(search, f"q array<long>, distance int, near {kind}")
    order = Window.partitionBy("q").orderBy("distance", "near")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return asked.join(best.withColumnRenamed("q", "segs"), "segs").select(F.col("id").alias("query_id"), "rank", F.col("near").alias(id_col), "distance")
