"""What the operators of this subpackage share: words, hashes, scratch tables."""

from __future__ import annotations

import atexit
import contextlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: A word, in Java's, RE2's and Python's syntax alike.
WORD = r"[^\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def settings(spark: SparkSession, *on: str, off: tuple[str, ...] = ()) -> Iterator[None]:
    """Settings of the session that are true, or false, within the block, and after it what they were before."""
    before = {k: spark.conf.get(k) for k in (*on, *off)}
    try:
        for k in before:
            spark.conf.set(k, "true" if k in on else "false")
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


_OPEN: list[list[Scratch]] = []


class Scratch:
    """Written tables in the shared folder. They cut lineage and survive lost executors.

    ``save`` writes a table and returns it as read back; its shuffle files go as soon as it is
    written. ``drop`` removes tables, ``end`` all of them. What is left goes at the end of the surrounding
    ``passing`` block, or when the driver's Python ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.base = spark, f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
        if _OPEN:
            _OPEN[-1].append(self)
        else:
            atexit.register(self._quietly)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        with settings(self.spark, CLEANUP):
            df.write.mode("overwrite").parquet(f"{self.base}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.base}/{name}")

    def drop(self, *names: str) -> None:
        for name in names:
            self._remove(f"{self.base}/{name}")

    def end(self) -> None:
        self._remove(self.base)

    def _remove(self, path: str) -> None:
        jvm, conf = self.spark._jvm, self.spark._jsparkSession.sessionState().newHadoopConf()
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)

    def _quietly(self) -> None:
        with contextlib.suppress(Exception):  # the JVM may be gone by now
            self.end()


@contextlib.contextmanager
def passing() -> Iterator[None]:
    """The tables that operators write within the block go when it ends, also by an error. What the block returns must
    be written elsewhere by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for scratch in _OPEN.pop():
            scratch.end()


def named(column: str) -> Column:
    """The column of that very name, whatever characters it has."""
    return F.col("`" + column.replace("`", "``") + "`")


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of counts (a written table) whose n is above some number, the least one that leaves ``most`` rows at most:
    equal counts go or stay together. One row for each distinct n reaches the driver."""
    many = counts.groupBy("n").agg(F.count("*").alias("rows")).toPandas().sort_values("n", ascending=False)
    over = many["n"][many["rows"].cumsum() > most]
    return counts.where(F.col("n") > int(over.iloc[0] if len(over) else 0))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def split_join(rows: DataFrame, grouped: DataFrame, key: str) -> DataFrame:
    """rows joined with an aggregate of them by the same key. With the key's hash as a second key the
    aggregate is dealt once more, both sides come from exchanges of the join's own, and adaptive
    execution can split the partition of a hot key."""
    a, b = rows.withColumn("__h", F.xxhash64(key)), grouped.withColumn("__h", F.xxhash64(key))
    return a.join(b, [key, "__h"]).drop("__h")


# --- words and hashes of many texts at once, in numpy ---------------------------------------

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_P = 0x9E3779B97F4A7C15 | 1
_PINV = pow(_P, -1, 2**64)
_POWERS = np.array([1, 1], np.uint64), np.array([1, 1], np.uint64)


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((seed * 0xD1B54A32D192ED03 + 0x8CB92BA72F3D8DD7) % 2**64)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
        return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POWERS
    if len(_POWERS[0]) < n:
        size = 1 << (n - 1).bit_length()
        made = []
        for base in (_P, _PINV):
            x = np.full(size, np.uint64(base), np.uint64)
            x[0] = 1
            with np.errstate(over="ignore"):
                made.append(np.multiply.accumulate(x))
        _POWERS = made[0], made[1]
    return _POWERS[0][:n], _POWERS[1][:n]


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False, stride: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
    """data: the UTF-8 bytes of texts end to end; offsets: where each begins, and the end.
    Returns a 64-bit hash of each word and, for each text, where its words begin (and the end).
    Works through the bytes in strides that end between words, so a huge text needs no huge arrays."""
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    first[inner] = inside[inner]  # a word never goes on into the next text
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    hashes = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(ends, starts[at] + stride, "right")))
        lo, hi = starts[at], ends[to - 1]
        up, down = _powers(int(hi - lo) + 1)
        s, e = starts[at:to] - lo, ends[at:to] - lo
        piece = data[lo:hi]
        with np.errstate(over="ignore"):
            sums = np.empty(hi - lo + 1, np.uint64)
            sums[0] = 0
            np.cumsum(((_LOWER[piece] if lower else piece).astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
            hashes[at:to] = mix((sums[e] - sums[s]) * down[s] ^ mix((e - s).astype(np.uint64), 7), 3)
        at = to
    return hashes, np.searchsorted(starts, offsets)


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cuts a batch into runs of whole texts of about ``most`` bytes (one text at least):
    first row, end row, bytes end to end, offsets into them. A null text has no bytes."""
    col = batch.column(batch.schema.get_field_index(column))
    if pa.types.is_large_string(col.type):
        col = col.cast(pa.string())
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if not n:
        return
    buffers = col.buffers()
    at = np.frombuffer(buffers[1], np.int32, n + 1, col.offset * 4).astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end, data[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end
