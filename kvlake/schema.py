"""Types, limits and options of the key-value model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

# Limits in bytes, the mutation types, sizes at which files are cut.
MAX_KEY, MAX_VALUE = 4096, 512 << 10
UNSPECIFIED, PUT, DELETE = "UNSPECIFIED", "PUT", "DELETE"
RESTART = 16
PAGE_ROWS = 1_000  # of a page of a run; not a fixed value
COMPACT_ABOVE = 8

RECORD = T.StructType([T.StructField("key", T.StringType(), False), T.StructField("ts", T.LongType(), False), T.StructField("value", T.BinaryType())])
LOG = T.StructType([T.StructField("seq", T.LongType()), T.StructField("key", T.StringType()), T.StructField("type", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("value", T.BinaryType())])
RUN = T.StructType([T.StructField("key", T.StringType()), T.StructField("ts", T.LongType()), T.StructField("seq", T.LongType()), T.StructField("value", T.BinaryType())])


@dataclass(frozen=True)
class Options:
    """flush_bytes: unflushed records above which a write flushes; segment_bytes: of records in one file of a segment, about;
    compact_above: runs above which a flush compacts; orphan_age_s: before which nothing is deleted; hold_s: how long a
    hold that was never released keeps its files."""

    base: str
    flush_bytes: int = 16 << 20
    segment_bytes: int = 8 << 20
    compact_above: int = COMPACT_ABOVE
    rows_per_run_file: int = 5_000_000
    bloom_keys: int = 1_000_000
    orphan_age_s: int = 300
    hold_s: int = 86_400

    @property
    def runs(self) -> str:
        return f"{self.base}/runs"

    @property
    def log(self) -> str:
        return f"{self.base}/log"

    @property
    def holds(self) -> str:
        return f"{self.base}/holds"

    @property
    def manifests(self) -> str:
        return f"{self.base}/manifest"
