"""The store: log, runs and manifest in one folder."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import INVALID, applied, key_status, value_status
from ..operators import log as logs
from ..operators import read, runs
from ..operators.manifest import Files, Manifest
from ..schema import LOG, PUT, RUN, Options
from ..sources.tables import load_data


class InvalidArgument(ValueError):
    pass


class NotFound(KeyError):
    pass


class Engine:
    """One writer. Every batch is a segment of the log, named by its first sequence; what isn't flushed
    is read from the log, the rest from the manifest's runs. Opening a folder again recovers it. Sequences
    have no gaps and no repeats, which ``verify`` checks, so reads of the log need no running maximum. A write that leaves more
    than flush_bytes unflushed flushes; a flush compacts once there are too many runs, and cleans."""

    def __init__(self, spark: SparkSession, options: Options | str):
        self.spark = spark
        self.options = options if isinstance(options, Options) else Options(options)
        self.files = Files(spark, self.options.base)
        self.manifest = Manifest.load(self.files, self.options.manifests)
        self._sync()

    def _segments(self) -> list[tuple[int, str]]:
        """First sequence and name. A name whose number can't be read is an error."""
        return sorted((int(n[4:-4]), n) for n, _ in self.files.names(self.options.log) if n.startswith("wal-") and n.endswith(".log"))

    def _fresh_segments(self) -> list[str]:
        """Segments that hold something the runs don't: the next one begins above the first sequence to come."""
        all_ = self._segments()
        ends = [start - 1 for start, _ in all_[1:]] + [None]
        return [name for (_, name), end in zip(all_, ends) if end is None or end > self.manifest.applied_until]

    def _sync(self) -> None:
        """The last sequence in use; sequences start at 1 and are never used twice. The last segment has it."""
        last = [name for _, name in self._segments()[-1:]]
        top = self._log(last).agg(F.max("seq")).first()[0] if last else None
        self.seq = max(top or 0, self.manifest.applied_until)
        self.unflushed = self._size(self.delta()) if self.seq > self.manifest.applied_until else 0

    @staticmethod
    def _size(rows: DataFrame) -> int:
        return rows.agg(F.coalesce(F.sum(logs.record_size(F.col("key"), F.col("value"))), F.lit(0))).first()[0]

    def _read(self, schema: T.StructType, paths: list[str]) -> DataFrame:
        """Page checksums are verified and a broken file is an error, never skipped."""
        reader = self.spark.read.schema(schema).option("parquet.page.verify-checksum.enabled", "true").option("ignoreCorruptFiles", "false").option("ignoreMissingFiles", "false")
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _log(self, names: list[str]) -> DataFrame:
        return self._read(LOG, [f"{self.options.log}/{n}" for n in names])

    def log(self) -> DataFrame:
        return self._log([n for _, n in self._segments()])

    def verify(self) -> DataFrame:
        """Reads all of the log: one row per segment, or an error."""
        if not self._segments():
            return logs.verify(self.log().withColumn("start_seq", F.col("seq")))
        start = F.regexp_extract("_metadata.file_path", "/wal-([0-9]+)\\.log/", 1).cast("long")
        return logs.verify(self.log().select("*", start.alias("start_seq")))

    def delta(self) -> DataFrame:
        """Layer 0: what the log holds beyond the runs. Filters on key and seq reach the scan."""
        fresh = self._log(self._fresh_segments()).where((F.col("seq") > self.manifest.applied_until) & F.col("key").isNotNull())
        return fresh.select("key", "ts", "seq", applied(F.col("type"), F.col("value")).alias("value"))

    def runs(self, version: int | None = None) -> DataFrame:
        """All rows of the runs that the manifest names, or an earlier version of it that is still there."""
        at = self.manifest if version is None else Manifest.load(self.files, self.options.manifests, version)
        return self._read(RUN, [f"{self.options.runs}/{r['run']}" for r in at.runs])

    def blocks(self) -> DataFrame:
        if not self.manifest.runs:
            return self.spark.createDataFrame([], "run string, file string, first_byte long, records long, first_key string, last_key string")
        return runs.list_blocks(self.runs())

    def versions(self) -> DataFrame:
        """All versions of all layers, of one snapshot of the manifest; runs by their place in it."""
        rows = self.delta().withColumn("layer", F.lit(0)).withColumn("run", F.lit(0))
        for place, r in enumerate(self.manifest.runs):
            rows = rows.unionByName(self._read(RUN, [f"{self.options.runs}/{r['run']}"]).withColumn("layer", F.lit(2)).withColumn("run", F.lit(place)))
        return rows

    # --- writes

    def write(self, batch: DataFrame, strict: bool = True, tag: str | None = None) -> int:
        """batch: key, type, value and perhaps ts. Returns the last sequence. strict: a bad row fails the
        batch, else bad rows are left out. What is checked is what was written, so a source that changes can't let a bad
        row in. Nothing is visible before the segment is complete. A tag is committed with the segment: has_tag tells
        whether the batch got in. The segment's files hold about segment_bytes each."""
        if "ts" not in batch.columns:
            batch = batch.withColumn("ts", F.lit(time.time_ns() // 1000))
        bad = (key_status(F.col("key")) == INVALID) | (value_status(F.col("value")) == INVALID)
        order = ["ts", "key", "type", "value"]
        rows = batch.select("key", "type", "ts", F.col("value").cast("binary").alias("value"))
        placed = logs.placed(rows if strict else rows.where(~bad), order)
        n, size, wrong = placed.agg(F.count("*"), F.coalesce(F.sum(logs.record_size(F.col("key"), F.col("value"))), F.lit(0)), F.coalesce(F.max(bad), F.lit(False))).first()
        if wrong:
            raise InvalidArgument("a key or value is too long, or a key is empty")
        if not n:
            return self.seq
        path = f"{self.options.log}/wal-{self.seq + 1}.log"
        if any(s == self.seq + 1 for s, _ in self._segments()):
            raise FileExistsError(path)
        stage = f"{self.options.log}/_tmp-{uuid.uuid4().hex}"
        per_file = max(1, n * self.options.segment_bytes // max(size, 1))
        logs.numbered(self.seq, placed).select(*LOG.names).write.option("parquet.page.write-checksum.enabled", "true").option("maxRecordsPerFile", per_file).parquet(stage)
        if tag is not None:
            self.files.commit(f"{stage}/_tag-{tag}", "")
        try:
            self.files.move(stage, path)
        except FileExistsError:
            self.files.delete(stage)
            raise
        self.seq += n
        self.unflushed += size
        if self.unflushed > self.options.flush_bytes:
            self.flush(force=True)
        return self.seq

    def has_tag(self, tag: str) -> bool:
        return any(f"_tag-{tag}" == name for _, s in self._segments() for name, _ in self.files.names(f"{self.options.log}/{s}"))

    def _one(self, kind: str, key: str, value: bytes | None, ts: int | None) -> int:
        ts = time.time_ns() // 1000 if ts is None else ts
        self.write(self.spark.createDataFrame([(key, kind, ts, bytearray(value) if value is not None else None)], "key string, type string, ts long, value binary"))
        return ts

    def set(self, key: str, value: bytes, ts: int | None = None) -> int:
        return self._one(PUT, key, value, ts)

    def delete(self, key: str, ts: int | None = None) -> int:
        return self._one("DELETE", key, None, ts)

    def load_data(self, n: int = 1000, key_size: int = 10, value_size: int = 800, seed: int = 1) -> int:
        """Puts n synthetic records. Returns the last sequence."""
        return self.write(load_data(self.spark, n, key_size, value_size, seed).withColumn("type", F.lit(PUT)))

    # --- reads

    def get(self, key: str, layered: bool = True) -> tuple[int, bytes]:
        n = len(key.encode())
        if not 0 < n <= 4096:
            raise InvalidArgument(key[:40])
        rows = self.versions().where(F.col("key") == key)
        got = read.live(read.layered(rows) if layered else read.latest_version(rows)).select("ts", "value").take(1)
        if not got:
            raise NotFound(key)
        return got[0]["ts"], bytes(got[0]["value"])

    def multi_get(self, probes: DataFrame) -> DataFrame:
        return read.multi_get(self.versions(), probes, by_layer=True)

    def view(self, as_of: int | None = None) -> DataFrame:
        v = self.versions()
        return read.live(read.layered(v) if as_of is None else read.as_of(v, as_of)).select("key", "ts", "value")

    # --- maintenance

    def flush(self, force: bool = False) -> bool:
        """Writes the delta as a run once it is large enough, and commits it; then compacts if that is due, and cleans."""
        if not force and self.unflushed <= self.options.flush_bytes:
            return False
        fresh = self.delta()
        n, top = fresh.agg(F.count("*"), F.max("seq")).first()
        if not n:
            return False
        self._commit(fresh, n, [], top)
        self.unflushed = 0
        self.compact()
        self.clean()
        return True

    def _commit(self, rows: DataFrame, n: int, replaced: list[dict], applied_until: int) -> None:
        name = f"{applied_until:020d}-{uuid.uuid4().hex[:8]}.sst"
        runs.write_run(rows, f"{self.options.runs}/{name}", max(1, -(-n // self.options.rows_per_run_file)), self.options.bloom_keys)
        stay = [r for r in self.manifest.runs if r not in replaced]
        new = Manifest(self.manifest.version, [*stay, {"run": name, "applied_until": applied_until}])
        new.save(self.files, self.options.manifests)
        self.manifest = new

    def compact(self, force: bool = False, drop_old: bool = False) -> bool:
        """All runs into one when there are too many."""
        old = self.manifest.runs
        if len(old) < 2 or not force and len(old) <= self.options.compact_above:
            return False
        merged = self.runs()
        self._commit(read.live_view(merged) if drop_old else merged, merged.count(), old, self.manifest.applied_until)
        return True

    @contextlib.contextmanager
    def hold(self) -> Iterator[None]:
        """What the manifest names now, and the log, stays on disk until the block ends, however long it takes; a hold whose
        process died counts for hold_s."""
        path = f"{self.options.holds}/{uuid.uuid4().hex}"
        self.files.commit(path, json.dumps([*(r["run"] for r in self.manifest.runs), *(n for _, n in self._segments())]))
        try:
            yield
        finally:
            self.files.delete(path)

    def clean(self, age_s: int | None = None) -> list[str]:
        """Deletes runs that the manifest doesn't name and segments that are applied, once they are old enough and where
        no hold names them."""
        age = self.options.orphan_age_s if age_s is None else age_s
        now, gone = time.time(), []
        keep = {r["run"] for r in self.manifest.runs}
        for name, changed in self.files.names(self.options.holds):
            if now - changed < self.options.hold_s and not name.endswith(".tmp"):
                keep |= set(json.loads(self.files.read(f"{self.options.holds}/{name}")))
        for name, changed in self.files.names(self.options.runs):
            if name.endswith(".sst") and name not in keep and now - changed >= age:
                gone.append(f"{self.options.runs}/{name}")
        segments, changed = self._segments(), dict(self.files.names(self.options.log))
        for (_, name), (following, _) in zip(segments, segments[1:]):
            if following <= self.manifest.applied_until and name not in keep and now - changed[name] >= age:
                gone.append(f"{self.options.log}/{name}")
        for path in gone:
            self.files.delete(path)
        return gone


__all__ = ["Engine", "InvalidArgument", "NotFound", "applied"]
