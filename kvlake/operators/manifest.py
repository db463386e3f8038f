"""Manifest rows as DataFrames, and manifest files committed by an atomic rename."""

from __future__ import annotations

import json
import uuid
import zlib
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import number_in


def max_applied(runs: DataFrame) -> DataFrame:
    return runs.agg(F.coalesce(F.max("applied_until"), F.lit(0)).cast("long").alias("applied_until"))


def latest_manifest(names: DataFrame) -> DataFrame:
    """The name with the highest number, compared as a number. A number that can't be read is an error."""
    n = names.select("name", number_in(F.col("name"), "descriptor.").alias("version")).where("version is not null")
    return n.agg(F.max_by("name", "version").alias("name"), F.max("version").alias("version"))


def rewrite(runs: DataFrame, compacted: DataFrame, new_run: int) -> DataFrame:
    """Runs that weren't compacted, and the new one, applied as far as the furthest of the compacted."""
    gone = F.broadcast(compacted.select("run").distinct()) if compacted.limit(100_001).count() <= 100_000 else compacted.select("run").distinct()
    stay = runs.join(gone, "run", "left_anti").select("run", "applied_until")
    made = runs.join(gone, "run", "left_semi").agg(F.lit(new_run).cast("long").alias("run"), F.max("applied_until").alias("applied_until"))
    return stay.unionByName(made.where("applied_until is not null"))


def orphans(on_disk: DataFrame, live: DataFrame, name: str = "filename") -> DataFrame:
    """Files that no live set names."""
    return on_disk.select(name).distinct().join(live.select(name), name, "left_anti")


class Files:
    """The file operations that manifests need, on any file system that Spark reads."""

    def __init__(self, spark: SparkSession, base: str):
        self.gateway, self.jvm = spark.sparkContext._gateway, spark._jvm
        self.conf = spark._jsparkSession.sessionState().newHadoopConf()
        self.fs = self._path(base).getFileSystem(self.conf)

    def _path(self, p: str):
        return self.jvm.org.apache.hadoop.fs.Path(p)

    def names(self, folder: str) -> list[tuple[str, int]]:
        """Names and times of change in seconds."""
        if not self.fs.exists(self._path(folder)):
            return []
        return sorted((s.getPath().getName(), s.getModificationTime() // 1000) for s in self.fs.listStatus(self._path(folder)))

    def read(self, path: str) -> str:
        s = self.fs.open(self._path(path))
        try:
            return bytes(self.jvm.org.apache.commons.io.IOUtils.toByteArray(s)).decode()
        finally:
            s.close()

    def move(self, source: str, target: str) -> None:
        """One rename; a target that exists is an error, and never moved into, whoever made it and when."""
        kind = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        never = self.gateway.new_array(kind, 1)
        never[0] = kind.NONE
        where = self.fs.makeQualified(self._path(target))
        try:
            self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), self.conf).rename(self.fs.makeQualified(self._path(source)), where, never)
        except Py4JJavaError as e:
            if "FileAlreadyExists" in str(e.java_exception):
                raise FileExistsError(target) from None
            raise

    def commit(self, path: str, text: str) -> None:
        """Writes beside, then renames; a path that exists is an error."""
        tmp = f"{path}.{uuid.uuid4().hex[:8]}.tmp"
        s = self.fs.create(self._path(tmp), True)
        s.write(bytearray(text.encode()))
        s.close()
        try:
            self.move(tmp, path)
        except FileExistsError:
            self.delete(tmp)
            raise

    def delete(self, path: str) -> None:
        self.fs.delete(self._path(path), True)


@dataclass
class Manifest:
    version: int = 0
    runs: list[dict] = field(default_factory=list)  # run, applied_until

    @property
    def applied_until(self) -> int:
        return max((r["applied_until"] for r in self.runs), default=0)

    @staticmethod
    def load(files: Files, folder: str, version: int | None = None) -> Manifest:
        """Of the given or the highest version; none yet: empty. A name whose number can't be read is an
        error, and so are a version that isn't there and a file whose length or checksum is not the one it begins with."""
        found = []
        for name, _ in files.names(folder):
            if name.startswith("descriptor.") and not name.endswith(".tmp"):
                found.append(int(name.removeprefix("descriptor.")))
        if version is not None and version not in found:
            raise FileNotFoundError(f"{folder}/descriptor.{version}")
        if not found:
            return Manifest()
        version = max(found) if version is None else version
        path = f"{folder}/descriptor.{version}"
        head, _, data = files.read(path).partition("\n")
        try:
            want = json.loads(head)
            whole = want == {"length": len(data.encode()), "crc32": zlib.crc32(data.encode())}
        except ValueError:
            whole = False
        if not whole:
            raise ValueError(f"{path} is damaged")
        return Manifest(version, json.loads(data))

    def rows(self, spark: SparkSession) -> DataFrame:
        """version, place, run, applied_until: a row per run."""
        return spark.createDataFrame([(self.version, i, r["run"], r["applied_until"]) for i, r in enumerate(self.runs)], "version long, place int, run string, applied_until long")

    def save(self, files: Files, folder: str) -> None:
        data = json.dumps(self.runs)
        files.commit(f"{folder}/descriptor.{self.version + 1}", json.dumps({"length": len(data.encode()), "crc32": zlib.crc32(data.encode())}) + "\n" + data)
        self.version += 1
        files.delete(f"{folder}/descriptor.{self.version - 2}")
