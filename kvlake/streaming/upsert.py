"""Streams of mutations into the store, and the newest version of each key as a stream."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine


def upsert(stream: DataFrame, engine: Engine, checkpoint: str, flush: bool = True) -> StreamingQuery:
    """stream: key, type, ts, value. Every micro-batch is one group commit: one segment of the log. A batch
    that comes again after a failure is told by its number, kept beside the log, or by the tag that its
    segment was committed with, and dropped. Only the first batch after a start can come again."""
    files, marks = engine.files, f"{checkpoint}/applied"
    name, started = hashlib.sha256(checkpoint.encode()).hexdigest()[:16], []

    def write(batch: DataFrame, number: int) -> None:
        if any(name == str(number) for name, _ in files.names(marks)):
            return
        tag = f"{name}-{number}"
        if started or not engine.has_tag(tag):
            engine.write(batch, strict=False, tag=tag)
        started.append(number)
        del started[:-1]
        files.commit(f"{marks}/{number}", str(engine.seq))
        if flush:
            engine.flush()
            engine.compact()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{checkpoint}/stream").trigger(availableNow=True).start()


def newest(stream: DataFrame) -> DataFrame:
    """The newest version of each key so far, for complete or update mode."""
    return stream.groupBy("key").agg(F.max_by(F.struct("ts", "seq", "value"), F.struct("ts", "seq")).alias("v")).select("key", "v.*")
