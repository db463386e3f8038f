"""Substring deduplication with a log-structured fingerprint index.

Documents come in batches, in the order of their ids. A batch's fingerprints are the hashes of those ``gram``-word
windows that are least among the neighbours that fit in one ``window`` (winnowing), so that equal windows always
share one, at the same place. They are an immutable run: dealt by the hash of the fingerprint into ``buckets`` files and
sorted in each. A new run is merge-joined with itself and with each run of earlier batches, file by file: history is
read in order and never shuffled. Where a fingerprint occurs twice, the whole windows around it are read again from the
texts (which lie in buckets by id, so they aren't shuffled either) and compared by 128 bits, two hashes made with seeds of
their own over the words' 64-bit hashes; the earliest of equal ones is found, and every later one marks its words. When
there are more than ``fan`` runs they are compacted into one, without the fingerprints whose windows all start earlier
elsewhere: compacted history holds each passage once.

The index is a folder with a manifest of versions: it outlives the query, and opened again it takes the next batch. What
a batch that failed has left is not in the manifest.

No fingerprint or window is gathered in one task however common it is. Fingerprints with more than half a bucket's share
of a run are found in a sample of texts (what it misses costs balance, never results), are dealt out by id as well, and are
joined by broadcast; there are 3 for each bucket at most. Of equal windows in one block of texts only the first goes on.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.manifest import Files
from .common import CLEANUP, Scratch, mix, named, parts, settings, text_slices, word_hashes

SALTS = 32
#: Joins of tables that lie in buckets by some of their keys need no shuffle, and no sort where each bucket is one sorted file.
IN_BUCKETS = ("spark.sql.sources.bucketing.enabled", "spark.sql.legacy.bucketedTableScan.outputOrdering")


def _rolled(words: np.ndarray, width: int, seed: int) -> np.ndarray:
    """The hash of every ``width`` consecutive words, in log(width) steps."""
    have, h, n = 1, mix(words, seed), len(words)
    with np.errstate(over="ignore"):
        while have < width:
            step = min(have, width - have)
            m = n - have - step + 1
            if m <= 0:
                return np.zeros(0, np.uint64)
            h = mix(h[:m] * np.uint64(0x9E3779B97F4A7C15) + h[step : step + m] + np.uint64(step), seed + have)
            have += step
    return h


def choices(grams: np.ndarray, span: int) -> np.ndarray:
    """For each window of ``span`` grams, the place of its least gram (the first of equals)."""
    n = len(grams) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at, have = grams, np.arange(len(grams)), 1
    while have < span:
        step = min(have, span - have)
        m = len(best) - step
        right = best[step:] < best[:m]
        best, at, have = np.where(right, best[step:], best[:m]), np.where(right, at[step:], at[:m]), have + step
    return at


def _each(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, np.ndarray]]:
    """Row and word hashes of each text."""
    for row, _, data, at in text_slices(batch, column):
        words, first = word_hashes(data, at)
        for i in range(len(first) - 1):
            yield row + i, words[first[i] : first[i + 1]]


def _kept(words: list[bytes], at: np.ndarray | None, window: int) -> tuple[int, int, bytes]:
    n = len(words)
    if at is None:
        return n, 0, b" ".join(words)
    gone = np.zeros(n + 1, np.int64)
    np.add.at(gone, at, 1)
    np.add.at(gone, np.minimum(at + window, n), -1)
    keep = np.cumsum(gone[:n]) == 0
    kept = [w for w, k in zip(words, keep.tolist()) if k]
    return n, n - len(kept), b" ".join(kept)


def fingerprints(docs: DataFrame, kind: str, window: int, gram: int) -> DataFrame:
    """fp, id, pos: the chosen places of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, places, hashes, held = [], [], [], 0
            for row, words in _each(batch, "text"):
                if len(words) < window:
                    continue
                grams = _rolled(words, gram, 1)
                at = np.unique(choices(grams, window - gram + 1))
                rows.append(np.full(len(at), row))
                places.append(at)
                hashes.append(grams[at])
                held += len(at)
                if held > 1 << 19:
                    yield made(batch, rows, places, hashes)
                    rows, places, hashes, held = [], [], [], 0
            if rows:
                yield made(batch, rows, places, hashes)

    def made(batch, rows, places, hashes):
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes).view(np.int64)), batch.column(0).take(pa.array(np.concatenate(rows))), pa.array(np.concatenate(places).astype(np.int32))], names=["fp", "id", "pos"])

    return docs.select("id", "text").mapInArrow(run, f"fp long, id {kind}, pos int")


def windows(docs: DataFrame, window: int, gram: int, block: int = 1 << 18) -> DataFrame:
    """docs: id, text, active (places of fingerprints). A row with w1, w2, id, start for each window that has chosen one and is
    the first of its words in its block; the block's other windows are listed by id in ``later``, with a w1 of their own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            active, ids = batch.column(2), batch.column(0)
            for row, words in _each(batch, "text"):
                chosen = choices(_rolled(words, gram, 1), window - gram + 1)
                if not len(chosen):
                    continue
                hot = np.zeros(len(words), bool)
                hot[active[row].values.to_numpy()] = True
                at = np.flatnonzero(hot[chosen])
                held.append((_rolled(words, window, 100)[at], _rolled(words, window, 200)[at], np.full(len(at), ids[row].as_py(), np.int64), at))
                size += len(at)
                if size > block:
                    yield from made(held)
                    held, size = [], 0
        if held:
            yield from made(held)

    def made(held: list) -> Iterator[pa.RecordBatch]:
        w1, w2, ids, at = (np.concatenate(x) for x in zip(*held))
        if (np.diff(ids) < 0).any():
            order = np.lexsort((at, ids))
            w1, w2, ids, at = w1[order], w2[order], ids[order], at[order]
        order = np.argsort(w1, kind="stable")  # the few that share w1 alone are told apart later
        w1, w2, ids, at = w1[order], w2[order], ids[order], at[order]
        new = np.append(True, (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1]))[: len(w1)]
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = (ids != ids[first]) | (at != at[first])  # rows that repeat an id are one
        n = int(new.sum())
        yield rows(w1[new].view(np.int64), pa.array(w2[new].view(np.int64)), ids[new], pa.array(at[new].astype(np.int32)), pa.nulls(n, pa.list_(pa.int32())))
        ids, at = ids[later], at[later]
        if len(ids):
            order = np.argsort(ids, kind="stable")
            ids, at = ids[order], at[order]
            cuts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            lists = pa.ListArray.from_arrays(pa.array(np.append(cuts, len(ids)).astype(np.int32)), pa.array(at.astype(np.int32)))
            yield rows(mix(ids[cuts].view(np.uint64)).view(np.int64), pa.nulls(len(cuts), pa.int64()), ids[cuts], pa.nulls(len(cuts), pa.int32()), lists)

    def rows(w1, w2, ids, start, later) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(w1), w2, pa.array(ids), start, later], names=["w1", "w2", "id", "start", "later"])

    return docs.mapInArrow(run, "w1 long, w2 long, id long, start int, later array<int>")


def finished(docs: DataFrame, kind: str, window: int, gram: int, with_text: bool) -> DataFrame:
    """docs: id, text, starts (of windows that go). What is left of each text, and the fingerprints that stand only for
    windows that go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(2)
            for row, end, data, at in text_slices(batch, "text"):
                n, gone, sha, texts, sizes, past = [], [], [], [], [], [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
                for i in range(row, end):
                    own, marked = data[at[i - row] : at[i - row + 1]], starts[i].values.to_numpy() if starts[i].is_valid else None
                    got = _kept(own.tobytes().split(), marked, window)  # bytes.split parts at exactly the six white space bytes
                    n.append(got[0])
                    gone.append(got[1])
                    sha.append(hashlib.sha256(got[2]).hexdigest())
                    sizes.append(0)
                    if marked is not None:
                        past.append(superseded(own, marked))
                        sizes[-1] = len(past[-1][0])
                    if with_text:
                        texts.append(got[2].decode())
                fps, places = (np.concatenate(x) for x in zip(*past))
                pairs = pa.StructArray.from_arrays([pa.array(fps), pa.array(places.astype(np.int32))], names=["fp", "pos"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)).astype(np.int32)), pairs)
                columns = [batch.column(0).slice(row, end - row), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha, pa.string()), *([pa.array(texts, pa.string())] if with_text else []), lists]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def superseded(data: np.ndarray, marked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        grams = _rolled(word_hashes(data, np.array([0, len(data)]))[0], gram, 1)
        chosen = choices(grams, window - gram + 1)
        stays = np.ones(len(chosen), bool)
        stays[marked] = False
        at = np.setdiff1d(chosen, chosen[stays])
        return grams[at].view(np.int64), at

    names = ["id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text, "past"]
    return docs.select("id", "text", "starts").mapInArrow(run, f"id {kind}, n_words long, n_removed long, kept_sha256 string, {'kept_text string, ' * with_text}past array<struct<fp:long,pos:int>>")


class WindowIndex:
    """The index in a folder that driver and executors share. ``kind``: the type of the ids, a whole number. The other
    parameters hold for the index's life; one that is there already keeps its own."""

    def __init__(self, spark: SparkSession, base: str, kind: str = "bigint", window: int = 20, gram: int = 8, fan: int = 4, buckets: int | None = None):
        self.spark, self.base, self.files, self.tag = spark, base, Files(spark, base), uuid.uuid4().hex[:12]
        versions = [int(n.removeprefix("manifest.")) for n, _ in self.files.names(base) if n.startswith("manifest.") and not n.endswith(".tmp")]
        self.version = max(versions, default=0)
        if versions:
            self.state = json.loads(self.files.read(f"{base}/manifest.{self.version}"))
        else:
            self.state = {"kind": kind, "window": window, "gram": gram, "fan": fan, "buckets": buckets or parts(spark), "made": 0, "last": None, "runs": [], "texts": []}
        self.kind, self.window, self.gram = self.state["kind"], self.state["window"], self.state["gram"]
        self.known: set[str] = set()

    # --- tables in buckets

    def _table(self, name: str, columns: str, by: str, sort: str) -> DataFrame:
        """A table of the index, which the session's catalog learns of when it is first asked for."""
        full = f"kvlake_{self.tag}_{name}"
        if name not in self.known:
            self.spark.sql(f"create table {full} ({columns}) using parquet clustered by ({by}) sorted by ({sort}) into {self.state['buckets']} buckets location '{self.base}/{name}'")
            self.known.add(name)
        return self.spark.table(full)

    def _write(self, df: DataFrame, name: str, by: list[str], sort: list[str]) -> None:
        """df: its partitions are the buckets already."""
        with settings(self.spark, CLEANUP, *IN_BUCKETS, off=("spark.sql.requireAllClusterKeysForCoPartition",)):
            df.write.bucketBy(self.state["buckets"], *by).sortBy(*sort).option("path", f"{self.base}/{name}").saveAsTable(f"kvlake_{self.tag}_{name}")
        self.known.add(name)

    def _drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"drop table if exists kvlake_{self.tag}_{name}")
            self.files.delete(f"{self.base}/{name}")
            self.known.discard(name)

    def close(self) -> None:
        """Takes the tables out of the session's catalog; the folder stays."""
        for name in list(self.known):
            self.spark.sql(f"drop table if exists kvlake_{self.tag}_{name}")
        self.known.clear()

    def run(self, name: str) -> DataFrame:
        return self._table(name, f"fp bigint, salt int, id {self.kind}, pos int", "fp, salt", "fp, salt")

    def texts(self, name: str) -> DataFrame:
        return self._table(name, f"id {self.kind}, text string", "id", "id")

    def _dealt(self, df: DataFrame, *by: str) -> DataFrame:
        return df.repartition(self.state["buckets"], *by)

    # --- fingerprints that are too common for one bucket

    def _common(self, texts: DataFrame, n: int) -> list[int]:
        """Fingerprints with more than half a bucket's share, from a sample of 16 texts for each bucket."""
        buckets = self.state["buckets"]
        rate = min(1.0, 16 * buckets / max(n, 1))
        drawn = fingerprints(texts.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < rate * (1 << 30)), self.kind, self.window, self.gram)
        least = max(0.75 * drawn.count() / (2 * buckets), 256 * rate)
        return sorted(r["fp"] for r in drawn.groupBy("fp").count().where(F.col("count") > least).select("fp").collect())

    def _of(self, fps: list[int]) -> DataFrame:
        return F.broadcast(self.spark.createDataFrame(pa.table({"fp": pa.array(fps, pa.int64())})))

    def _salted(self, entries: DataFrame, common: list[int]) -> DataFrame:
        """entries: fp, id, pos; dealt out into the buckets of a run."""
        salt = F.lit(0)
        if common:
            entries = entries.join(self._of(common).withColumn("common", F.lit(True)), "fp", "left")
            salt = F.when(F.col("common"), F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).otherwise(salt)
        return self._dealt(entries.select("fp", salt.alias("salt"), "id", "pos"), "fp", "salt")

    # --- batches

    def ingest(self, docs: DataFrame, with_text: bool = False, last: bool = False) -> DataFrame:
        """docs: id, text; all ids are above those of earlier batches. Returns id, n_words, n_removed, kept_sha256 (and
        kept_text) as a written table, and leaves the batch in the index, unless it is the last that the index is for. After
        an error the index is to be opened again; it is then as it was before the batch."""
        st, scratch = self.state, Scratch(self.spark, "ingest")
        st["made"] += 1
        k, before = st["made"], st["last"]
        texts, run, past = f"texts{k}", f"run{k}", f"past{k}"
        self._drop(texts, run, past)  # what a batch that failed may have left
        self._write(self._dealt(docs.select("id", "text"), "id"), texts, ["id"], ["id"])
        lowest, highest, n = self.texts(texts).agg(F.min("id"), F.max("id"), F.count("*")).first()
        if before is not None and lowest is not None and lowest <= before:
            raise ValueError("ids must be above those of earlier batches")
        common = self._common(self.texts(texts), n)
        self._write(self._salted(fingerprints(self.texts(texts), self.kind, self.window, self.gram), common), run, ["fp", "salt"], ["fp", "salt"])
        with settings(self.spark, *IN_BUCKETS):
            active = self._active(self.run(run), common)
            seen = [windows(self.texts(t).join(active, "id").select("id", "text", "active"), self.window, self.gram) for t in [*st["texts"], texts]]
            order = Window.partitionBy("w1", "w2").orderBy("id", "start")
            later = reduce(DataFrame.unionByName, seen).withColumn("rank", F.rank().over(order)).where("later is not null or rank > 1")
            later = later if before is None else later.where(F.col("id") > F.lit(before))
            marks = self._dealt(later.select(F.col("id").cast(self.kind).alias("id"), "start", "later"), "id").groupBy("id")
            marks = marks.agg(F.concat(F.collect_list("start"), F.flatten(F.collect_list("later"))).alias("starts"))
            done = scratch.save(finished(self.texts(texts).join(marks, "id", "left"), self.kind, self.window, self.gram, with_text), "done")
        if last:
            return done.drop("past")
        few = done.select("id", F.explode("past").alias("p")).select("p.fp", "id", "p.pos").coalesce(-(-st["buckets"] // 16))
        few.write.parquet(f"{self.base}/{past}")
        st["runs"].append({"name": run, "common": common, "past": past})
        st["texts"].append(texts)
        st["last"] = highest if highest is not None else before
        if len(st["runs"]) > st["fan"]:
            self.compact()
        else:
            self._commit()
        return done.drop("past")

    def _active(self, fresh: DataFrame, common: list[int]) -> DataFrame:
        """id, active: the places of all fingerprints that the new run has and that occur twice, there or in history."""
        keys, old = ["fp", "salt"], [(self.run(r["name"]), r["common"]) for r in self.state["runs"]]
        twice = fresh.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").select(*keys)
        hits = [fresh.join(twice.hint("merge"), keys, "left_semi")]
        for past, _ in old:
            hits += [fresh.join(past.select(*keys).hint("merge"), keys, "left_semi"), past.join(fresh.select(*keys).hint("merge"), keys, "left_semi")]
        every = sorted({*common, *(fp for _, fps in old for fp in fps)})
        if every:  # salted in one run and perhaps not in another
            now = [r["fp"] for r in fresh.join(self._of(every), "fp", "left_semi").select("fp").distinct().collect()]
            hits += [t.join(self._of(now), "fp", "left_semi") for t in [fresh, *(past for past, _ in old)]]
        places = reduce(DataFrame.union, [h.select("id", "pos") for h in hits])
        return self._dealt(places, "id").groupBy("id").agg(F.collect_set("pos").alias("active"))

    def compact(self) -> None:
        """Merges all runs into one, sorted by file, without what is past, and commits it. What goes is deleted after that."""
        st = self.state
        st["made"] += 1
        name, old = f"run{st['made']}", st["runs"]
        self._drop(name)
        common = sorted({fp for r in old for fp in r["common"]})
        rows = reduce(DataFrame.unionByName, [self.run(r["name"]).select("fp", "id", "pos") for r in old])
        past = [self.spark.read.schema(f"fp bigint, id {self.kind}, pos int").parquet(f"{self.base}/{r['past']}") for r in old if r["past"]]
        rows = self._salted(rows, common)
        if past:
            rows = rows.join(self._salted(reduce(DataFrame.unionByName, past), common).hint("merge"), ["fp", "salt", "id", "pos"], "left_anti")
        self._write(rows.select("fp", "salt", "id", "pos"), name, ["fp", "salt"], ["fp", "salt"])
        st["runs"] = [{"name": name, "common": common, "past": None}]
        self._commit()
        self._drop(*(r["name"] for r in old))
        for r in old:
            if r["past"]:
                self.files.delete(f"{self.base}/{r['past']}")

    def _commit(self) -> None:
        self.files.commit(f"{self.base}/manifest.{self.version + 1}", json.dumps(self.state))
        self.version += 1


def _splits(docs: DataFrame, id_col: str, batches: int) -> list:
    """Ids that part the documents into batches of about equal numbers."""
    at = [i / batches for i in range(1, batches)]
    got = docs.select(F.percentile_approx(named(id_col), at, 10_000).alias("q")).first()["q"] if at else []
    return sorted({x for x in got or [] if x is not None})


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, gram: int = 8, batches: int = 3, fan: int = 1, with_text: bool = False) -> DataFrame:
    """One row per input row: id, n_words, n_removed, kept_sha256 (and kept_text).

    A window is ``window`` consecutive words, unchanged, of one text; every word in a window whose words
    also start earlier (smaller id, or same text, earlier start) is removed, judged on the input. Kept
    words are joined by one space. Null and empty texts have no words. Ids must be whole numbers and differ: of
    rows that repeat an id, each is judged against smaller ids and against itself, as one text would be.
    A row without an id keeps its words, and none go on its account. Other columns are not read. An empty table
    gives no row. The batches go through an index of their own, which is compacted once it holds more than ``fan`` runs; the
    last batch meets it and isn't added."""
    spark = docs.sparkSession
    s = Scratch(spark, "substring")
    plain = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    index = WindowIndex(spark, f"{s.base}/index", plain.schema["id"].dataType.simpleString(), window, gram, fan)
    cuts = [None, *_splits(docs, id_col, batches), None]
    unnamed = plain.where("id is null").select("id", "text", F.lit(None).cast("array<int>").alias("starts"))
    done = [s.save(finished(unnamed, index.kind, window, gram, with_text).drop("past"), "unnamed")]
    try:
        for lo, hi in zip(cuts, cuts[1:]):
            new = plain.where("id is not null") if lo is None else plain.where(F.col("id") > F.lit(lo))
            done.append(index.ingest(new if hi is None else new.where(F.col("id") <= F.lit(hi)), with_text, last=hi is None))
    finally:
        index.close()
        s.drop("index")
    return reduce(DataFrame.unionByName, done).withColumnRenamed("id", id_col)
