"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets,
star-shaped candidate edges, verification on full shingle sets, connected components.

Documents with equal shingle sets are one class from the start, so exact copies cost one row each. Every
bucket first links its members to its smallest one only: a star has one edge less than members. Edges are
verified on the full sets. A star can miss a link between two members that the centre isn't linked with,
so buckets that hold more than one component after that are searched once more: the members outside the
bucket's main component ask all its members, in blocks of bounded size, on full sets, and each reports one
link for each other component at most. Every pair that shares a bucket was thus verified, or lies in one
component anyway; no pair of a group is ever written down unless it is a star's edge or a link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, mix, named, parts, split_join, text_slices, word_hashes

#: 60 bands of 6 rows: a pair at similarity 0.8 shares no bucket with a chance of (1 - 0.8^6)^60 = 1e-8.
BANDS, ROWS = 60, 6
#: Elements of the sets in one block of a bucket.
BLOCK = 1 << 17


def shingle_sets(batch: pa.RecordBatch, column: str, width: int) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text of the batch."""
    for _, _, data, at in text_slices(batch, column):
        words, first = word_hashes(data, at, lower=True)
        with np.errstate(over="ignore"):
            rolled = np.zeros(max(0, len(words) - width + 1), np.uint64)
            for k in range(width):
                rolled = mix(rolled * np.uint64(31) + words[k : k + len(rolled)], 11)
        for i in range(len(first) - 1):
            a, b = first[i], first[i + 1]
            if b - a >= width:
                yield np.unique(rolled[a : b - width + 1])
            elif b > a:  # fewer words than a shingle has: the sequence as one
                yield np.array([xxhash.xxh3_64_intdigest(words[a:b].tobytes(), int(b - a))], np.uint64)
            else:
                yield np.zeros(0, np.uint64)


class Sketch:
    """One-permutation MinHash: one hash per element, the least of each bin. An empty bin takes the
    value of the first bin that isn't empty in an order of its own, drawn once for all sets."""

    def __init__(self, bands: int = BANDS, rows: int = ROWS, seed: int = 17):
        self.bands, self.rows, self.bins = bands, rows, bands * rows
        r = np.random.default_rng(seed)
        self.order = np.stack([r.permutation(self.bins) for _ in range(self.bins)]).astype(np.int32)
        self.near = np.ascontiguousarray(self.order[:, :16])
        self.band = mix(np.arange(bands, dtype=np.uint64), 23)

    def bins_of(self, elements: np.ndarray) -> np.ndarray:
        """elements: sorted and distinct, one at least."""
        own = ((elements >> np.uint64(32)) * np.uint64(self.bins) >> np.uint64(32)).astype(np.int64)
        first = np.flatnonzero(np.diff(own, prepend=-1))
        full = np.zeros(self.bins, bool)
        full[own[first]] = True
        out = np.zeros(self.bins, np.uint64)
        out[own[first]] = elements[first]
        if len(first) < self.bins:
            gaps = np.flatnonzero(~full)
            hit = full[self.near[gaps]]
            at = self.near[gaps, hit.argmax(axis=1)]
            rest = ~hit.any(axis=1)
            if rest.any():
                order = self.order[gaps[rest]]
                at[rest] = order[np.arange(len(order)), full[order].argmax(axis=1)]
            out[gaps] = out[at]
        return out

    def keys(self, elements: np.ndarray) -> np.ndarray:
        """One 64-bit bucket key for each band."""
        v = self.bins_of(elements).reshape(self.bands, self.rows)
        h = self.band.copy()
        with np.errstate(over="ignore"):
            for k in range(self.rows):
                h = mix(h * np.uint64(31) + v[:, k], 29)
        return h


def _sketched(docs: DataFrame, id_col: str, text_col: str, width: int, bands: int, rows: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch = Sketch(bands, rows)
        for batch in batches:
            sizes, names, keys, ends = [], [], [], [0]
            for s in shingle_sets(batch, "text", width):
                sizes.append(len(s))
                names.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                if len(s):
                    keys.append(sketch.keys(s))
                ends.append(ends[-1] + (bands if len(s) else 0))
            flat = np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "n", "name", "keys"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"id {kind}, n long, name binary, keys array<long>")


def _sets(docs: DataFrame, width: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done, ends, pending = 0, [0], []
            for s in shingle_sets(batch, "text", width):
                pending.append(s)
                ends.append(ends[-1] + len(s))
                if ends[-1] > 1 << 19 or done + len(pending) == batch.num_rows:
                    flat = np.concatenate(pending).view(np.int64)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(pending)), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=["id", "items"])
                    done, ends, pending = done + len(pending), [0], []

    return docs.select("id", "text").mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, items array<long>")


def _linked(asks: np.ndarray, component: np.ndarray, sets: list[np.ndarray], percent: int, columns: int = 4096) -> Iterator[tuple[int, int]]:
    """Of one block of a bucket: for each row that asks and each other component with a row similar
    enough, the most similar such row. Counts common elements by a product of incidence matrices, in
    strips of columns; elements of one set alone are left out beforehand."""
    sizes = np.array([len(x) for x in sets])
    who = np.repeat(np.arange(len(sets)), sizes)
    _, what, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    number = np.cumsum(times > 1) - 1
    stays = times[what] > 1
    who, what = who[stays], number[what[stays]]
    order = np.argsort(what, kind="stable")
    who, what = who[order], what[order]
    asking, there = np.flatnonzero(asks), np.flatnonzero(~asks)
    if not len(asking) or not len(there):
        return
    for at in range(0, len(asking), 512):
        mine = asking[at : at + 512]
        common = np.zeros((len(mine), len(there)), np.float32)
        place = np.full(len(sets), -1)
        place[mine], other = np.arange(len(mine)), np.full(len(sets), -1)
        other[there] = np.arange(len(there))
        for lo in range(0, int(what[-1]) + 1 if len(what) else 0, columns):
            x, y = np.searchsorted(what, [lo, lo + columns])
            w, c = who[x:y], what[x:y] - lo
            left, right = np.zeros((len(mine), columns), np.float32), np.zeros((len(there), columns), np.float32)
            m = place[w] >= 0
            left[place[w[m]], c[m]] = 1
            m = other[w] >= 0
            right[other[w[m]], c[m]] = 1
            common += left @ right.T
        union = sizes[mine][:, None] + sizes[there][None, :] - common
        near = (common * 100 >= percent * union) & (component[mine][:, None] != component[there][None, :])
        for r in np.flatnonzero(near.any(axis=1)):
            best: dict = {}
            for c in np.flatnonzero(near[r]):
                key = component[there[c]]
                if key not in best or common[r, c] / union[r, c] > best[key][0]:
                    best[key] = (common[r, c] / union[r, c], there[c])
            for _, c in best.values():
                yield mine[r], c


def _across(percent: int):
    """Rows sorted by (bucket, i, j): the links between components within each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None

        def done() -> pa.RecordBatch:
            t = pa.Table.from_batches(held)
            flat = t.column("items").combine_chunks()
            flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
            ends, values = flat.offsets.to_numpy(), flat.values.to_numpy()
            sets = [values[ends[i] : ends[i + 1]] for i in range(len(t))]
            ids = t.column("id").combine_chunks()
            asks, component = t.column("asks").to_numpy(), t.column("component").to_numpy()
            got = list(_linked(asks, component, sets, percent)) if len(t) > 1 else []
            a, b = (ids.take(pa.array([g[k] for g in got], pa.int64())) for k in (0, 1))
            return pa.RecordBatch.from_arrays([a, b], names=["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in range(3)])
            cuts = [0, *(np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for x, y in zip(cuts, cuts[1:]):
                key = tuple(keys[:, x].tolist())
                if last is not None and key != last:
                    yield done()
                    held = []
                last = key
                held.append(batch.slice(x, y - x))
        if held:
            yield done()

    return run


def components(edges: DataFrame, scratch: Scratch, tag: str = "cc") -> DataFrame:
    """edges: a, b. Returns id, component (the smallest id reachable) for every id on an edge, by
    alternating large-star and small-star rounds, each written to the shared folder."""
    pairs = scratch.save(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), f"{tag}0")
    k = 0
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = split_join(both, least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.save(large.where("u <> v").distinct(), f"{tag}{k}l")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.where("u <> v").distinct(), f"{tag}{k + 1}")
        same = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first() == pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        scratch.drop(f"{tag}{k}", f"{tag}{k}l")
        pairs, k = new, k + 1
        if same:
            roots = pairs.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
            return pairs.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per input row: id, n_shingles, component_id, kept.

    Shingles: ``width`` consecutive words of the text, A-Z lower-cased; with fewer words, the whole
    sequence as one. Documents with 100 * intersection >= percent * union are linked, component_id is the
    smallest id reachable, kept says that it is the row's own. Null, empty and blank texts have no
    shingles and are linked with nothing. Rows that repeat an id are one document if their texts agree.
    A row without an id is linked with nothing. Other columns are not read."""
    scratch = Scratch(docs.sparkSession, "near")
    table = scratch.save(_sketched(docs, id_col, text_col, width, bands, rows), "sketches")
    usable = table.where(F.col("name").isNotNull() & F.col("id").isNotNull())
    classes = usable.groupBy("name").agg(F.min("id").alias("rep"))
    classes = scratch.save(classes, "classes")
    reps = usable.join(classes, [usable["name"] == classes["name"], usable["id"] == classes["rep"]]).select("id", "n", "keys")
    members = reps.select("id", "n", F.explode("keys").alias("bucket"))
    shared = members.groupBy("bucket").agg(F.count("*").alias("many"), F.min("id").alias("centre")).where("many > 1")
    bucket = scratch.save(split_join(members, shared, "bucket"), "buckets")
    near = lambda m, n: F.least(m, n) * 100 >= F.greatest(m, n) * percent
    size = bucket.select("id", "n").distinct()

    texts = docs.select(named(id_col).alias("id"), named(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()

    # the plan is the same at every size: the ids grow with the documents and aren't broadcast
    wanted = scratch.save(bucket.select("id").distinct(), "ids")
    sets = scratch.save(_sets(texts.join(wanted.hint("merge"), "id", "left_semi"), width).dropDuplicates(["id"]), "sets")

    stars = bucket.where("id <> centre").select(F.col("centre").alias("a"), F.col("id").alias("b"), F.col("n").alias("m")).distinct()
    stars = stars.join(size.select(F.col("id").alias("a"), "n"), "a").where(near(F.col("m"), F.col("n"))).select("a", "b")
    common = F.size(F.array_intersect("x", "y"))
    left, right = sets.select(F.col("id").alias("a"), F.col("items").alias("x")), sets.select(F.col("id").alias("b"), F.col("items").alias("y"))
    links = stars.join(right, "b").join(left, "a").where(common * 100 >= (F.size("x") + F.size("y") - common) * percent)
    links = scratch.save(links.select("a", "b"), "links0")
    label = scratch.save(components(links, scratch, "cc1_"), "label1")
    held = bucket.where("many > 2").join(label, "id", "left").select("bucket", "id", "n", F.coalesce("component", "id").alias("component"))
    per = held.groupBy("bucket", "component").agg(F.sum("n").alias("own"))
    main = per.groupBy("bucket").agg(F.max_by("component", F.struct("own", "component")).alias("main"), F.sum("own").alias("all"), F.max("own").alias("most")).where("all > most")
    main = scratch.save(main.withColumn("rest", F.col("all") - F.col("most")), "main")
    blocks = lambda c: F.ceil(F.col(c) / F.lit(BLOCK)).cast("int")
    own = lambda c: F.pmod(F.xxhash64("id"), blocks(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), blocks(c) - 1))
    mixed = scratch.save(held.join(main, "bucket").select("bucket", "id", "component", "main", "all", "rest"), "mixed")
    rows_ = mixed.select("bucket", "id", "component", "all", every("rest").alias("i"), own("all").alias("j"), F.lit(False).alias("asks"))
    rows_ = rows_.union(mixed.where("component <> main").select("bucket", "id", "component", "all", own("rest").alias("i"), every("all").alias("j"), F.lit(True).alias("asks")))
    p = parts(docs.sparkSession)
    turn = F.pmod(F.hash("bucket").cast("long") + F.col("i").cast("long") * blocks("all") + F.col("j"), F.lit(p)).cast("int")  # the blocks of one bucket go round
    rows_ = rows_.withColumn("turn", turn).join(sets, "id").repartitionById(p, "turn").sortWithinPartitions("bucket", "i", "j")
    more = scratch.save(rows_.select("bucket", "i", "j", "asks", "id", "component", "items").mapInArrow(_across(percent), f"a {kind}, b {kind}").distinct(), "links1")
    scratch.drop("sets", "mixed", "main", "buckets")
    label = scratch.save(components(links.union(more), scratch, "cc2_"), "label2")
    labelled = classes.join(label.withColumnRenamed("id", "rep"), "rep", "left").select("name", F.coalesce("component", "rep").alias("component_id"))
    out = table.select("id", "n", "name").join(labelled, "name", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))
