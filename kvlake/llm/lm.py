"""Language-model scoring by masked pseudo-likelihood.

A network sees the words around a place (``reach`` to each side, never the word itself) and predicts the word's
class; within its class a word has its share of all words of the corpus. Each word's conditional log-probability
is the sum of both logs; a document's score is their sum over all its words.

Everything that is learned is learned from sums over all documents, so it is the same however they are partitioned,
but for the rounding of float sums:

1. Exact counts of every word: a written table with one row per 64-bit word hash, joined in at scoring; the ``head``
   most frequent words go to every task instead. This part grows with the vocabulary, the rest has a fixed size.
2. Classes: how often the ``signs`` most frequent words stand near each of the ``top`` most frequent words (rarer
   ones by hash in ``groups``); k-means in numpy puts words with like neighbours together.
3. The network's first weights: for each place around a word and each input there, the log of how much more often
   each class stands beside it than elsewhere. The ``inputs - classes - 1`` most frequent words are inputs of their
   own, rarer ones enter by their class, and there is one for places beyond the document's ends.
4. Training, each document in one of ``rounds`` rounds. The first is a Newton step on the gain of each distance and of the
   bias, from exact gradients and Hessians. The others move every weight by the log ratio of observed to predicted
   counts (iterative scaling, which lowers the loss at each step).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frequent, named, text_slices, word_hashes


@dataclass(frozen=True)
class Config:
    head: int = 1 << 18  # most words whose counts go to every task; the others' are joined in
    top: int = 1 << 16  # most words that are given a class by themselves
    groups: int = 1 << 12  # hashed words that are given their class together
    signs: int = 32  # frequent words by which words are told apart
    inputs: int = 1 << 11
    classes: int = 64
    alone: int = 16  # classes of one word, the most frequent ones
    reach: int = 2
    rounds: int = 2
    gain: float = 0.6  # of each distance before training
    chunk: int = 8192

    @property
    def places(self) -> list[int]:
        return [d for d in range(-self.reach, self.reach + 1) if d]


SMOOTH = 0.1  # added to every count of a word or a class
PRIOR = 5.0  # occurrences by class alone that are added to those of an input


def around(values: np.ndarray, first: np.ndarray, places: list[int], beyond: int) -> np.ndarray:
    """For each place the value that stands there, seen from every word; ``beyond`` outside its document."""
    n = len(values)
    begin, end = np.repeat(first[:-1], np.diff(first)), np.repeat(first[1:], np.diff(first))
    at, out = np.arange(n), np.empty((len(places), n), np.int64)
    for k, d in enumerate(places):
        j = at + d
        out[k] = np.where((j >= begin) & (j < end), values[np.clip(j, 0, n - 1)], beyond)
    return out


def sums_by(rows: np.ndarray, values: np.ndarray, out: np.ndarray) -> None:
    """Adds values to the rows of out, by sorting: far faster than ufunc.at."""
    order = np.argsort(rows, kind="stable")
    first = np.flatnonzero(np.diff(rows[order], prepend=-1))
    out[rows[order][first]] += np.add.reduceat(values[order], first, axis=0)


def turned(p: np.ndarray, strip: int = 256) -> np.ndarray:
    """The transpose, in order, strip by strip: so much at a time stays in the cache."""
    out = np.empty(p.shape[::-1])
    for a in range(0, len(p), strip):
        out[:, a : a + strip] = p[a : a + strip].T
    return out


def raised(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """z, e to its power, and the sums of its rows. z is moved row by row first where it would leave what floats hold."""
    if z.size and z.max() < 60:
        e = np.exp(z)
        total = e.sum(axis=1)
        if total.min() > 1e-30:
            return z, e, total
    z = z - z.max(axis=1, keepdims=True)
    e = np.exp(z)
    return z, e, e.sum(axis=1)


class Network:
    """The sum of the input rows and the bias, softmax over the classes."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray):
        self.weights, self.bias = weights.astype(np.float32), bias.astype(np.float32)

    def odds(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """near: input rows by place. Logs of odds of every class, the odds, and their sums."""
        z = self.weights[near[0]]
        z += self.bias
        for row in near[1:]:
            z += self.weights[row]
        return raised(z)

    def probabilities(self, near: np.ndarray) -> np.ndarray:
        _, e, total = self.odds(near)
        e /= total[:, None]
        return e

    def slopes(self, near: np.ndarray, target: np.ndarray, gains: np.ndarray, places: list[int]) -> np.ndarray:
        """Gradient and Hessian of the log-likelihood by the gains of the bias and of each distance: a row each, in one
        column the gradient, in the others the Hessian."""
        f = []
        for d in range(1, len(gains)):
            own = [self.weights[row] for row, place in zip(near, places) if abs(place) == d]
            f.append(sum(own[1:], own[0]))
        p = np.float32(gains[0]) * self.bias + sum(np.float32(g) * x for g, x in zip(gains[1:], f))
        _, p, total = raised(p)
        p /= total[:, None]
        at = np.arange(len(target))
        parts = [p * x for x in f]
        means = np.stack([p @ self.bias, *(x.sum(axis=1) for x in parts)]).astype(float)
        there = np.stack([self.bias[target], *(x[at, target] for x in f)]).sum(axis=1, dtype=float)
        second = np.empty((len(gains), len(gains)))
        second[0, 0] = p.sum(axis=0, dtype=float) @ self.bias.astype(float) ** 2
        for i, x in enumerate(parts, 1):
            second[0, i] = second[i, 0] = x.sum(axis=0, dtype=float) @ self.bias
            for j, y in enumerate(f, 1):
                second[i, j] = np.vdot(x, y)
        return np.column_stack([there - means.sum(axis=1), second - means @ means.T])


def lookup(words: np.ndarray, bits: int = 20) -> np.ndarray:
    """For sorted hashes: where those begin whose first bits are each number."""
    return np.searchsorted(words, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)


def find(words: np.ndarray, head: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The place in the sorted head of each word, or -1. The first bits lead to a word or two, which are compared."""
    first = (words >> np.uint64(64 - int(len(begins)).bit_length() + 1)).astype(np.int64)
    at, out = begins[first], np.full(len(words), -1, np.int32)
    todo = np.flatnonzero(at < np.append(begins[1:], np.int32(len(head)))[first])
    while len(todo):
        hit = head[at[todo]] == words[todo]
        out[todo[hit]] = at[todo[hit]]
        todo = todo[~hit]
        at[todo] += 1
        todo = todo[at[todo] < len(head)]
        todo = todo[head[at[todo]] <= words[todo]]
    return out


@dataclass
class Model:
    config: Config
    head: np.ndarray  # hashes of the most frequent words, sorted
    logs: np.ndarray  # log counts of the head
    rank: np.ndarray  # of the head: place among the top words by frequency, or -1
    counts: DataFrame | None  # word, n: all words; stays with the driver
    klass: np.ndarray  # of each top word, then of each group
    total: np.ndarray  # log of each class's counts
    weights: np.ndarray | None = None  # input rows x classes
    bias: np.ndarray | None = None

    @cached_property
    def begins(self) -> np.ndarray:
        return lookup(self.head)

    def ranks(self, words: np.ndarray, logs: np.ndarray | None = None) -> np.ndarray:
        """Of every word its rank, -1 beyond the top. ``logs`` is filled with log counts; nan where they lack."""
        at = find(words, self.head, self.begins)
        if logs is not None:
            logs[:] = np.append(self.logs, np.nan)[at]
        return np.append(self.rank, -1)[at]

    def rows(self, words: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Which entry of klass is each word's."""
        return np.where(rank >= 0, rank, len(self.klass) - self.config.groups + (words % np.uint64(self.config.groups)).astype(np.int64))

    def seen(self, words: np.ndarray, first: np.ndarray, logs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Input rows by place, and classes."""
        c = self.config
        rank = self.ranks(words, logs)
        klass = self.klass[self.rows(words, rank)]
        own = c.inputs - c.classes - 1
        near = around(np.where((rank >= 0) & (rank < own), rank, own + klass), first, c.places, c.inputs - 1)
        return near + np.arange(len(near))[:, None] * c.inputs, klass

    def log_probabilities(self, words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of every word, given the words around it; and which words still lack their log count."""
        net, logs, out = Network(self.weights, self.bias), np.empty(len(words)), np.empty(len(words))
        near, klass = self.seen(words, first, logs)
        for a in range(0, len(words), self.config.chunk):
            k = klass[a : a + self.config.chunk]
            z, _, total = net.odds(near[:, a : a + len(k)])
            out[a : a + len(k)] = z[np.arange(len(k)), k] - np.log(total)
        lacking = np.isnan(logs)
        return out - self.total[klass] + np.where(lacking, 0.0, logs), lacking


def word_counts(docs: DataFrame, text_col: str, scratch: Scratch, most: int = 1 << 20) -> DataFrame:
    """word, n: how often each word, by its 64-bit hash as a signed number, occurs in all documents. A written table."""

    def rows(held: list) -> pa.RecordBatch:
        words, n = (np.concatenate(x) for x in zip(*held))
        order = np.argsort(words, kind="stable")
        words, n = words[order], n[order]
        first = np.flatnonzero(np.append(True, words[1:] != words[:-1]))
        return pa.RecordBatch.from_arrays([pa.array(words[first].view(np.int64)), pa.array(np.add.reduceat(n, first))], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for _, _, data, at in text_slices(batch, "text"):
                words = word_hashes(data, at)[0]
                if not len(words):
                    continue
                held.append(np.unique(words, return_counts=True))
                size += len(held[-1][0])
                if size > most:
                    yield rows(held)
                    held, size = [], 0
        if held:
            yield rows(held)

    return scratch.save(docs.select(named(text_col).alias("text")).mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "counts")


def dealt_counts(counts: DataFrame, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences and distinct words of each of ``size`` groups: one row per group reaches the driver."""
    unsigned = F.pmod(F.pmod("word", F.lit(size)) + F.when(F.col("word") < 0, 2**64 % size).otherwise(0), F.lit(size))
    got = counts.groupBy(unsigned.alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("words")).toPandas()
    n, words = np.zeros(size, np.int64), np.zeros(size, np.int64)
    n[got["bucket"].to_numpy(np.int64)] = got["n"].to_numpy()
    words[got["bucket"].to_numpy(np.int64)] = got["words"].to_numpy()
    return n, words


def head_of(counts: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, sorted, and counts of the words that occur more often than some number: ``most`` words at most."""
    got = frequent(counts, most).toPandas()
    words = got["word"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    return words[order], got["n"].to_numpy(np.int64)[order]


def ranked(head: np.ndarray, n: np.ndarray, most: int) -> np.ndarray:
    """The place of each word of the head by count, then hash; -1 from the ``most``-th on."""
    rank = np.empty(len(head), np.int64)
    rank[np.lexsort((head, -n))] = np.arange(len(head))
    return np.where(rank < most, rank, -1)


def summed(docs: DataFrame, text_col: str, scratch: Scratch, name: str, shape: tuple[int, int], add: Callable[[np.ndarray, np.ndarray, np.ndarray], None]) -> np.ndarray:
    """A matrix that ``add(words, first, matrix)`` adds to for every slice of the texts, summed by Spark: one row per
    row that isn't all zero. Its size is fixed, so each task and the driver hold no more."""
    names = [f"x{i}" for i in range(shape[1])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, some = np.zeros(shape), False
        for batch in batches:
            for _, _, data, at in text_slices(batch, "text"):
                words, first = word_hashes(data, at)
                if len(words):
                    add(words, first, out)
                    some = True
        if some:
            full = np.flatnonzero(out.any(axis=1))
            for a in range(0, len(full), 1 << 13):
                part = full[a : a + (1 << 13)]
                yield pa.RecordBatch.from_arrays([pa.array(part), *(pa.array(x) for x in np.ascontiguousarray(out[part].T))], names=["row", *names])

    parts = docs.select(named(text_col).alias("text")).mapInArrow(run, "row long, " + ", ".join(f"{x} double" for x in names))
    got = scratch.save(parts.groupBy("row").agg(*[F.sum(x).alias(x) for x in names]), name).toPandas()
    out = np.zeros(shape)
    out[got["row"].to_numpy(np.int64)] = got[names].to_numpy(float).reshape(-1, shape[1])
    scratch.drop(name)
    return out


def clusters(points: np.ndarray, mass: np.ndarray, k: int, turns: int = 15, seed: int = 1) -> np.ndarray:
    """k-means of points by mass; the first centres are drawn one after the other, each in proportion to its distance."""
    r = np.random.default_rng(seed)
    centres, far = [points[mass.argmax()]], np.full(len(points), np.inf)
    for _ in range(k - 1):
        far = np.minimum(far, ((points - centres[-1]) ** 2).sum(axis=1))
        p = np.cumsum(far * mass)
        centres.append(points[min(np.searchsorted(p, r.random() * p[-1]), len(points) - 1)])
    centres = np.array(centres)
    for _ in range(turns):
        own = ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)
        weight = np.bincount(own, weights=mass, minlength=k)
        total = np.zeros_like(centres)
        sums_by(own, points * mass[:, None], total)
        centres = np.where(weight[:, None] > 0, total / np.maximum(weight, 1e-9)[:, None], centres)
    return ((centres**2).sum(axis=1) - 2 * points @ centres.T).argmin(axis=1)


def fit(docs: DataFrame, text_col: str = "text", config: Config | None = None) -> Model:
    """Counts, classes and weights from all documents; a document that repeats counts as often. Null and empty texts add
    nothing. Each class keeps room for one word that isn't in the corpus. Words of equal count are ranked by hash.
    Other columns are not read. An empty table gives a model that knows no word."""
    c, spark = config or Config(), docs.sparkSession
    scratch = Scratch(spark, "lm")
    counts = word_counts(docs, text_col, scratch)
    n, distinct = dealt_counts(counts, c.groups)
    head, often = head_of(counts, c.head)
    rank = ranked(head, often, c.top)
    tops, is_top = int((rank >= 0).sum()), rank >= 0
    group = (head[is_top] % np.uint64(c.groups)).astype(np.int64)
    np.subtract.at(n, group, often[is_top])
    np.subtract.at(distinct, group, 1)
    mass, kinds = np.zeros(tops + c.groups), np.ones(tops + c.groups)
    mass[rank[is_top]] = often[is_top]
    mass[tops:], kinds[tops:] = n, distinct
    model = Model(c, head, np.log(often + SMOOTH), rank, counts, np.zeros(tops + c.groups, np.int64), np.zeros(c.classes))

    def shared(m: Model):
        """What tasks need for training: the top words only."""
        return spark.sparkContext.broadcast(replace(m, head=head[is_top], logs=m.logs[is_top], rank=rank[is_top], counts=None))

    sent = shared(model)

    def beside(words: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
        m = sent.value
        r = m.ranks(words)
        row = m.rows(words, r)
        near = around(np.where((r >= 0) & (r < c.signs), r, -1), first, c.places, -1)
        out += np.bincount((near + row * c.signs)[near >= 0], minlength=out.size).reshape(out.shape)

    profile = summed(docs, text_col, scratch, "profile", (len(mass), c.signs), beside)
    sent.unpersist()
    every = profile.sum(axis=0) / max(1.0, profile.sum())
    points = np.sqrt((profile + 2 * every) / (profile.sum(axis=1, keepdims=True) + 2))
    alone = min(c.alone, tops)
    model.klass[:alone] = np.arange(alone)
    if mass.sum():
        model.klass[alone:] = c.alone + clusters(points[alone:], mass[alone:], c.classes - c.alone)
    else:
        model.klass[alone:] = c.alone
    model.total = np.log(np.bincount(model.klass, weights=mass + SMOOTH * kinds, minlength=c.classes) + SMOOTH)
    share = np.bincount(model.klass, weights=mass, minlength=c.classes) + SMOOTH
    share /= share.sum()
    sent, rows = shared(model), len(c.places) * c.inputs

    def beside_inputs(words: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
        near, klass = sent.value.seen(words, first)
        out += np.bincount((near * c.classes + klass).ravel(), minlength=out.size).reshape(out.shape)

    met = summed(docs, text_col, scratch, "met", (rows, c.classes), beside_inputs)
    sent.unpersist()
    model.bias = np.log(share)
    model.weights = np.log((met + PRIOR * share) / (met.sum(axis=1, keepdims=True) + PRIOR)) - model.bias
    gains = np.array([1.0, *[c.gain] * c.reach])
    if not c.rounds:
        return _with_gains(model, gains)
    for k in range(c.rounds):
        part = docs.where(F.pmod(F.xxhash64(named(text_col)), F.lit(c.rounds)) == k)
        model = _scaled(part, text_col, scratch, model, share, shared, k) if k else _gains(part, text_col, scratch, model, gains, shared)
    return model


def _with_gains(model: Model, gains: np.ndarray) -> Model:
    return replace(model, bias=model.bias * gains[0], weights=model.weights * np.repeat([gains[abs(d)] for d in model.config.places], model.config.inputs)[:, None])


def _gains(docs: DataFrame, text_col: str, scratch: Scratch, model: Model, gains: np.ndarray, shared: Callable) -> Model:
    """One Newton step on the gains, held near where they were while there is little to learn from."""
    c, sent = model.config, shared(model)

    def slopes(words: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
        m = sent.value
        net = Network(m.weights, m.bias)
        near, klass = m.seen(words, first)
        for a in range(0, len(words), c.chunk):
            out += net.slopes(near[:, a : a + c.chunk], klass[a : a + c.chunk], gains, c.places)

    got = summed(docs, text_col, scratch, "slopes", (len(gains), len(gains) + 1), slopes)
    sent.unpersist()
    step = np.linalg.solve(got[:, 1:] + 10 * np.eye(len(gains)), got[:, 0])
    return _with_gains(model, np.clip(gains + step, 0.0, 2.0))


def _scaled(docs: DataFrame, text_col: str, scratch: Scratch, model: Model, share: np.ndarray, shared: Callable, k: int) -> Model:
    """One step of iterative scaling: each word has as many inputs as there are places, so each takes that part of the log ratio."""
    c, sent, rows = model.config, shared(model), len(model.weights)

    def both(words: np.ndarray, first: np.ndarray, out: np.ndarray) -> None:
        m = sent.value
        net = Network(m.weights, m.bias)
        near, klass = m.seen(words, first)
        for a in range(0, len(words), c.chunk):
            x = near[:, a : a + c.chunk]
            p = turned(net.probabilities(x))
            for i, row in enumerate(x - np.arange(len(x))[:, None] * c.inputs):
                own = out[rows + i * c.inputs : rows + (i + 1) * c.inputs]
                for j in range(c.classes):
                    own[:, j] += np.bincount(row, p[j], c.inputs)
        out[:rows] += np.bincount((near * c.classes + klass).ravel(), minlength=rows * c.classes).reshape(rows, c.classes)

    got = summed(docs, text_col, scratch, f"scaled{k}", (2 * rows, c.classes), both)
    sent.unpersist()
    return replace(model, weights=model.weights + np.log((got[:rows] + PRIOR * share) / (got[rows:] + PRIOR * share)) / len(c.places))


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row, repeats too: id, n_words, log_likelihood (the sum over all words), per_word (their
    mean; null without words). Null, empty and blank texts have no words and a sum of 0. A text's score depends on
    nothing but the text and the model. Other columns are not read."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(replace(model, counts=None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, row = shared.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            n, total, rare, lacking = [], [], [], []
            for _, _, data, at in text_slices(batch, "text"):
                words, first = word_hashes(data, at)
                logs, late = m.log_probabilities(words, first)
                sums, lates = np.append(0.0, np.cumsum(logs)), np.append(0, np.cumsum(late))
                n.append(np.diff(first))
                total.append(sums[first[1:]] - sums[first[:-1]])
                rare.append(words[late].view(np.int64))
                lacking.append(lates[first[1:]] - lates[first[:-1]])
            n, total, rare, lacking = (np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((n, np.int64), (total, float), (rare, np.int64), (lacking, np.int64)))
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(lacking)).astype(np.int32)), pa.array(rare))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(row, row + len(n))), batch.column(0), pa.array(n), pa.array(total), lists], names=["row", "id", "n_words", "sum", "rare"])
            row += len(n)

    kind = docs.schema[id_col].dataType.simpleString()
    scored = docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(run, f"row long, id {kind}, n_words long, sum double, rare array<long>")
    total = F.col("sum")
    if model.counts is not None:
        scored = Scratch(spark, "lm-score").save(scored, "scored")  # the rows' numbers hold from here on
        rare = scored.select("row", F.explode("rare").alias("word")).join(model.counts, "word", "left")
        more = rare.groupBy("row").agg(F.sum(F.log(F.coalesce("n", F.lit(0)) + SMOOTH)).alias("more"))
        scored, total = scored.drop("rare").join(more, "row", "left"), total + F.coalesce("more", F.lit(0.0))
    return scored.select(F.col("id").alias(id_col), "n_words", total.alias("log_likelihood"), F.when(F.col("n_words") > 0, total / F.col("n_words")).alias("per_word"))
