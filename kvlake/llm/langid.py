"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of (bucket, language) are added up by Spark over all labelled texts; the matrix of log
probabilities has buckets x languages numbers whatever the corpus and is broadcast (its size is
checked). Texts are scored many at a time: the n-grams of a block of texts, end to end, are the places of a
sparse matrix of counts, whose product with the matrix is taken language by language in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, named

#: What may be a letter; numbers such as those for a square or a half are among it.
LETTER = re.compile(r"[^\W\d_]")
#: Sizes of the n-grams, in characters of the lower-cased text with digits and white space levelled.
ORDERS = (1, 2, 3)
_LEVEL = np.arange(0x3000, dtype=np.uint32)
_LEVEL[[c for c in range(0x3000) if chr(c).isspace()]] = 32
_LEVEL[48:58] = 48


#: Characters of the texts that are worked on at once; a longer text is worked on in pieces of as many.
BLOCK = 1 << 19


class Block:
    """Texts, or pieces of long ones, end to end. row: whose each is; n-grams start from ``starts`` up to ``stops``."""

    def __init__(self, row: list[int], parts: list[str], follows: list[int]):
        self.row, self.codes = np.array(row), np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum([len(p) for p in parts])
        self.starts, self.stops = np.append(0, self.ends[:-1]), self.ends - np.array(follows)

    def grams(self, buckets: int) -> Iterator[np.ndarray]:
        """For each order the bucket of the n-gram that starts at each character; ``buckets`` itself where none does."""
        small = self.codes < len(_LEVEL)
        c = np.where(small, _LEVEL[np.where(small, self.codes, 0)], self.codes)
        h = np.zeros(len(c), np.uint32)
        for n in range(1, max(ORDERS) + 1):
            h = h[: max(0, len(c) - n + 1)] * np.uint32(0x9E3779B1) + c[n - 1 :] * np.uint32(0x85EBCA6B) + np.uint32(n)
            if n in ORDERS:
                x = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                out = np.full(len(c), buckets, np.int64)
                out[: len(x)] = (x ^ (x >> np.uint32(13))) % np.uint32(buckets)
                for k in range(1, max(ORDERS)):  # the last places of a text
                    at = self.ends - k
                    out[at[(at >= self.starts) & ((k < n) | (at >= self.stops))]] = buckets
                yield out


def blocks(texts: list[tuple[int, str]]) -> Iterator[Block]:
    """texts: row and text, none of them empty. A piece of a long text ends with the characters that its last n-grams need."""
    more = max(ORDERS) - 1
    row, parts, follows, held = [], [], [], 0
    for i, text in texts:
        low = text.lower()
        for a in range(0, len(low), BLOCK):
            part = low[a : a + BLOCK + more]
            row.append(i)
            parts.append(part)
            follows.append(max(0, len(part) - BLOCK))
            held += len(part)
            if held >= BLOCK:
                yield Block(row, parts, follows)
                row, parts, follows, held = [], [], [], 0
    if row:
        yield Block(row, parts, follows)


def has_letter(text: str) -> bool:
    """Whether any character is a letter in Unicode's sense."""
    return any(m[0].isalpha() for m in LETTER.finditer(text))


@dataclass
class Model:
    langs: list[str]
    log: np.ndarray  # buckets x languages
    prior: np.ndarray

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Of each text the language and its posterior probability; 'und' and 0 without a letter."""
        told = [(i, t) for i, t in enumerate(texts) if t and self.langs and has_letter(t)]
        total = np.tile(self.prior, (len(texts), 1))
        for block in blocks(told):
            for grams in block.grams(len(self.log)):
                for k, logs in enumerate(self.columns):
                    np.add.at(total[:, k], block.row, np.add.reduceat(logs[grams], block.starts))
        out = [("und", 0.0)] * len(texts)
        for i, _ in told:
            p = np.exp(total[i] - total[i].max())
            k = int(p.argmax())  # of equal ones the first by code point
            out[i] = self.langs[k], float(p[k] / p.sum())
        return out

    @cached_property
    def columns(self) -> list[np.ndarray]:
        """Each language's logs, with a zero for places where no n-gram starts."""
        return [np.append(self.log[:, k], 0.0) for k in range(len(self.langs))]


def fit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", buckets: int = 1 << 14, alpha: float = 0.1, max_langs: int = 256) -> Model:
    """Learns from every row with a text and a language; rows that repeat count as often as they occur. At most
    max_langs languages: the matrix has buckets x languages doubles, 32 MB for 256; more is an error. Without
    labelled rows the model knows no language."""
    seen = docs.where(named(lang_col).isNotNull() & named(text_col).isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        rows: dict[str, int] = {}
        for batch in batches:
            langs = np.array(batch.column(0).to_pylist(), object)
            names, which = np.unique(langs, return_inverse=True)
            for lang, n in zip(names, np.bincount(which, minlength=len(names)).tolist()):
                rows[lang] = rows.get(lang, 0) + n
                sums.setdefault(lang, np.zeros(buckets + 1, np.int64))
            for block in blocks([(i, t) for i, t in enumerate(batch.column(1).to_pylist()) if t]):
                of = np.repeat(which[block.row], block.ends - block.starts)
                for grams in block.grams(buckets):
                    for k in np.unique(which[block.row]):
                        sums[names[k]] += np.bincount(grams[of == k], minlength=buckets + 1)
            if len(sums) > 2 * max_langs:  # no worker holds more, however many there are
                yield from summed(sums, rows)
                sums, rows = {}, {}
        yield from summed(sums, rows)

    def summed(sums: dict, rows: dict) -> Iterator[pa.RecordBatch]:
        for lang, x in sums.items():
            at = np.flatnonzero(x[:buckets])
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(x[at], rows[lang]), pa.int64())], names=["lang", "bucket", "n"])

    per = seen.select(named(lang_col).alias("lang"), named(text_col).alias("text")).mapInArrow(count, "lang string, bucket int, n long")
    counted = Scratch(docs.sparkSession, "langid").save(per.groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "counts")
    langs = sorted(r["lang"] for r in counted.select("lang").distinct().limit(max_langs + 1).collect())
    if len(langs) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    table = counted.toPandas()
    counts, prior = np.zeros((buckets, len(langs))), np.zeros(len(langs))
    col = np.searchsorted(langs, table["lang"].to_numpy()) if langs else np.zeros(0, int)
    b, n = table["bucket"].to_numpy(), table["n"].to_numpy()
    counts[b[b >= 0], col[b >= 0]] = n[b >= 0]
    prior[col[b < 0]] = n[b < 0]
    log = np.log(counts + alpha) - np.log((counts + alpha).sum(axis=0)) if langs else counts
    return Model(langs, log, np.log(prior / max(1.0, prior.sum())) if langs else prior)


def predict(docs: DataFrame, model: Model, text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """One row per input row, repeats too: the kept columns, whatever their names but lang_pred and score, with
    lang_pred and score. Null texts and texts without a letter: 'und', 0. Of languages that are equally likely the
    first by code point. A text's result depends on nothing but the text and the model."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            got = m.predict(batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], names=schema.names)

    kept = docs.select(*(named(c).alias(f"k{i}") for i, c in enumerate(keep)), named(text_col).alias("text"))
    fields = [T.StructField(f"k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
    schema = T.StructType([*fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return kept.mapInArrow(score, schema).toDF(*keep, "lang_pred", "score")
