"""Secret scan: fixed patterns, and novelty to a dictionary-primed zstandard compressor.

A candidate is an unbroken run of 16 key characters or more with a sensitive word within 48 characters before
or after it. Its novelty is the number of bytes it adds to the compressed form of the text around it, with two
dictionaries loaded: a fixed one of common identifiers, and up to 8,192 of the most frequent words of the whole
corpus, counted over every document; case is levelled. Names, paths and repeated values cost little, random keys nearly a byte a character.
Candidates that cost ``least`` bytes a character or more are reported; nothing but the compressor decides.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frequent, named

# The base patterns and the lengths that count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that have 24 characters or more
KINDS = ("assign", "access", "hex", "novel")
#: What ASSIGN needs somewhere; a search for plain substrings is far cheaper than the pattern.
HINTS = ("password", "passwd", "secret", "token", "api")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{16,}")
SENSITIVE = re.compile(r"pass|secret|token|key|cred|auth|bearer|private|login|pwd|sign|session|cookie", re.IGNORECASE | re.ASCII)
IDENTIFIERS = (
    "import from return class self function const static public private void string number boolean object array list dict "
    "get set add remove update delete create insert select where order group value values index count name type text data "
    "key keys user users password passwd secret token access api_key apikey auth bearer authorization credential config "
    "http:// https:// www. .com .org .net /index.html /usr/local/bin/ /home/user/ example.com localhost 127.0.0.1 "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 --------==== ________ ........ "
)


#: What the corpus's dictionary is made of: the parts of names, shorter than any candidate, so that a key which
#: was leaked often doesn't become a word itself.
PART = re.compile(r"(?<![A-Za-z])[A-Za-z][a-z]{3,14}(?![a-z])|(?<=[a-z])[A-Z][a-z]{3,14}(?![a-z])")


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = 8192, held: int = 1 << 18) -> list[str]:
    """The words, lower-cased, that occur more often than some number in all documents, ``most`` at most, the rarest first.
    A worker holds about ``held`` words at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n: Counter = Counter()
        for batch in batches:
            for value in batch.column(0):
                n.update(map(str.lower, PART.findall(value.as_py() or "")))
                if len(n) > held:
                    yield rows(n)
                    n = Counter()
        yield rows(n)

    def rows(n: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], names=["word", "n"])

    counts = docs.select(named(text_col).alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    got = frequent(Scratch(docs.sparkSession, "secrets").save(counts, "words"), most).toPandas()
    return got.sort_values(["n", "word"])["word"].tolist()


class Novelty:
    def __init__(self, words: list[str] = (), context: int = 256, least: float = 0.75):
        import zstandard

        self.context, self.least = context, least
        known = zstandard.ZstdCompressionDict(" ".join([*words, IDENTIFIERS]).lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        known.precompute_compress(level=12)
        self.zip = zstandard.ZstdCompressor(level=12, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)

    def added(self, around: bytes, candidate: bytes) -> int:
        """The bytes that the candidate adds to the compressed form of its surroundings."""
        return len(self.zip.compress(around + candidate)) - len(self.zip.compress(around))

    def spans(self, text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
        out, taken, furthest = [], sorted(taken), [0]
        for _, y in taken:
            furthest.append(max(furthest[-1], y))
        for m in CANDIDATE.finditer(text):
            a, b = m.span()
            s = m[0]
            if furthest[bisect_left(taken, (b,))] > a or not (SENSITIVE.search(text, max(0, a - 48), a) or SENSITIVE.search(text, b, b + 48)):
                continue
            around = (text[max(0, a - self.context) : a] + text[b : b + self.context]).lower().encode("utf-8", "replace")
            if self.added(around, s.lower().encode()) >= self.least * len(s):
                out.append((a, b))
        return out


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """start, end and kind, by start, then kind as listed. Code points, end exclusive."""
    found = []
    low = text.lower()
    if any(h in low for h in HINTS):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def listed(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.75, context: int = 256, words: list[str] | None = None) -> DataFrame:
    """One row per input row, repeats too: id, n_assign, n_access, n_hex, n_novel, base_sha256, spans, found.

    found: an array of (kind, start, end, text). Null and empty texts have no spans, and base_sha256 of
    the empty string. Novel spans never overlap the base ones. words: the dictionary, the rarest first; without,
    corpus_words of docs. Spans that begin at one place are in the order of their kinds. Other columns are not read."""
    known = corpus_words(docs, text_col) if words is None else words

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(known, context, least)
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text)
                every = base
                if new := novelty.spans(text, [x[:2] for x in base]):
                    every = sorted([*base, *((a, b, "novel") for a, b in new)], key=lambda x: (x[0], KINDS.index(x[2])))
                kinds = [k for _, _, k in every]
                for to, v in zip(out, (*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(every), [{"kind": k, "start": a, "end": b, "text": text[a:b]} for a, b, k in every])):
                    to.append(v)
            found = pa.array(out[6], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in out[:4]), *(pa.array(c, pa.string()) for c in out[4:6]), found], names=names)

    names = ["id", "n_assign", "n_access", "n_hex", "n_novel", "base_sha256", "spans", "found"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(scan, f"id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long,text:string>>").withColumnRenamed("id", id_col)
