"""Best-two-fit packing of tokenized documents into sequences of fixed length.

Documents longer than a sequence are cut into whole sequences, after a first piece that takes the rest.
The other pieces are packed in blocks of bounded size (a block wastes less than one sequence): a bin
opens with the longest piece left and takes the longest that fits until none does; then its smallest
piece is given back if two unpacked pieces fill the gap it leaves more tightly.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, named

# The pattern that byte-level tokenizer files imply, and the bytes that stand for themselves
# in their vocabularies; the other bytes stand, in order, as the characters from 256 on.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = (*range(33, 127), *range(161, 173), *range(174, 256))
#: The last but one branch of PATTERN goes back through white space: from some length of a run on, tiktoken's
#: stack overflows. Python's white space holds all of tiktoken's.
LONG_BLANK = re.compile(r"(?<!\s)\s{1000}")


class Encoder:
    """Ids of whole texts by a tokenizer file. For a plain byte-level BPE whose merges are in the order of
    its ids, as in the files of public models, tiktoken gives the same ids several times faster; any other
    file is left to tokenizers, and so are texts with very long runs of white space. ``added``: added tokens of the
    file are told in texts, as tokenizers does by default, and texts that hold one are left to it; else they are text."""

    def __init__(self, path: str, added: bool = False):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = not added
        spec = json.loads(open(path, encoding="utf-8").read())
        self.fast = self._fast(spec)
        self.added = [t["content"] for t in spec.get("added_tokens", ()) if t["content"]] if added else []

    @staticmethod
    def _fast(spec: dict):
        model, before = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type", "BPE") != "BPE" or spec.get("normalizer") or spec.get("truncation") or spec.get("padding") or model.get("ignore_merges") or model.get("dropout"):
            return None
        if before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            return None
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        made = [model["vocab"].get(a + b, -1) for a, b in pairs]
        if made != sorted(set(made)) or made[:1] == [-1]:
            return None
        import tiktoken

        odd = [b for b in range(256) if b not in PLAIN]
        byte = {chr(b): b for b in PLAIN} | {chr(256 + i): b for i, b in enumerate(odd)}
        special = {t["content"] for t in spec.get("added_tokens", ())}
        ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
        return tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> list[int]:
        fast = self.fast and not LONG_BLANK.search(text) and not any(t in text for t in self.added)
        return self.fast.encode_ordinary(text) if fast else self.tok.encode(text, add_special_tokens=False).ids


_ENCODERS: dict[str, Encoder] = {}


def pieces(docs: DataFrame, tokenizer: str, length: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece of each document: id, piece, start, length, ids_crc32, copy."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer not in _ENCODERS:
            _ENCODERS[tokenizer] = Encoder(tokenizer, added=True)
        encode, copy = _ENCODERS[tokenizer], TaskContext.get().partitionId() << 33
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [], [])
            for i, text in enumerate(batch.column(1)):
                ids = np.array([*encode(text.as_py() or ""), end_id], "<u4")
                n = len(ids)
                bounds = [0, *range((n - 1) % length + 1, n + 1, length)]
                for k in range(len(bounds) - 1):
                    a, b = bounds[k], bounds[k + 1]
                    for to, v in zip(rows, (i, k, a, b - a, zlib.crc32(ids[a:b].tobytes()), copy + i)):
                        to.append(v)
            copy += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:])], names=["id", "piece", "start", "length", "ids_crc32", "copy"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long, copy long")


def best_two_fit(lengths: np.ndarray, room: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece. lengths: from 1 to room."""
    n = len(lengths)
    order = np.argsort(lengths, kind="stable")
    count = np.bincount(lengths, minlength=room + 1).tolist()
    top = np.cumsum(count).tolist()  # pieces of a length are taken from the end of their run in order
    have = 0
    for v in np.flatnonzero(count).tolist():
        have |= 1 << v
    masks = [(1 << (g + 1)) - 1 for g in range(room + 1)]
    bins, offsets = np.empty(n, np.int64), np.empty(n, np.int64)
    order = order.tolist()

    def take(v: int) -> None:
        nonlocal have
        count[v] -= 1
        if not count[v]:
            have &= ~(1 << v)

    def two(most: int, above: int) -> tuple[int, int, int]:
        """The pair of pieces left with the largest sum over above and up to most."""
        best, pair, a = above, (0, 0), (have & masks[most]).bit_length() - 1
        while a > 0 and 2 * a > best:
            b = (have & masks[min(a, most - a)]).bit_length() - 1
            if b == a and count[a] < 2:
                b = (have & masks[a - 1]).bit_length() - 1
            if b > 0 and a + b > best:
                best, pair = a + b, (a, b)
                if best == most:
                    break
            a = (have & masks[a - 1]).bit_length() - 1
        return best, *pair

    def give_back(v: int) -> None:
        nonlocal have
        count[v] += 1
        have |= 1 << v

    k = 0
    while have:
        held, gap = [], room
        while gap and (v := (have & masks[gap]).bit_length() - 1) > 0:
            take(v)
            held.append(v)
            gap -= v
        if gap and len(held) > 1:
            small = held[-1]
            best, a, b = two(small + gap, small)
            if best > small:
                take(a)
                take(b)
                give_back(small)
                held[-1:] = [a, b]
        at = 0
        for v in held:
            top[v] -= 1
            i = order[top[v]]
            bins[i], offsets[i] = k, at
            at += v
        k += 1
    return bins, offsets


def pack(docs: DataFrame, tokenizer: str, length: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", block_pieces: int = 100_000) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset, copy.

    A null text is empty: it has the end id alone. Rows that repeat are packed each by itself: copy
    is a number that all pieces of one row share and no other row has. Sequences
    are numbered by block, with gaps between blocks. An empty table gives no sequence."""
    scratch = Scratch(docs.sparkSession, "pack")
    cut = scratch.save(pieces(docs, tokenizer, length, end_id, id_col, text_col), "pieces")
    n = cut.count()
    blocks = max(1, -(-n // block_pieces))
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "copy"]

    def block(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending"), ("copy", "ascending")])
        bins, offsets = best_two_fit(table.column("length").to_numpy(), length)
        first = key[0].as_py() << 40
        return pa.table([*(table.column(c) for c in names[:5]), pa.array(bins + first), pa.array(offsets), table.column("copy")], names=names)

    dealt = cut.withColumn("block", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(block, f"id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, copy long").withColumnRenamed("id", id_col)
