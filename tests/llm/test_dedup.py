import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvlake.llm import near_dedup, queries, substring
from kvlake.llm.common import word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_substring(texts, window=20):
    seen, out = set(), {}
    for d in sorted(texts):
        words = WORD.findall(texts[d] or "")
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            w = tuple(words[i : i + window])
            if w in seen:
                gone[i : i + window] = [True] * window
            seen.add(w)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[d] = (len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


@pytest.mark.parametrize("batches", [1, 2, 7])
def test_substring(documents, batches):
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = substring.substring_dedup(documents.repartition(3), batches=batches, fan=2).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_substring(texts)
    assert len(got) == len(texts) and any(r.n_removed for r in got)


def test_substring_within_and_across(spark):
    r = random.Random(3)
    words = [f"w{i}" for i in range(7)]
    texts = {}
    for d in range(60):
        t = [r.choice(words) for _ in range(r.randrange(0, 80))]
        if d % 3 == 0:
            t = t + t  # a passage that repeats in its own document
        if d % 4 == 0 and d:
            other = (texts[r.randrange(d)] or "").split()
            t[5:5] = other[: r.randrange(0, 60)]
        texts[d] = r.choice([" ", "\n", "\t "]).join(t)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for gram in (3, 8):
        got = substring.substring_dedup(docs, window=12, gram=gram, batches=3).collect()
        assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_substring(texts, 12)


def test_substring_query(spark, monkeypatch):
    """The query as registered, with its parameters: equal to brute force, and its index is compacted on the way."""
    compact, times = substring.WindowIndex.compact, []
    monkeypatch.setattr(substring.WindowIndex, "compact", lambda self: (times.append(len(self.state["runs"])), compact(self)))
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    set_ = [spark.conf.get(k) for k in (*substring.IN_BUCKETS, substring.CLEANUP, "spark.sql.requireAllClusterKeysForCoPartition")]
    got = queries.op1_substring(spark, sf).collect()
    assert set_ == [spark.conf.get(k) for k in (*substring.IN_BUCKETS, substring.CLEANUP, "spark.sql.requireAllClusterKeysForCoPartition")] == ["true", "false", "false", "true"]
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == brute_substring(texts) and len(got) == len(texts)
    assert times == [2]  # the last batch meets compacted history
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("kvlake_")]


def test_index_takes_batches_after_it_was_closed(spark, documents, tmp_path):
    """Opened again, as by another session, it goes on where it was left; history is joined without a shuffle."""
    texts = {r.doc_id: r.text for r in documents.collect()}
    docs, cut = documents.select(F.col("doc_id").alias("id"), "text").repartition(3), sorted(texts)[60]
    got = {}
    for part, fan in ((docs.where(F.col("id") < cut), 4), (docs.where((F.col("id") >= cut) & (F.col("id") < 2 * cut)), 9), (docs.where(F.col("id") >= 2 * cut), 9)):
        index = substring.WindowIndex(spark, str(tmp_path / "index"), fan=fan, buckets=4)
        assert index.state["fan"] == 4
        got |= {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.ingest(part).collect()}
        index.close()
    assert got == brute_substring(texts)
    index = substring.WindowIndex(spark, str(tmp_path / "index"))
    a, b = (index.run(r["name"]) for r in index.state["runs"][:2])
    with substring.settings(spark, *substring.IN_BUCKETS):
        plan = a.hint("merge").join(b.select("fp", "salt"), ["fp", "salt"], "left_semi")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    with pytest.raises(ValueError, match="above"):
        index.ingest(docs)
    before = sum(index.run(r["name"]).count() for r in index.state["runs"])
    index.compact()
    assert len(index.state["runs"]) == 1 and 0 < index.run(index.state["runs"][0]["name"]).count() < before
    again = substring.WindowIndex(spark, str(tmp_path / "index"))
    more = spark.createDataFrame([(10**9, texts[0] + " new words"), (10**9 + 1, "nothing of this was there")], "id long, text string")
    want = brute_substring(texts | {10**9: texts[0] + " new words", 10**9 + 1: "nothing of this was there"})
    assert {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in again.ingest(more).collect()} == {d: want[d] for d in (10**9, 10**9 + 1)}
    index.close()
    again.close()


def test_a_batch_that_failed_leaves_no_trace(spark, documents, tmp_path, monkeypatch):
    """Whichever step it fails in, the index opens as it was and takes the batch again."""
    texts = {r.doc_id: r.text for r in documents.collect()}
    docs, cut = documents.select(F.col("doc_id").alias("id"), "text").repartition(2), sorted(texts)[100]
    index = substring.WindowIndex(spark, str(tmp_path / "index"), fan=1, buckets=3)
    got = {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.ingest(docs.where(F.col("id") < cut)).collect()}
    index.close()

    def lost(*args, **more):
        raise RuntimeError("lost")

    for where, what in ((substring.WindowIndex, "_active"), (substring, "finished"), (substring.WindowIndex, "compact"), (substring.WindowIndex, "_commit")):
        with monkeypatch.context() as m:
            m.setattr(where, what, lost)
            index = substring.WindowIndex(spark, str(tmp_path / "index"))
            with pytest.raises(RuntimeError, match="lost"):
                index.ingest(docs.where(F.col("id") >= cut))
            index.close()
    index = substring.WindowIndex(spark, str(tmp_path / "index"))
    assert index.version == 1
    got |= {r.id: (r.n_words, r.n_removed, r.kept_sha256) for r in index.ingest(docs.where(F.col("id") >= cut)).collect()}
    index.close()
    assert got == brute_substring(texts)


def test_history_holds_a_passage_once(spark, tmp_path):
    """And fingerprints that are common in a run, in history or in both are dealt out and still found."""
    r = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(60))
    tail = lambda: " ".join(f"w{r.randrange(10**6)}" for _ in range(30))
    texts = {i: f"{tail()} {passage} {tail()}" if i % 3 else tail() for i in range(1500)}
    docs = spark.createDataFrame(list(texts.items()), "id long, text string").repartition(4)
    index, got = substring.WindowIndex(spark, str(tmp_path / "index"), buckets=16), {}
    for lo, hi in ((0, 700), (700, 710), (710, 1500)):
        got |= {x.id: (x.n_words, x.n_removed, x.kept_sha256) for x in index.ingest(docs.where(F.col("id").between(lo, hi - 1))).collect()}
    assert got == brute_substring(texts)
    first = index.run(index.state["runs"][0]["name"])
    assert index.state["runs"][0]["common"] and index.state["runs"][2]["common"] and not index.state["runs"][1]["common"]
    assert first.where("salt > 0").count() > 0
    inside = word_hashes(np.frombuffer(passage.encode(), np.uint8), np.array([0, len(passage)]))[0]
    grams = substring._rolled(inside, 8, 1)
    deep = {int(x) for x in grams[substring.choices(grams[13:-13], 13) + 13].view(np.int64)}
    assert deep and first.where(F.col("fp").isin(*deep)).count() > 100
    index.compact()
    whole = index.run(index.state["runs"][0]["name"])
    assert whole.where(F.col("fp").isin(*deep)).count() <= len(deep)
    again = spark.createDataFrame([(5000, f"a b {passage} c"), (5001, texts[0])], "id long, text string")
    want = brute_substring(texts | {5000: f"a b {passage} c", 5001: texts[0]})
    assert {x.id: (x.n_words, x.n_removed, x.kept_sha256) for x in index.ingest(again).collect()} == {d: want[d] for d in (5000, 5001)}
    index.close()


def test_substring_odd(odd, none):
    got = {r.doc_id: r for r in substring.substring_dedup(odd.where("doc_id is null or doc_id <> 8"), with_text=True).collect()}
    texts = {r.doc_id: r.text for r in odd.collect() if r.doc_id not in (None, 8)}
    assert {d: (r.n_words, r.n_removed, r.kept_sha256) for d, r in got.items() if d is not None} == brute_substring(texts)
    assert got[None].kept_text == "no id" and got[0].n_words == 0 and got[0].kept_sha256 == hashlib.sha256(b"").hexdigest()
    assert substring.substring_dedup(odd).count() == 16
    assert substring.substring_dedup(none).count() == 0


def test_word_hashes_do_not_depend_on_place():
    texts = ["ab c", "c  ab", "", "é ab", "x", "abc"]
    data = b"".join(t.encode() for t in texts)
    at = np.cumsum([0, *(len(t.encode()) for t in texts)])
    for stride in (1, 4, 1 << 20):
        h, first = word_hashes(np.frombuffer(data, np.uint8), at, stride=stride)
        assert first.tolist() == [0, 2, 4, 4, 6, 7, 8]
        assert h[0] == h[3] == h[5] and h[1] == h[2] and len({*h.tolist()}) == 5


# --- near duplicates -----------------------------------------------------------------------


def shingles(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set()


def brute_near(texts, width, percent=80):
    sets = {d: shingles(t, width) for d, t in texts.items()}
    parent = {d: d for d in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x] = parent[parent[x]]
        return x

    ids = sorted((d for d in sets if sets[d]), key=lambda d: len(sets[d]))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if len(x) * 100 < percent * len(y):
                break
            n = len(x & y)
            if 100 * n >= percent * (len(x) + len(y) - n):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d), find(d) == d) for d in texts}


def result(df):
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in df.collect()}


def test_near_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert result(queries.op2_near_dedup(spark, sf)) == brute_near(texts, 2)


def test_near_chains_and_borders(spark):
    """Groups in which the smallest id is no neighbour of most: a star alone would lose links."""
    r = random.Random(9)
    texts, d = {}, 0
    for size in (40, 60, 300):
        base = [f"g{size}_{i}" for i in range(size)]
        group = []
        for _ in range(30):
            t = list(base)
            for _ in range(r.randrange(0, max(1, size // 12))):
                t[r.randrange(size)] = f"x{r.randrange(10**6)}"
            group.append(" ".join(t))
        r.shuffle(group)
        for t in group:
            texts[d] = t
            d += 1
        step = list(base)
        for i in range(0, size // 2, 2):  # a chain: each link over the threshold, its ends far apart
            step[i] = f"y{i}"
            texts[d] = " ".join(step)
            d += 1
    for k in range(1, 12):
        for _ in range(2):
            texts[d] = " ".join(f"s{k}_{i}" for i in range(k)) + (" end" if r.random() < 0.5 else "")
            d += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    for width in (2, 5):
        assert result(near_dedup.near_dedup(docs, width=width)) == brute_near(texts, width)


def test_sketch_estimates_similarity():
    r = np.random.default_rng(2)
    sketch, gaps = near_dedup.Sketch(), []
    for n in (5, 40, 300, 3000):
        for _ in range(20):
            a = r.integers(0, 2**64, n, dtype=np.uint64)
            b = a.copy()
            b[: n // 5] = r.integers(0, 2**64, n // 5, dtype=np.uint64)
            same = (sketch.bins_of(np.unique(a)) == sketch.bins_of(np.unique(b))).mean()
            gaps.append(same - len({*a.tolist()} & {*b.tolist()}) / len({*a.tolist()} | {*b.tolist()}))
    assert abs(np.mean(gaps)) < 0.02


def test_near_odd(odd, none):
    got = result(near_dedup.near_dedup(odd.where("doc_id is not null")))
    assert got[0] == (0, 0, True) and got[1] == (0, 1, True) and got[2] == (0, 2, True)
    assert got[3] == (1, 3, True) and got[4] == (1, 3, False) and got[7][1] == 6 and got[9] == (1, 8, False)
    assert near_dedup.near_dedup(odd).count() == 16 and near_dedup.near_dedup(none).count() == 0
