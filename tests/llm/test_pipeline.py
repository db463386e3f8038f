import os
import random
from collections import Counter

import pytest

import corpus_pipeline
from kvlake.llm import langid, mixing, packing, queries
from kvlake.sources.shared import shared_folder
from tests.llm.test_dedup import brute_near
from tests.llm.test_small_operators import low


def test_stages_against_brute_force(spark, tmp_path):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, out = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        out.append(docs)
    told, exact, near, mixed, packed = out
    assert all(d.columns == columns for d in out[:-1])
    first = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    model = langid.fit(spark.read.parquet(f"{sf}/documents.parquet").where(~queries.held_out()))
    a = {r.doc_id: r for r in told.collect()}
    assert set(a) == {d for d, p in zip(first, model.predict([r.text for r in first.values()])) if p[0] != "und" and p[1] >= corpus_pipeline.LEAST_SCORE}
    assert all(r == first[d] for d, r in a.items())
    least = {}
    for d in sorted(a):
        least.setdefault(low(a[d].text), d)
    b = {r.doc_id: r for r in exact.collect()}
    assert set(b) == set(least.values()) and all(r == first[d] for d, r in b.items())
    want = brute_near({d: r.text for d, r in b.items()}, 5)
    c = {r.doc_id: r for r in near.collect()}
    assert set(c) == {d for d, v in want.items() if v[2]}
    copies = Counter(r.doc_id for r in mixed.collect())
    sizes, taken = Counter(), Counter()
    for d, r in c.items():
        n = len(r.text.encode().split())
        sizes[r.source] += n
        taken[r.source] += n * copies[d]
    goal = mixing.targets(sizes)
    assert set(copies) <= set(c) and max(copies.values()) <= 2
    assert all(abs(taken[s] - goal[s]) <= max(0.02 * goal[s], 60) for s in goal if sum(r.source == s for r in c.values()) > 12)
    rows = packed.collect()
    assert Counter(r.doc_id for r in rows if r.piece == 0) == copies
    assert sum(r.length for r in rows) / 2048 <= len({r.sequence_id for r in rows}) <= 1.02 * sum(r.length for r in rows) / 2048 + 2
    encode = packing.Encoder(queries.tokenizer_path())
    once = [r for r in rows if copies[r.doc_id] == 1]
    fills = Counter()
    for r in rows:
        fills[r.sequence_id] += r.length
    assert max(fills.values()) <= 2048
    for r in once[:50]:
        assert sum(x.length for x in once if x.doc_id == r.doc_id) == len(encode(first[r.doc_id].text)) + 1


def test_run(spark):
    df = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert df.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "copy"] and df.count() > 0
    assert df.select("copy", "piece").distinct().count() == df.count()


def test_run_leaves_nothing_behind(spark, monkeypatch):
    """While it runs each stage finds only its predecessor's table; after an error there is none."""
    root, seen = shared_folder(spark).removeprefix("file:"), []

    def there():
        return {x for x in os.listdir(root) if any(files for _, _, files in os.walk(f"{root}/{x}"))}

    def watched(name, stage):
        def run(spark, docs, sf):
            seen.append(there() - before)
            if name == "mixing":
                raise RuntimeError("lost")
            return stage(spark, docs, sf)

        return name, run

    before = there()
    df = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    left = there() - before
    assert len(left) == 1 and df.count() > 0 and os.listdir(f"{root}/{min(left)}") == ["packed" if os.path.isdir(f"{root}/{min(left)}/packed") else "packing"]
    before = there()
    monkeypatch.setattr(corpus_pipeline, "STAGES", [watched(*x) for x in corpus_pipeline.STAGES])
    with pytest.raises(RuntimeError, match="lost"):
        corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [len(x) for x in seen] == [0, 1, 1, 1] and there() == before


def test_odd_tables(spark, odd, none):
    for docs in (odd, none):
        for _, stage in corpus_pipeline.STAGES:
            docs = spark.createDataFrame((d := stage(spark, docs, "")).collect(), d.schema)
    assert docs.count() == 0


def test_clashing_columns_and_repeated_rows(spark):
    r = random.Random(3)
    text = [" ".join(r.choice(["the", "house", "river", "and", "stone", "walks", "over"]) + "ly" * r.randrange(3) for _ in range(60)) for _ in range(30)]
    rows = [(i, t, "en", "ab"[i % 2], i, "x", 0.1, "y", 5, "z", 1, 2, None) for i, t in enumerate(text)]
    rows += [rows[4]] * 3 + [(None, text[5], "en", "a", None, None, None, None, None, None, None, None, None)]
    names = ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score", "a.b", "__copies", "row", "key", "copies", "ident"]
    kinds = ["long", "string", "string", "string", "long", "string", "double", "string", "int", "string", "int", "int", "string"]
    docs = spark.createDataFrame(rows, ", ".join(f"`{n}` {k}" for n, k in zip(names, kinds))).repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, docs = docs, spark.createDataFrame((made := stage(spark, docs, "")).collect(), made.schema)
        assert docs.columns == names, name
        ids = Counter(x.doc_id for x in docs.collect())
        if name == "exact_dedup":
            assert before.count() == 34 and ids == Counter(range(30))  # repeats and the copy without an id are gone
    assert set(ids) <= set(range(30)) and max(ids.values()) <= 2
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").where("piece = 0").count() == sum(ids.values())
