from collections import Counter
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from kvlake.llm import lm, queries, topk
from kvlake.llm.common import word_hashes


def brute(vectors, asked, k):
    bits = {i: np.array([x is not None and x > 0 for x in v]) for i, v in vectors.items()}
    return {(q, n + 1): (i, d) for q in asked for n, (d, i) in enumerate(sorted((int((bits[q] != b).sum()), i) for i, b in bits.items())[:k])}


@pytest.mark.parametrize("segments", [None, 2, 4, 8])
def test_top_k(spark, segments):
    r = np.random.default_rng(4)
    vectors = {i: r.normal(size=16).tolist() for i in range(200)}
    for i in range(200, 280):
        vectors[i] = vectors[7]  # a third of the rows share one code
    df = spark.createDataFrame([(i, v) for i, v in vectors.items()], "vec_id long, embedding array<float>").repartition(3)
    got = topk.top_k(df, df.where("vec_id % 20 = 0"), k=5, bits=16, segments=segments, entry_block=50, query_block=6).collect()
    assert {(x.query_id, x["rank"]): (x.vec_id, x.distance) for x in got} == brute(vectors, range(0, 280, 20), 5) and len(got) == 14 * 5


def test_top_k_of_all_places(spark):
    """Vectors of more places than a code of 64 bits has, and of a number that no segment width divides."""
    r = np.random.default_rng(5)
    vectors = {i: r.normal(size=67 if i % 2 else 71).tolist() for i in range(60)}
    padded = {i: v + [0.0] * (71 - len(v)) for i, v in vectors.items()}
    df = spark.createDataFrame(list(vectors.items()), "vec_id long, embedding array<float>")
    for bits in (None, 66):
        got = topk.top_k(df, df, k=3, bits=bits).collect()
        assert {(x.query_id, x["rank"]): (x.vec_id, x.distance) for x in got} == brute({i: v[:bits] for i, v in padded.items()}, vectors, 3)
    with pytest.raises(ValueError):
        topk.top_k(df, df, bits=64, segments=2)


def test_top_k_odd(spark):
    rows = [(1, [1.0, None, 1.0, -1.0]), (2, None), (3, []), (4, [1.0]), (None, [1.0] * 4), (5, [float("nan"), -1.0, 1.0, 1.0, 9.0]), (5, [float("nan"), -1.0, 1.0, 1.0, 9.0])]
    df = spark.createDataFrame([(*r, 3, 4) for r in rows], "vec_id long, embedding array<float>, segs int, q int")
    got = topk.top_k(df, df, k=10, bits=4, segments=2).collect()
    vectors = {1: [1, 0, 1, 0], 3: [0] * 4, 4: [1, 0, 0, 0], 5: [0, 0, 1, 1]}
    assert {(x.query_id, x["rank"]): (x.vec_id, x.distance) for x in got} == brute(vectors, vectors, 10) and len(got) == 16
    assert topk.top_k(df.limit(0), df, bits=4, segments=2).count() == 0


SMALL = lm.Config(top=50, groups=8, signs=6, inputs=40, classes=12, alone=5, reach=2, rounds=2, chunk=32)


def hashed(texts):
    """Word hashes of texts end to end, and where each text's begin."""
    data = [(t or "").encode() for t in texts]
    return word_hashes(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))


def test_around_stays_in_its_document():
    got = lm.around(np.arange(1, 7), np.array([0, 2, 6]), [-2, -1, 1, 2], 0)
    assert got.T.tolist() == [[0, 0, 2, 0], [0, 1, 0, 0], [0, 0, 4, 5], [0, 3, 5, 6], [3, 4, 6, 0], [4, 5, 0, 0]]


def test_odds_of_any_size():
    """Also where e to the power of a weight is more, or less, than a float holds."""
    for shift in (0, 300, -300):
        z = np.array([[1.0, 2.0, 3.0], [0.0, -400.0, 5.0]], np.float32) + np.float32(shift)
        z, e, total = lm.raised(z)
        p = e / total[:, None]
        assert np.allclose(p, [[0.09003, 0.24473, 0.66524], [0.00669, 0, 0.99331]], atol=1e-4)
        assert np.allclose(z[:, 2] - np.log(total), np.log(p[:, 2]), atol=1e-4)
    assert np.allclose(lm.turned(np.arange(12.0).reshape(4, 3), 3), np.arange(12.0).reshape(4, 3).T)


def test_find():
    r = np.random.default_rng(1)
    close = (np.uint64(7) << np.uint64(60)) + np.arange(50, dtype=np.uint64) * np.uint64(3)  # all with the same first bits
    for head in (np.zeros(0, np.uint64), np.sort(r.integers(0, 2**64, 3000, dtype=np.uint64)), close, np.array([0, 2**64 - 1], np.uint64)):
        words = np.concatenate([head, r.integers(0, 2**64, 500, dtype=np.uint64), close, close + np.uint64(1), np.array([0, 2**64 - 1], np.uint64)])
        place = {int(w): i for i, w in enumerate(head)}
        assert lm.find(words, head, lm.lookup(head)).tolist() == [place.get(int(w), -1) for w in words]


def test_slopes():
    """Gradient and Hessian of the log-likelihood by the gains, against differences."""
    r = np.random.default_rng(0)
    weights, bias, near, target = r.normal(size=(24, 5)), r.normal(size=5), r.integers(0, 6, (4, 40)) + np.arange(4)[:, None] * 6, r.integers(0, 5, 40)
    gains, places = np.array([0.9, 0.5, 0.7]), [-2, -1, 1, 2]
    net = lambda g: lm.Network(weights * np.repeat([g[2], g[1], g[1], g[2]], 6)[:, None], bias * g[0])
    value = lambda g: np.log(net(g).probabilities(near)[np.arange(40), target]).sum(dtype=float)
    plain = lm.Network(weights, bias)
    got = plain.slopes(near, target, gains, places)
    e = np.eye(3) * 1e-2
    assert np.allclose(got[:, 0], [(value(gains + x) - value(gains - x)) / 2e-2 for x in e], atol=2e-2)
    for i, x in enumerate(e):
        change = plain.slopes(near, target, gains + x, places)[:, 0] - plain.slopes(near, target, gains - x, places)[:, 0]
        assert np.allclose(-change / 2e-2, got[:, 1 + i], atol=5e-2)


def slow_model(texts, rounds_of, c):
    """The whole of the training, word by word. rounds_of: the round of each text."""
    words = [hashed([t])[0] for t in texts]
    counts = Counter(int(w) for ws in words for w in ws)
    top = {w: i for i, w in enumerate(sorted(counts, key=lambda w: (-counts[w], w))[: c.top])}
    row = lambda w: top.get(w, len(top) + w % c.groups)
    mass, kinds, profile = np.zeros(len(top) + c.groups), np.zeros(len(top) + c.groups), np.zeros((len(top) + c.groups, c.signs))
    for w, n in counts.items():
        mass[row(w)] += n
        kinds[row(w)] += 1
    near = lambda ws, i: [ws[i + d] if 0 <= i + d < len(ws) else None for d in range(-c.reach, c.reach + 1) if d]
    words = [[int(w) for w in ws] for ws in words]
    for ws in words:
        for i, w in enumerate(ws):
            for x in near(ws, i):
                if x is not None and top.get(x, c.signs) < c.signs:
                    profile[row(w), top[x]] += 1
    points = np.sqrt((profile + 2 * profile.sum(axis=0) / profile.sum()) / (profile.sum(axis=1, keepdims=True) + 2))
    klass = np.concatenate([np.arange(c.alone), c.alone + lm.clusters(points[c.alone :], mass[c.alone :], c.classes - c.alone)])
    total, share = np.full(c.classes, 0.1), np.full(c.classes, 0.1)
    np.add.at(total, klass, mass + 0.1 * kinds)
    np.add.at(share, klass, mass)
    share /= share.sum()
    own = c.inputs - c.classes - 1
    entry = lambda x: c.inputs - 1 if x is None else top[x] if top.get(x, own) < own else own + klass[row(x)]
    places = 2 * c.reach

    def sights(k=None):
        for ws, r in zip(words, rounds_of):
            if k is None or r == k:
                for i, w in enumerate(ws):
                    yield [j * c.inputs + entry(x) for j, x in enumerate(near(ws, i))], klass[row(w)]

    met = np.zeros((places * c.inputs, c.classes))
    for x, y in sights():
        met[x, y] += 1
    bias = np.log(share)
    weights = np.log((met + 5 * share) / (met.sum(axis=1, keepdims=True) + 5)) - bias
    soft = lambda z: np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    far = [abs(d) for d in range(-c.reach, c.reach + 1) if d]
    gains, gradient, hessian = np.array([1.0] + [c.gain] * c.reach), np.zeros(c.reach + 1), 10 * np.eye(c.reach + 1)
    for x, y in sights(0):
        f = np.stack([bias, *(sum(weights[i] for i, d in zip(x, far) if d == e) for e in range(1, c.reach + 1))])
        p = soft(gains @ f)
        gradient += f[:, y] - f @ p
        hessian += (f * p) @ f.T - np.outer(f @ p, f @ p)
    gains = np.clip(gains + np.linalg.solve(hessian, gradient), 0, 2)
    bias, weights = bias * gains[0], weights * np.repeat(gains[far], c.inputs)[:, None]
    there, thought = np.zeros_like(weights), np.zeros_like(weights)
    for x, y in sights(1):
        there[x, y] += 1
        thought[x] += soft(bias + weights[x].sum(axis=0))
    weights = weights + np.log((there + 5 * share) / (thought + 5 * share)) / places

    def score(text):
        ws = [int(w) for w in hashed([text])[0]]
        out = 0.0
        for i, w in enumerate(ws):
            z, k = bias + weights[[j * c.inputs + entry(x) for j, x in enumerate(near(ws, i))]].sum(axis=0), klass[row(w)]
            out += np.log(soft(z)[k]) + np.log(counts[w] + 0.1) - np.log(total[k])
        return len(ws), out

    return bias, weights, np.log(total), score


@pytest.mark.parametrize("head", [50, 1 << 18])
def test_training_against_a_loop(spark, documents, head):
    """Each word has a count of its own, whether it goes to every task or is joined in."""
    c = replace(SMALL, head=head)
    docs = documents.where("length(text) < 1500").limit(60).withColumn("k", F.pmod(F.xxhash64("text"), F.lit(2))).cache()
    rows = docs.collect()
    bias, weights, total, score = slow_model([r.text for r in rows], [r.k for r in rows], c)
    model = lm.fit(docs.repartition(3), config=c)
    assert len(model.head) <= head and (model.rank >= 0).sum() <= 50
    asked = {r.doc_id: r.text for r in rows[:25]} | {-1: "the wholly-unseen-word-1 the", -2: None}
    again = spark.createDataFrame([*asked.items(), (-2, None)], "doc_id long, text string").repartition(3)
    got = lm.score(again, model).collect()
    assert len(got) == len(asked) + 1
    if (model.rank >= 0).sum() == 50:  # a head that ends among equal counts is shorter, and its top other words
        assert np.allclose(model.total, total) and np.allclose(model.bias, bias, rtol=1e-4) and np.allclose(model.weights, weights, atol=1e-4)
        for r in got:
            n, want = score(asked[r.doc_id])
            assert r.n_words == n and r.log_likelihood == pytest.approx(want, rel=1e-4)
            assert r.per_word == (pytest.approx(want / n, rel=1e-4) if n else None)
    counts = Counter(w for r in rows for w in hashed([r.text])[0].astype(np.int64).tolist())
    assert {r.word: r.n for r in model.counts.collect()} == counts


def test_probabilities_of_all_words_sum_to_one(documents):
    """Over the corpus's words and one unseen word for each class, at any place."""
    model = lm.fit(documents, config=SMALL)
    n = {r.word: r.n for r in model.counts.collect()}
    words = np.array(list(n), np.int64).view(np.uint64)
    klass = model.klass[model.rows(words, model.ranks(words))]
    within = np.bincount(klass, weights=np.array(list(n.values())) + 0.1, minlength=12) + 0.1
    assert np.allclose(np.log(within), model.total)
    assert lm.Network(model.weights, model.bias).probabilities(np.array([[3], [45], [90], [159]])).sum() == pytest.approx(1, abs=1e-5)


def test_learns_whatever_the_partitions(spark):
    """The pseudo-likelihood of all documents beats the unigram of exact counts by 15 %, and no score moves with the partitions."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = hashed([r.text for r in docs.collect()])[0]
    n = np.unique(words, return_counts=True)[1]
    unigram = (n * np.log((n + 0.1) / (len(words) + 0.1 * len(n) + 0.1))).sum()
    scores = []
    for parts in (1, 8, 200):
        got = lm.score(docs, lm.fit(docs.repartition(parts))).collect()
        assert sum(r.log_likelihood for r in got) > 0.85 * unigram
        scores.append({r.doc_id: r.log_likelihood for r in got})
    for other in scores[1:]:
        assert all(other[d] == pytest.approx(v, rel=1e-4) for d, v in scores[0].items())


def test_learns_both_sides(spark):
    """b or d lies between a..c or e..f: only the words around tell which."""
    r = np.random.default_rng(3)
    texts = [" ".join(x for _ in range(40) for x in (("a", "b", "c") if r.random() < 0.5 else ("e", "d", "f"))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    model = lm.fit(docs)
    probe = spark.createDataFrame([(0, "a b c e d f a b c"), (1, "a d c e b f a d c")], "doc_id long, text string")
    good, bad = (r.log_likelihood for r in lm.score(probe, model).orderBy("doc_id").collect())
    assert good > bad + 3


@pytest.mark.parametrize("config", [SMALL, lm.Config(head=2), lm.Config(head=0, rounds=0), None])
def test_lm_odd(odd, none, config):
    model = lm.fit(odd, config=config)
    scored = lm.score(odd.withColumnRenamed("doc_id", "a b.c"), model, "a b.c").collect()
    got = {r[0]: r for r in scored}
    assert len(scored) == 16 and sum(r.per_word is None for r in scored) == 3
    assert got[0].n_words == got[1].n_words == got[2].n_words == 0 and got[0].log_likelihood == 0 and got[0].per_word is None
    assert got[3].log_likelihood < 0 and np.isfinite(got[6].log_likelihood) and got[6].n_words == 60_000
    empty = lm.fit(none, config=config)
    assert lm.score(none, empty).count() == 0 and all(np.isfinite(r.log_likelihood) for r in lm.score(odd, empty).collect())


def test_lm_query(spark, sf, documents):
    got = {r.doc_id: r for r in queries.op8_lm_score(spark, sf).collect()}
    assert {d: r.n_words for d, r in got.items()} == {r.doc_id: len((r.text or "").encode().split()) for r in documents.collect()}


def test_top_k_query(spark, sf):
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    got = queries.op7_topk(spark, sf).collect()
    assert {(x.query_id, x["rank"]): (x.vec_id, x.distance) for x in got} == brute(vectors, [i for i in vectors if i % 100 == 0], 10)
