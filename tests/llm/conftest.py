import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, ident long, size long, key string, rid int, run int, keep_id long, fp long, bucket long, block int, h int, salt int, w1 long, component_id long"


def rows(texts, ids=None, langs=None, sources=None):
    n = len(texts)
    ids = ids or list(range(n))
    return [(ids[i], t, (langs or ["en"] * n)[i], (sources or ["a"] * n)[i], len(t or ""), *[7] * 2, "k", *[7] * 10) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, ties, repeated rows; columns whose names clash."""
    r = random.Random(5)
    long = " ".join(r.choice(["alpha", "beta", "gamma", "delta", "Épsilon"]) + str(r.randrange(50)) for _ in range(60_000))
    texts = [None, "", "  \t\n ", "One", "one", "ONE ", long, long.upper(), "a b c", "a b c", "12 34 !!", "é è ü x y", "x" * 300_000, "tail  \n"]
    data = rows(texts, sources=["a", None, "b", "a", "c", None, "a", "b", "a", "a", "é", "Z", "a", "b"], langs=["en", None, "fr", "en", None, "en", "fr", "en", "de", "de", None, "fr", "en", "en"])
    data.append((None, "no id", None, None, *[None] * 14))
    data.append(data[8])
    return spark.createDataFrame(data, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf(spark):
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
