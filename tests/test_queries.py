"""Every query of the store against its SQL in DuckDB."""

import os
import sys

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from kvlake.plans import queries as core
from kvlake.sources.shared import shared_folder

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.sql(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    return c


def plain(frame, columns):
    return sorted(repr(tuple(None if pd.isna(v) else round(float(v), 6) if not isinstance(v, str) and type(v).__name__ not in ("bool", "bool_") else v for v in r)) for r in frame[columns].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", core.ORACLES)
def test_against_sql(spark, con, name):
    got, want = core.QUERIES[name](spark, SF).toPandas(), con.sql(core.ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and plain(got, columns) == plain(want, columns)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("missing", ["kvlake.llm", "kvlake.llm.queries", "corpus_pipeline"])
def test_entry_without_the_corpus_operators(monkeypatch, missing):
    """A module that isn't there, or that lacks something it imports, leaves the store's queries whole."""
    for name in [m for m in sys.modules if m.startswith("kvlake.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    got = __spark_entry__.queries()
    assert set(core.QUERIES) <= set(got) and "pipeline" not in got
    assert set(core.ORACLES) <= set(__spark_entry__.oracle_sql())


def test_no_machine_local_folder_on_a_cluster(monkeypatch):
    class Context:
        master, getCheckpointDir = "spark://host:7077", staticmethod(lambda: None)

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(Session())


def test_all_runs_and_rows(spark):
    """More rows than three of eight runs have, and the rate over every row outside layer 0."""
    m = core.mut(spark, SF).toPandas()
    assert core.QUERIES["kway_merge_all"](spark, SF).count() == len(m) + (m["run"] == 2).sum()
    probed = m[m["layer"] != 0]
    assert core.QUERIES["false_positive_rate_all"](spark, SF).first().rate == pytest.approx(probed["key"].isin(m["key"][m["layer"] == 0]).mean())


def test_all_keys_are_probed(spark, tmp_path):
    """With more than 400 customers."""
    for f in ("events", "customer"):
        spark.read.parquet(f"/root/testdata/sf0.1/{f}.parquet").write.parquet(f"{tmp_path}/{f}.parquet")
    keys = {str(r.c_custkey) for r in core.table(spark, str(tmp_path), "customer").collect()}
    assert len(keys) > 400
    assert {r.key for r in core.QUERIES["multi_get_all"](spark, str(tmp_path)).collect()} == keys | {""}
    assert {r.key for r in core.QUERIES["store_multi_get_all"](spark, str(tmp_path)).collect()} == keys
