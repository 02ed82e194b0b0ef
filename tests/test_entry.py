import glob
import math
import os

import pytest

import __spark_entry__ as entry
from marlstone.plans import behaviour, declared, evaluated, reconciled, witnessed
from marlstone.plans import catalogue as core

DATA = "/root/testdata/sf0.001"


def _norm(v):
    v = v.tolist() if hasattr(v, "tolist") else v
    return "null" if v is None else repr(round(v, 5) + 0.0) if isinstance(v, float) and not math.isnan(v) else repr(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def one_run():
    """The stages of the reconciliation are computed once for all its queries."""
    kept, plain = {}, reconciled.Stages

    def stages(spark, d):
        if d not in kept:
            kept[d] = plain(spark, d)
        return kept[d]

    modules = (behaviour, declared, evaluated, reconciled, witnessed)
    for m in modules:
        m.Stages = stages
    yield
    for m in modules:
        m.Stages = plain


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(core.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(core.ORACLE))
def test_same_rows_as_sql(spark, duck, name):
    df = core.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(_norm(r[c]) for c in columns) for r in df.collect())
    rel = duck.sql(core.ORACLE[name])
    assert sorted(rel.columns) == columns
    places = [rel.columns.index(c) for c in columns]
    assert got == sorted(tuple(_norm(r[i]) for i in places) for r in rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(core.QUERIES) - set(core.ORACLE)))
def test_runs(spark, duck, name):
    assert core.QUERIES[name](spark, DATA).count() > 0


def test_flagship(spark, duck):
    assert entry.entry(spark).columns == ["source", "sink", "users", "min_gap", "mean_gap"]


def test_the_library_stands_without_the_text_operators():
    root = os.path.dirname(core.__file__) + "/.."
    for folder in ("operators", "sources", "functions", "plans", "streaming"):
        for path in glob.glob(f"{root}/{folder}/*.py"):
            assert ".llm" not in open(path).read()
