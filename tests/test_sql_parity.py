"""Every registry query: SQL results, and what its physical plan may not hold."""

import glob
import numbers
import os

import duckdb
import pytest

from trialloom.plans import oracles
from trialloom.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ORACLES = oracles.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def canonical(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    value = lambda v: float(v) if isinstance(v, numbers.Number) and not isinstance(v, bool) else v
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    plan = df._jdf.queryExecution().executedPlan().toString()
    for node in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "EvalPython", "MapInPandas"):
        assert node not in plan
    got = [tuple(r) for r in df.collect()]
    assert got
    if name in ORACLES:
        result = duck.execute(ORACLES[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == sorted(df.columns)
        assert canonical(df.columns, got) == canonical(names, result.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_ranking_is_cut_before_the_shuffle(spark):
    plan = QUERIES["sc_by_condition"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
