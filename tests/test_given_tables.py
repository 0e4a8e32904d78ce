"""Deriving trials and documents from the order tables: rows by hand, and what is shuffled."""

import datetime as dt

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from trialloom.plans.given_tables import GivenTables

DAY = dt.datetime(1995, 3, 5)


def columns(names, rows):
    return {n: list(v) for n, v in zip(names.split(), zip(*rows))}


@pytest.fixture
def given(spark, tmp_path):
    """Orders without items or customer, a repeated part, a repeated customer, keys that are null."""
    tables = {
        "orders": columns("o_orderkey o_custkey o_orderstatus o_orderdate o_orderpriority", [
            (3, 2, "O", DAY, "2-HIGH"), (1, 1, "F", DAY, "5-LOW"), (2, 9, "P", DAY, "3-MEDIUM"), (None, 1, "F", DAY, "5-LOW"),
        ]),
        "lineitem": columns("l_orderkey l_partkey l_quantity l_shipdate", [
            (1, 12, 1.0, DAY), (1, 11, 2.0, DAY), (1, 11, 3.0, DAY), (3, 10, 4.0, DAY), (3, None, 5.0, DAY), (None, 10, 6.0, DAY),
        ]),
        "part": columns("p_partkey p_name p_brand p_type p_size", [
            (10, "ten", "B#1", "PROMO", 1), (11, "eleven", "B#2", "SMALL", 2), (11, "more", "B#2", "SMALL", 2),
            (12, "a twelfth", "B#3", "LARGE", 3),
        ]),
        "customer": columns("c_custkey c_name c_nationkey c_acctbal c_mktsegment", [
            (1, "One", 0, 5.0, "BUILDING"), (2, "Two", 0, -5.0, "MACHINERY"), (2, "Two", 7, -5.0, "MACHINERY"),
        ]),
        "nation": columns("n_nationkey n_regionkey", [(0, 0)]),
        "region": columns("r_regionkey r_name", [(0, "ASIA")]),
    }
    for name, content in tables.items():
        pq.write_table(pa.table(content), f"{tmp_path}/{name}.parquet")
    return GivenTables(spark, str(tmp_path))


def test_repeated_and_missing_keys(given):
    rows = given.orders("items", "names", "part", "customer", "region")
    got = rows.select("o_orderkey", "items", "quantity", "names", "p_name", "c_name", "r_name").collect()
    assert sorted(got, key=str) == sorted([
        (1, 3, 6, "a twelfth; eleven; more", "eleven", "One", "ASIA"),
        (1, 3, 6, "a twelfth; eleven; more", "more", "One", "ASIA"),
        (2, None, None, None, None, None, None),
        (3, 2, 9, "ten", "ten", "Two", "ASIA"),
        (3, 2, 9, "ten", "ten", "Two", None),
        (None, None, None, None, None, "One", "ASIA"),
    ], key=str)


def carriers(plan, column):
    """The shuffles of a physical plan whose rows hold this column."""
    found = plan.nodeName() == "Exchange" and f"{column}#" in plan.output().mkString(",")
    children = [plan.children().apply(i) for i in range(plan.children().size())]
    return int(found) + sum(carriers(c, column) for c in children)


def test_names_are_not_shuffled_after_they_are_joined(spark, given):
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {name: spark.conf.get(name) for name in settings}
    try:
        for name, value in settings.items():
            spark.conf.set(name, value)
        rows = given.orders("items", "names", "part", "customer", "region").select("o_orderkey", "names", "p_name", "r_name")
        assert carriers(rows._jdf.queryExecution().executedPlan(), "names") == 0
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_documents_share_the_joins(given):
    whole, some = given.trial_elements(), given.trial_elements(("F", "O"))
    assert not [f for df in (whole, some) for f in df.inputFiles() if "lineitem" in f]
    titles = lambda df: [r.element.split("Order\t")[1].split("<")[0] for r in df.collect() if "Order" in r.element]
    assert titles(whole) == ["1", "1", "2", "3", "3"]
    assert titles(some) == ["1", "1", "3", "3"]
