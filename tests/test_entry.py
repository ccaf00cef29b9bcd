"""Every query with SQL gives the rows of its SQL on the smallest test data."""

import math
import os

import duckdb
import pytest

import __spark_entry__
from quillspan.plans import catalogue

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, dict):
        v = list(v.values())
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else str(v)


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for f in os.listdir(DATA):
        connection.sql(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return connection


@pytest.mark.parametrize("name", [n for n in catalogue.QUERIES if n in catalogue.SQL])
def test_query_equals_sql(spark, duck, name):
    frame = catalogue.QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(str([plain(x) for x in r]) for r in frame.select(*columns).collect())
    relation = duck.sql(catalogue.SQL[name])
    order = sorted(range(len(relation.columns)), key=lambda i: relation.columns[i])
    assert [relation.columns[i] for i in order] == columns
    assert got == sorted(str([plain(r[i]) for i in order]) for r in relation.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())
