"""A dictionary is broadcast only within its limits of rows and of bytes."""

import pytest

from quillspan.operators.lookups import small, width

SCHEMA = "term string, vector array<double>, words array<string>, inner struct<a: string, b: int>"


def marked(df):
    return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("limit, most, wanted", [(10, 10_000, True), (2, 10_000, False), (10, 50, False)])
def test_rows_and_bytes(spark, limit, most, wanted):
    rows = [("t" * 10, [1.0] * 5, ["ab", None], ("c", 1)), (None, None, None, None), ("x", [], [], (None, 2))]
    df = spark.createDataFrame(rows, SCHEMA)
    assert marked(small(df, limit, most)) == wanted
    assert [r[0] for r in df.select(width(df)).collect()] == [10 + 40 + 2 + 9, 8, 1 + 8]


def test_empty(spark):
    assert marked(small(spark.createDataFrame([], SCHEMA)))
