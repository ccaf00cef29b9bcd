import random

import pytest
from pyspark.sql import functions as F

from quillspan.llm import quantiles as q

SHARES = [0.0, 0.05, 0.5, 0.9, 1.0]


@pytest.mark.parametrize("accuracy", [0.01, 0.05])
def test_error_bound_and_combination(spark, accuracy):
    rng = random.Random(1)
    rows = []
    for i in range(3000):
        x = rng.choice([rng.lognormvariate(0, 3), -rng.lognormvariate(0, 2), 0.0, 1e-300, 1e300, 5.0])
        rows.append((i % 7, "m" if i % 3 else None, x, "clash"))
    rows += [(0, "m", None, "c"), (0, "m", float("nan"), "c"), (0, "m", float("inf"), "c")]
    frame = spark.createDataFrame(rows, "day int, model string, x double, field string")
    daily = q.sketch(frame, ("model", "day"), ("x",), accuracy)
    found = q.percentiles(daily, ("model",), SHARES, accuracy).collect()
    assert len(found) == 2 * len(SHARES)
    for r in found:
        own = sorted(v for _, m, v, _ in rows if m == r.model and v is not None and v == v and abs(v) < float("inf"))
        exact = own[int(r.share * (len(own) - 1))]
        assert r.n == len(own) and abs(r.value - exact) <= accuracy * abs(exact) * (1 + 1e-9)
    whole = q.sketch(frame, ("model",), ("x",), accuracy)
    key = ["model", "field", "sign", "bucket", "n"]
    assert sorted(map(str, q.combined(daily, ("model",)).select(key).collect())) == sorted(map(str, whole.select(key).collect()))
    assert whole.where("sign is null").agg(F.sum("n")).first()[0] == 3


def test_empty_and_repeated(spark):
    empty = spark.createDataFrame([], "id int, m string, x double")
    assert q.sketch(empty, ("m",), ("x",)).collect() == []
    assert q.percentiles(q.sketch(empty, ("m",), ("x",)), ("m",), SHARES).collect() == []
    twice = spark.createDataFrame([(1, "m", 2.0), (1, "m", 2.0), (2, None, None)], "id int, m string, x double")
    assert q.once(twice, "id", ("m",), ("x",)).count() == 2


def test_rows_of_null_key_all_count(spark):
    rows = spark.createDataFrame([(None, "m", 1.0), (None, "m", 1.0), (1, "m", 2.0), (1, "m", 2.0), (2, "m", float("nan")), (2, "m", float("nan"))], "k long, model string, x double")
    got = {(r.sign, r.bucket): r.n for r in q.sketch(q.once(rows, "k", ("model",), ("x",)), ("model",), ("x",)).collect()}
    assert sorted(got.values()) == [1, 1, 2] and got[None, None] == 1


def test_small_values_keep_their_digits(spark):
    from quillspan.llm.queries import _nine_digits

    rows = spark.createDataFrame([("m", 1.23456789e-9 * (i + 1)) for i in range(200)], "model string, x double")
    found = q.percentiles(q.sketch(rows, ("model",), ("x",)), ("model",), (0.5,)).withColumn("value", _nine_digits("value")).first()
    assert abs(found.value / (1.23456789e-9 * 100) - 1) <= 0.0101
