"""Every vector is compared with every other one, whatever its id or label."""

import math
import random

import pytest

from quillspan.operators.similarity import nearest
from quillspan.plans import similarity_queries

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(vectors, dims):
    def cosine(a, b):
        a, b = a[:dims], b[:dims]
        size = math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))
        return round(min(1.0, max(0.0, sum(x * y for x, y in zip(a, b)) / size)), 9) if len(a) == len(b) and size else None

    out = {}
    for i, a in vectors.items():
        scored = [(-s, j) for j, b in vectors.items() if j != i and a and b and (s := cosine(a, b)) is not None]
        out[i] = (min(scored)[1], -min(scored)[0]) if scored else (None, None)
    return out


@pytest.mark.parametrize("block", [7, 500])
def test_against_brute_force(spark, block):
    rng = random.Random(3)
    vectors = {i: [float(rng.randint(-4, 4)) for _ in range(6)] for i in range(0, 120, 2)}  # small numbers, so that scores tie
    vectors |= {1000: None, 1001: [], 1002: [0.0] * 6, 1003: [1.0, 2.0, 3.0], 1004: [-1.0] * 5}
    rows = spark.createDataFrame([(i, 0, v) for i, v in vectors.items()], SCHEMA)
    found = nearest(rows, "vec_id", "embedding", [("all", None), ("three", 3)], block).collect()
    for name, dims in (("all", 6), ("three", 3)):
        got = {r.vec_id: (r.best_match, r.score) for r in found if r.encoder == name}
        want = brute(vectors, dims)
        assert set(got) == set(want)
        for i, (match, score) in want.items():
            assert got[i] == (match, score if score is None else pytest.approx(score, abs=2e-9)), (name, i)


def test_ids_divisible_by_twenty_ask_all_others(spark, tmp_path):
    rows = [(1, 0, [1.0, 0.0]), (10, 1, [1.0, 0.1]), (20, 0, [0.0, 1.0]), (23, 2, [0.2, 1.0]), (40, 1, [1.0, 0.01]), (60, 3, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {(r.vec_id, r.best_match) for r in similarity_queries.cosine_best(spark, str(tmp_path)).where("encoder = 'full64'").collect()}
    assert got == {(20, "23"), (40, "1"), (60, None)}


def test_answers_to_some_are_those_to_all(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(i, 0, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(150)], SCHEMA)
    every = {tuple(r) for r in nearest(rows, "vec_id", "embedding", [("all", None)], 20).where("vec_id % 20 = 0").collect()}
    some = {tuple(r) for r in nearest(rows, "vec_id", "embedding", [("all", None)], 20, asked=rows.vec_id % 20 == 0).collect()}
    assert len(some) == 8 and some == every
