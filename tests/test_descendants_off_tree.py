"""Classes on and below cycles have their ancestors and descendants too."""

import random

import pytest

from quillspan.operators.hierarchy import descendants, hierarchy
from quillspan.plans.general import p3_descendants


def brute(parent):
    pairs = set()
    for n in parent:
        chain, at = [n], parent[n]
        while at is not None and at not in chain:
            chain.append(at)
            at = parent[at]
        pairs |= {(a, n, i) for i, a in enumerate(chain) if i}
    return pairs


def cases():
    rng = random.Random(5)
    mixed = {f"n{i}": rng.choice([f"n{k}" for k in range(40)] + [None] * 4) for i in range(40)}
    ring = {f"r{i}": f"r{(i + 1) % 9}" for i in range(9)} | {f"b{i}": f"b{i - 1}" if i else "r4" for i in range(12)} | {"s": "s", "t": "s"}
    return [mixed | ring, ring, {"a": None, "b": "a"}]


@pytest.mark.parametrize("case", range(3))
def test_pairs_off_the_trees(spark, case):
    parent = cases()[case]
    rows = spark.createDataFrame(list(parent.items()), "iri string, parent_iri string")
    found = descendants(hierarchy(rows, with_cycles=False, with_walk=True)).collect()
    got = {(r.ancestor, r.node, r.distance) for r in found}
    assert len(found) == len(got) and got == brute(parent)


def test_query_has_the_subtree_below_a_cycle(spark, tmp_path):
    rows = [("x", "y"), ("y", "x"), ("c", "x"), ("d", "c")]
    spark.createDataFrame(rows, "iri string, parent_iri string").write.parquet(f"{tmp_path}/ontology_class.parquet")
    got = {(r.ancestor, r.node, r.distance) for r in p3_descendants(spark, str(tmp_path)).collect()}
    assert got == {("x", "y", 1), ("y", "x", 1), ("x", "c", 1), ("y", "c", 2), ("c", "d", 1), ("x", "d", 2), ("y", "d", 3)}
