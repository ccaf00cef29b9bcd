import random

import pytest

from quillspan.operators.hierarchy import descendants, hierarchy

SCHEMA = "iri string, parent_iri string, node string, path int"


def brute(parent):
    out = {}
    for n in parent:
        chain, at = [n], parent[n]
        while at is not None and at not in chain:
            chain.append(at)
            at = parent[at]
        if at is None:
            out[n] = (chain[-1], len(chain) - 1, "tree", chain[::-1])
        else:
            out[n] = ("", -1, "cycle" if at == n else "below", None)
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_brute_force(spark, seed):
    rng = random.Random(seed)
    names = [f"http://x.example/obo/N_{i}" for i in range(60)]
    parent = {n: rng.choice(names + [None] * 10) for n in names}
    for i in range(40, 60):  # a long chain
        parent[names[i]] = names[i - 1] if i > 40 else None
    rows = [(n, p, "clash", 1) for n, p in parent.items()] * 2
    got = {r.node: (r.root, r.depth, r.status, r.path) for r in hierarchy(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(parent)


def test_notations_blanks_and_absent_parents(spark):
    rows = [
        ("http://x.example/obo/EPX_1", None), ("http://x.example/obo/EPX_2", " EPX:1\n"), ("http://y.example/t#md3", "<https://x.example/obo/EPX_2>"),
        ("http://y.example/t#md4", "md:3"), ("http://y.example/t#md5", "md999"), ("http://y.example/t#md6", " "), (None, "md3"), ("  ", "md3"),
        ("http://y.example/t#md7", "http://y.example/t#md7"),
    ]
    got = {r.node[-3:]: (r.root[-5:], r.depth) for r in hierarchy(spark.createDataFrame(rows, "iri string, parent_iri string")).collect()}
    assert got == {"X_1": ("EPX_1", 0), "X_2": ("EPX_1", 1), "md3": ("EPX_1", 2), "md4": ("EPX_1", 3), "md5": ("t#md5", 0), "md6": ("t#md6", 0), "md7": ("", -1)}


def test_descendants_and_hot_parent(spark):
    rows = [("a", None)] + [(f"b{i}", "a") for i in range(50)] + [("c", "b0")]
    tree = hierarchy(spark.createDataFrame(rows, "iri string, parent_iri string"))
    below = {(r.ancestor, r.node, r.distance) for r in descendants(tree).collect()}
    assert below == {("a", f"b{i}", 1) for i in range(50)} | {("b0", "c", 1), ("a", "c", 2)}


def test_empty(spark):
    assert hierarchy(spark.createDataFrame([], "iri string, parent_iri string")).collect() == []
