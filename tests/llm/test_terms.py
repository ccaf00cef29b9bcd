import json
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from quillspan.llm import terms as t


def test_against_brute_force(spark):
    rng = random.Random(4)
    records = {f"r{i}": [rng.choice(["a", "b", "hot", None, f"u{i}"]) for _ in range(rng.randint(0, 6))] for i in range(500)}
    rows = [(k, v, 1) for k, v in records.items()] * 2 + [("null", None, 1)]
    occurrences, held = Counter(), defaultdict(set)
    for k, v in records.items():
        for x in v:
            if x is not None:
                occurrences[x] += 1
                held[x].add(k)
    counts = t.term_counts(spark.createDataFrame(rows, "id string, v array<string>, term int"), "id", "v")
    got = {r.term: (r.occurrences, r.records) for r in counts.collect()}
    total = len({k for x in held.values() for k in x})
    assert got.pop(None) == (sum(occurrences.values()), total)
    assert got == {x: (occurrences[x], len(held[x])) for x in held}
    marks = {r.term: r.mark for r in t.marked(counts, 0.3).collect()}
    assert marks == {x: "rare" if len(k) == 1 else "common" if len(k) > 0.3 * total else "useful" for x, k in held.items()}


def test_plain_terms_and_gold(spark):
    gold = {"a": " X ", "b": ["x", None, "\t", {"value": "Y (inferred)"}, {"values": ["z", None, ""]}], "c": {"values": ["v"], "reasoning": None}, "d": {"value": None}, "e": {"values": []}, "f": None}
    frame = spark.createDataFrame([(json.dumps(gold),), (None,), ("{broken",)], "g string")
    got = [sorted(r.x) for r in frame.select(t.plain_terms(t.gold_values(F.col("g"))).alias("x")).collect()]
    assert got == [["v", "x", "x", "y (inferred)", "z"], [], []]


def test_empty(spark):
    empty = spark.createDataFrame([], "id string, v array<string>")
    assert t.marked(t.term_counts(empty, "id", "v")).collect() == []


def test_counters_over_batches_and_rows_of_one_record(spark):
    from collections import Counter

    import numpy as np
    import pyarrow as pa

    rng = random.Random(4)
    rows = [(i // 3, [rng.choice("abcdefgh") for _ in range(rng.randint(0, 5))]) for i in range(300)]
    for step in (1, 7, 300):
        counters, got = t.Counters(), Counter()
        seen: dict = {}
        for lo in range(0, 300, step):
            part = rows[lo : lo + step]
            counters.add(pa.array([v for _, v in part], pa.list_(pa.string())), np.array([k for k, _ in part]))
            if step == 7:
                for batch in counters.leave(part[-1][0]):
                    got.update({r["term"]: r["records"] for r in batch.to_pylist()})
        for batch in counters.leave(-1):
            got.update({r["term"]: r["records"] for r in batch.to_pylist()})
        for k, v in rows:
            for x in v:
                seen.setdefault(x, set()).add(k)
                seen.setdefault(None, set()).add(k)
        assert {x: n for x, n in got.items() if n} == {x: len(ks) for x, ks in seen.items()}
    frame = spark.createDataFrame([(None, ["a"]), (None, ["a"]), ("k", ["a", "b"]), ("k", ["a"]), ("k", ["a"])], "k string, v array<string>")
    assert {r.term: (r.occurrences, r.records) for r in t.term_counts(frame, "k", "v").collect()} == {"a": (4, 3), "b": (1, 1), None: (5, 3)}
