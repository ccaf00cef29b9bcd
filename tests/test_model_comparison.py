"""Answers of several responses to one abstract stand in one row."""

import json

from quillspan.plans import cascade_queries


def test_models_of_one_abstract_are_brought_together(spark, tmp_path):
    frames = {
        "llm_response": ([(1, "a", "m1", "{}"), (2, "a", "m2", "{}"), (3, "b", "m1", "{}")], "response_id long, abstract_id string, model string, content string"),
        "abstract_item": ([(x, json.dumps({"host": ["bats"]})) for x in "ab"], "abstract_id string, expected string"),
        "extraction": (
            [(1, 1, "host", ["bats", "cows"]), (2, 2, "host", ["pigs"]), (3, 3, "host", ["bats"]), (4, 2, "place", ["Bern"])],
            "extraction_id long, response_id long, attr_name string, value_list array<string>",
        ),
        "vocab_class": ([("i", "disease_name", "flu", ["grippe"])], "iri string, schema_field string, label string, alt_terms array<string>"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    found = cascade_queries.model_comparison(spark, str(tmp_path)).collect()
    got = {(r.abstract_id, r.attribute): (r.models, [tuple(x) for x in r.answers]) for r in found}
    assert got == {
        ("a", "host"): (2, [("m1", 1, 0, "bats", "hit"), ("m1", 1, 1, "cows", "false_positive"), ("m2", 2, 0, "pigs", "false_positive")]),
        ("a", "place"): (1, [("m2", 2, 0, "Bern", "not_expected")]),
        ("b", "host"): (1, [("m1", 3, 0, "bats", "hit")]),
    }
