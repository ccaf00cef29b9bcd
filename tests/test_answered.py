"""Readable answers without any value are scored; unreadable and empty ones are not."""

import json

import duckdb
import pytest
from pyspark.sql import functions as F

from quillspan.plans import cascade_queries, scoring

GOLD = json.dumps({"host": ["bats", "pigs"], "place": {"values": ["Bern"]}})
CONTENT = {
    1: '{"host": {"values": ["bats"]}}',
    2: 'Sure: {"host": {"values": []}, "place": {"values": [],}} bye',  # read, no value
    3: "I cannot help with that.",
    4: "{}",
    5: None,
    6: "broken",  # fields were parsed from it all the same, blank ones only
    7: '{"host": ["bats"',
}


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    frames = {
        "llm_response": ([(i, "a", "silent" if i == 2 else "m", c) for i, c in CONTENT.items()], "response_id long, abstract_id string, model string, content string"),
        "abstract_item": ([("a", GOLD)], "abstract_id string, expected string"),
        "extraction": ([(1, 1, "host", ["bats"]), (2, 6, "host", [" "])], "extraction_id long, response_id long, attr_name string, value_list array<string>"),
        "vocab_class": ([("i", "disease_name", "flu", ["grippe"])], "iri string, schema_field string, label string, alt_terms array<string>"),
    }
    for name, (rows, schema) in frames.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{d}/{name}.parquet")
    return d


def test_readable_answers_without_values_are_scored(spark, folder):
    items = {r.item_id: (r.hits, r.misses, r.fps, r.total_expected) for r in scoring.score_items(spark, folder).collect()}
    assert items == {1: (1, 2, 0, 3), 2: (0, 3, 0, 3), 6: (0, 3, 0, 3)}
    models = {r.model: (r.hits, r.misses, r.total_expected, r.recall) for r in scoring.score_models(spark, folder).collect()}
    assert models == {"m": (1, 5, 6, 0.166667), "silent": (0, 3, 3, 0.0)}
    lost = scoring.misses(spark, folder).groupBy("item_id").count().collect()
    assert {(r.item_id, r["count"]) for r in lost} == {(1, 2), (2, 3), (6, 3)}
    assert cascade_queries.cascade_events(spark, folder).where("outcome = 'miss' and item_id = 2").count() == 3


@pytest.mark.parametrize("name", ["score_models", "score_items", "misses"])
def test_equals_sql_over_the_answered_responses(spark, folder, name):
    """The SQL of the query, with the scored responses in place of those with values."""
    duck = duckdb.connect()
    for t in ("llm_response", "abstract_item", "extraction", "vocab_class"):
        duck.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    duck.sql("create table answered as select * from (values (1, 'm'), (2, 'silent'), (6, 'm')) t(item_id, model)")
    rows = duck.sql(scoring.SQL[name].replace("(select distinct item_id, model from extracted)", "answered"))
    got = scoring.QUERIES[name](spark, folder).select(*[F.col(c).cast("string") for c in rows.columns]).collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(str(v) for v in r) for r in rows.fetchall())
