from pyspark.sql import functions as F

from quillspan.functions import answers
from quillspan.functions.dates import month_of
from quillspan.functions.domains import domains_of
from quillspan.functions.text import absent, field_name, folder_name, html_escaped, listed, safe_name, seconds_text, short_id, shortened, without_annotations
from quillspan.operators import matching
from quillspan.operators.cascade import cascade, verdict
from quillspan.operators.timing import rollup


def values(spark, expression, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r.y for r in rows.select("i", expression(F.col("x")).alias("y")).orderBy("i").collect()]


def test_text_forms(spark):
    assert values(spark, without_annotations, ["a (inferred)", "b  (not mentioned) (inferred)\t", "c (Inferred)", None]) == ["a", "b", "c (Inferred)", None]
    assert values(spark, field_name, ["**Model Type**", "__a-b__", "## Host Species "]) == ["model_type", "a_b", "host_species"]
    assert values(spark, absent, [" N/A ", "None", "kept "]) == ["not applicable", "not mentioned", "kept "]
    assert values(spark, safe_name, ["org/a b:c", "///", "-x-"]) == ["a-b-c", "unknown-model", "x"]
    assert values(spark, html_escaped, ['<a href="x">&']) == ["&lt;a href=&quot;x&quot;&gt;&amp;"]
    assert values(spark, short_id, ["http://x/a#b", "x"]) == ["b", "x"]
    assert values(spark, listed, [" a, ,b", ""]) == [["a", "b"], []]
    assert values(spark, lambda x: shortened(x, 2), ["abc"]) == ["ab..."]
    assert values(spark, lambda x: seconds_text(x.cast("double")), ["1.234", None]) == ["1.23s", "n/a"]
    assert values(spark, lambda x: folder_name(F.split(x, ",")), ["o/a", "a,b"]) == ["a", "multi-model"]
    assert values(spark, domains_of, ["host_species", "virus_load", "colour", "case_data"]) == [["population"], ["pathogen_disease"], ["other"], ["data_sources"]]


def test_dates(spark):
    texts = ["October 1998", "**Oct 1998**", "1998-10-03", "1998-1", "market 2020", "May or April 2001", "May", "x"]
    assert values(spark, month_of, texts) == ["1998-10", "1998-10", "1998-10", "1998-01", "2020-03", "2001-04", "may", "x"]


def test_answers(spark):
    fence = '```json\n{"a": {"values": ["x", null, " "], "reasoning": " r "}}\n```'
    assert values(spark, lambda x: F.map_keys(answers.as_object(answers.without_fence(x))), [fence, "x" + fence, "[]", None]) == [["a"], None, None, None]
    loose = 'Sure! {"a": {"values": ["x", "y",], },} bye'
    assert values(spark, lambda x: answers.joined_values(answers.as_object(answers.repaired(x))["a"]), [loose, '{"a": {"values": null}}', '{"a": 5}', '{"a": {}}']) == ["x, y", "None", "5", ""]
    assert values(spark, lambda x: answers.as_object(x), ['{"a": 1} {"b": 2}', '{"a": 1, "a": 2}', "{'a': 1}"]) == [None, {"a": "2"}, None]
    assert values(spark, answers.clean_values, ['["x", null, " ", "n/a"]', "5", None]) == [["x", "not applicable"], ["5"], []]
    gold = ['a', '["a", " ", "b "]', '[{"value": "a"}, {"values": ["b", null, " "]}]', '{"values": ["a", " ", "", null], "reasoning": "x"}', '{"value": "a"}', '{"value": null}', None, "[]"]
    assert values(spark, answers.gold_values, gold) == [["a"], ["a", "b"], ["a", "b"], ["a", " "], ["a"], [], [], []]


def events(spark, cells, gold, **more):
    synonyms = spark.createDataFrame([("flu", "influenza")], "term string, canonical string")
    extracted = matching.extracted_long(spark.createDataFrame(cells, "item_id int, model string, attribute string, cell string"), synonyms)
    fields = spark.createDataFrame(gold, "item_id int, attribute string, values array<string>")
    return extracted, matching.gold_long(fields, synonyms), fields


def test_outcomes_and_scores(spark):
    cells = [
        (1, "m", "disease", "Flu, influenza, ague"),  # two values hit one gold value
        (1, "m", "host", "N/A"),  # extracted side only is unified
        (1, "m", "other", "x"),  # not expected
        (1, "m", "free", "y"),  # gold is empty
        (1, "m", "start", "May 2020"),
        (1, "m", "place", "Bern, West"),  # a comma inside a value splits it
    ]
    gold = [
        (1, "disease", ["flu (inferred)"]), (1, "host", ["N/A"]), (1, "free", []), (1, "start", ["2020-05-03"]),
        (1, "place", ["Bern West", "Basel"]), (1, "missing", ["z (not mentioned)", "z"]),
    ]
    extracted, long, fields = events(spark, cells, gold)
    found = matching.outcomes(extracted, long, fields)
    rows = {(r.attribute, r.outcome, r.value, r.matched) for r in found.collect()}
    assert ("disease", "hit", "influenza", "influenza") in rows and ("disease", "false_positive", "ague", None) in rows
    assert ("host", "false_positive", "not applicable", None) in rows and ("host", "miss", "N/A", None) in rows
    assert ("other", "not_expected", "x", None) in rows and not [r for r in rows if r[0] == "free"]
    assert ("start", "hit", "May 2020", "2020-05-03") in rows
    assert ("place", "hit", "Bern", "Bern West") in rows and ("place", "hit", "West", "Bern West") in rows and ("place", "miss", "Basel", None) in rows
    assert found.where("attribute = 'missing' and outcome = 'miss'").count() == 2
    totals = extracted.select("item_id", "model").distinct().withColumn("total_expected", F.lit(7))
    row = matching.scores(found, totals, ("model",)).first()
    assert (row.hits, row.misses, row.fps, row.total_expected) == (5, 4, 2, 7)
    assert round(row.recall, 4) == 0.7143 and round(row.precision, 4) == 0.7143
    assert matching.event_table(found).count() == 11


class Judge:
    def judge(self, prompt):
        if 'value: "boom"' in prompt:
            raise RuntimeError
        return "match" if "kin" in prompt else "NO_MATCH"


def test_cascade(spark):
    cells = [(1, "m", "a", "v1, kin, boom, far, y")]
    extracted, gold, fields = events(spark, cells, [(1, "a", ["gold", "boomer"])])
    decisions = [("v1", "MATCH", "gold", 0.9), ("kin", "AMBIGUOUS", "gold", 0.6), ("boom", "AMBIGUOUS", "gold", 0.6), ("far", "NO_MATCH", None, 0.1), ("y", "UNAVAILABLE", None, 0.0)]
    scored = extracted.join(spark.createDataFrame(decisions, "value string, decision string, best_match string, score double"), "value")
    got = {r.value: (r.outcome, r.method) for r in cascade(extracted, gold, fields, scored, Judge).collect() if r.outcome != "miss"}
    assert got == {"v1": ("hit", "vector"), "kin": ("hit", "llm"), "boom": ("hit", "string"), "far": ("false_positive", None), "y": ("false_positive", None)}
    assert verdict("MATCH", "big gold bar", ["x", "gold"]) == "gold" and verdict("no_match", "a", ["a"]) is None


def test_rollup(spark):
    rows = spark.createDataFrame([("a", 1.0, 2), ("a", None, None), ("b", None, 1)], "m string, d double, t long")
    got = {r.m: (r.calls, r.d_total, r.d_n, r.d_avg, r.t) for r in rollup(rows, ["m"], ["d"], ["t"]).collect()}
    assert got == {"a": (2, 1.0, 1, 1.0, 2), "b": (1, None, 0, None, 1)}
