import json

import pytest
from pyspark.sql import functions as F

from quillspan.operators import similarity, vocabulary
from quillspan.operators.lookups import canonical, with_lookups
from quillspan.operators.validation import light_errors
from quillspan.plans import prompts, reports
from quillspan.sources import chat, files
from quillspan.streaming.calls import windowed_rollup

OWL = """<?xml version="1.0"?>
<rdf:RDF xmlns:rdf="r" xmlns:rdfs="s" xmlns:owl="o" xmlns:obo="b">
<owl:Class rdf:about="x#a"><rdfs:label> </rdfs:label><rdfs:label>Alpha</rdfs:label><rdfs:subClassOf rdf:resource="x#p"/><rdfs:subClassOf rdf:resource="x#q"/>
  <obo:IAO_0000118>one</obo:IAO_0000118><obo:IAO_0000118>two</obo:IAO_0000118><obo:IAO_0000115>Def</obo:IAO_0000115></owl:Class>
<owl:Class rdf:about="x#b"><rdfs:subClassOf><owl:Restriction/></rdfs:subClassOf></owl:Class>
<owl:Class rdf:about="x#c"><owl:deprecated>True</owl:deprecated></owl:Class>
<owl:Class><rdfs:label>no iri</rdfs:label></owl:Class>
</rdf:RDF>"""


def test_ontology_file(spark, tmp_path):
    (tmp_path / "o.xml").write_text(OWL)
    got = {r.iri: tuple(r)[1:] for r in files.read_ontology(spark, str(tmp_path / "o.xml")).collect()}
    assert got == {"x#a": ("Alpha", ["one", "two"], "Def", "x#p"), "x#b": ("", [], None, "")}


def test_gold_vocabulary_and_sections(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"abstracts": [{"id": "1", "title": "t", "abstract": "a", "expected": {"f": ["x", {"value": "y"}], "g": "z"}}]}))
    got = files.gold_fields(files.read_gold(spark, str(tmp_path / "g.json"))).collect()
    assert sorted((r.attribute, r["values"]) for r in got) == [("f", ["x", "y"]), ("g", ["z"])]
    (tmp_path / "v.txt").write_text('h:\n  - "no"\ndata_used:\n  - "A B"\n  - plain\n  - # note\nx\nother:\n - "no"\n')
    assert [(r.field, r.term) for r in files.read_vocabulary(spark, str(tmp_path / "v.txt"), ("data_used",)).orderBy("pos").collect()] == [("data_used", "A B"), ("data_used", "plain")]
    folder = tmp_path / "p"
    folder.mkdir()
    (folder / "b.txt").write_text("B \n")
    (folder / "a.txt").write_text("A")
    assert files.read_sections(spark, str(folder), ["b.txt", "missing.txt", "a.txt"]) == ["B", "A"]


def test_sections_and_vocabulary_of_several_lines(spark, tmp_path):
    (tmp_path / "a.txt").write_text("first\n\nsecond \n")
    assert files.read_sections(spark, str(tmp_path), ["a.txt"]) == ["first\n\nsecond"]
    terms = spark.createDataFrame([("f", f"t{i}") for i in range(30)] + [("g", 'a "b" c')], "field string, term string")
    files.write_vocabulary(terms, str(tmp_path / "v"))
    got = files.read_vocabulary(spark, str(tmp_path / "v"), ("f", "g")).collect()
    assert sorted((r.field, r.pos, r.term) for r in got) == sorted([("f", i, t) for i, t in enumerate(sorted(f"t{i}" for i in range(30)), 1)] + [("g", 1, 'a "b" c')])


def test_written_gold_and_ontology_read_back(spark, tmp_path):
    items = [("1", "T \"q\"", None, '{"f":\n ["x", "y"]}'), ("2", None, "line\nbreak", None)]
    files.write_gold(spark.createDataFrame(items, "id string, title string, abstract string, expected string"), str(tmp_path / "g"))
    got = sorted(tuple(r)[1:] for r in files.read_gold(spark, str(tmp_path / "g"), lines=True).collect())
    assert [(*r[:3], r[3] and json.loads(r[3])) for r in got] == [("1", 'T "q"', None, {"f": ["x", "y"]}), ("2", None, "line\nbreak", None)]
    classes = [("x#a", "A & <b>", ["one", None], "D\nE", "x#p", False), ("x#c", None, None, None, None, True), ("x#d", None, None, None, None, None)]
    files.write_ontology(spark.createDataFrame(classes, "iri string, label string, alt_terms array<string>, definition string, parent_iri string, deprecated boolean"), str(tmp_path / "o"), 3)
    assert {tuple(r) for r in map(lambda r: (r.iri, r.label, tuple(r.alt_terms), r.definition, r.parent_iri), files.read_ontology(spark, str(tmp_path / "o")).collect())} == {
        ("x#a", "A & <b>", ("one",), "D\nE", "x#p"), ("x#d", "", (), None, None)}


def test_vocabulary(spark):
    classes = spark.createDataFrame(
        [("g", "Group", None, None, None, None), ("p", "P", ["pp"], None, "g", False), ("k", "Kid", ["kk", "KID", None], None, "p", False), ("d", "Dep", None, None, "g", True),
         ("e", "under dep", None, None, "d", False), ("w", "Data wall", [" "], None, None, False)],
        "iri string, label string, alt_terms array<string>, definition string, parent_iri string, deprecated boolean",
    )
    rules = spark.createDataFrame([("f", ["g"], ["data"]), ("f2", [], ["wall"])], "field string, parent_iris array<string>, label_patterns array<string>")
    terms = vocabulary.field_terms(classes, rules, {"f2": "f"})
    assert sorted(r.iri for r in terms.collect()) == ["k", "p", "w", "w"]
    assert sorted(r.value for r in vocabulary.enumeration(terms).collect()) == ["Data wall", "kk", "pp"]
    assert {(r.term, r.canonical) for r in vocabulary.synonyms(terms).collect()} == {("p", "pp"), ("kid", "kk")}
    assert sorted(r.term for r in vocabulary.all_terms(terms.where("iri = 'k'")).collect()) == ["Kid", "kk"]
    values = spark.createDataFrame([("f", "kk"), ("f", "no"), ("f", "no"), ("free", "any")], "field string, value string")
    assert [r.value for r in vocabulary.violations(values, vocabulary.enumeration(terms)).collect()] == ["no", "no"]
    assert vocabulary.summary(vocabulary.enumeration(terms), 2).first()["rest"] == 1


def test_lookups(spark):
    terms = spark.createDataFrame([("Flu", "influenza")], "term string, canonical string")
    rows = spark.createDataFrame([(" FLU ", 1), (" x ", 2), (None, 3)], "v string, term int")
    assert sorted(str(r.v) for r in canonical(rows, "v", terms).collect()) == [" x ", "None", "influenza"]
    found = spark.createDataFrame([("a", "i", "m", None, "", "d")], "k string, identifier string, matched_term string, status string, ontology_definition string, definition string")
    got = {r.k: [(x.status, x.definition) for x in r.lookups] for r in with_lookups(spark.createDataFrame([("a",), ("b",)], "k string"), found, "k").collect()}
    assert got == {"a": [("found", "d")], "b": []}


def test_ensemble_and_sweep(spark):
    rows = [
        (1, "e1", 0, "MATCH", "a", 0.9), (1, "e2", 1, "MATCH", "b", 0.9), (2, "e1", 0, "NO_MATCH", None, 0.1), (2, "e2", 1, "UNAVAILABLE", None, 0.0),
        (3, "e1", 0, "NO_MATCH", None, 0.1), (3, "e2", 1, "NO_MATCH", None, 0.2), (4, "e1", 0, "UNAVAILABLE", None, 0.0), (5, "e1", 0, "AMBIGUOUS", "c", 0.6), (5, "e2", 1, "NO_MATCH", None, 0.2),
    ]
    frame = spark.createDataFrame(rows, "k int, encoder string, place int, decision string, best_match string, score double")
    got = {r.k: (r.decision, r.best_match, r.score) for r in similarity.ensemble(frame, ("k",), "place").collect()}
    assert got == {1: ("MATCH", "a", 0.9), 2: ("AMBIGUOUS", None, 0.1), 3: ("NO_MATCH", None, 0.2), 4: ("UNAVAILABLE", None, 0.0), 5: ("AMBIGUOUS", "c", 0.6)}
    line = {r.k: r.text for r in similarity.ranked(frame, ("k",), "place").collect()}
    assert line[1] == "e1:MATCH:0.900:a; e2:MATCH:0.900:b"
    pairs = spark.createDataFrame([(0.9, True), (0.6, False), (0.4, True), (None, True)], "s double, t boolean")
    swept = similarity.sweep(pairs, "s", "t", [0.5, 0.7])
    assert {r.threshold: (r.tp, r.fp, r.fn, r.tn) for r in swept.collect()} == {0.5: (1, 1, 1, 0), 0.7: (1, 0, 1, 1)}
    assert similarity.best_threshold(swept).first().threshold == 0.7
    assert similarity.grid()[3] == 0.5 + 3 * 0.05
    best = similarity.best_candidate(spark.createDataFrame([(1, 0.5, 1, "y"), (1, 0.5, 0, "x"), (2, None, 0, "z")], "k int, s double, p int, v string"), ("k",), "s", "p", "v")
    assert {r.k: r.best_match for r in best.collect()} == {1: "x", 2: None}
    decided = {r.k: (r.decision, r.score) for r in similarity.decided(best, 0.5, 0.2).collect()}
    assert decided == {1: ("MATCH", 0.5), 2: ("UNAVAILABLE", 0.0)}


def test_validation(spark):
    rows = spark.createDataFrame([(1, {"a": '{"values": ["x", "y"], "reasoning": "r"}', "b": "5", "z": "{}", "c": '{"values": "q"}'})], "k int, f map<string,string>")
    allowed = spark.createDataFrame([("a", "x")], "field string, value string")
    got = {(r.error, r.field, r.detail) for r in light_errors(rows, "k", "f", allowed, ["a", "b", "c"], ["a", "m"]).collect()}
    assert got == {("missing", "m", ""), ("unsupported", "a", "y"), ("not_object", "b", ""), ("unexpected", "z", ""), ("missing_key", "c", "reasoning"), ("values_not_list", "c", "")}


def test_prompts_and_schema(spark):
    schema = prompts.answer_schema({"s": ["yes", "no"]}, {"p": ["t"], "empty": []}, ["f", "s"])
    assert schema["required"] == ["s", "p", "f"] and prompts.allowed_values(schema["properties"]["p"]["properties"]["values"]["items"]) == (["t"], True)
    assert prompts.example(schema, {"f": ["v"]})["s"]["values"] == ["yes"]
    with pytest.raises(ValueError):
        prompts.example(schema, {"s": ["maybe"]})
    row = spark.range(1).select(prompts.extraction_prompt(["A", " ", "B"], F.lit("text"), "end").alias("p")).first()
    assert row.p == "A\n\nB\n\ntext\n\nend"
    enum = spark.createDataFrame([("p", "b"), ("p", "a"), ("q", "c")], "field string, value string")
    assert prompts.vocabulary_section(enum, ["p", "none"], "Head") == 'Head\n\n  p:\n    - "a"\n    - "b"'


class Echo:
    def ask(self, prompt):
        if prompt == "fail":
            raise OSError("down")
        return {"content": prompt.upper(), "done": True, "completion_tokens": 3}


def test_chat_and_report(spark, tmp_path):
    got = {r.k: (r.content, r.completion_tokens, r.error) for r in chat.generated(spark.createDataFrame([(1, "hi"), (2, "fail")], "k int, p string"), "k", "p", Echo).collect()}
    assert got == {1: ("HI", 3, None), 2: (None, None, "OSError: down")}
    assert chat.host_of(" a:1/ ") == "http://a:1" and chat.seconds(2e9) == 2.0
    client = chat.HttpClient("h", "m", openai=False)
    assert client.read({"message": {"content": "x"}, "done": True, "eval_duration": 5e8})["eval_duration_s"] == 0.5
    events = spark.createDataFrame([(1, "o/m", "a", 0, "hit", "v", "g", "string"), (1, "o/m", "a", 0, "miss", "w", None, None)], "item_id int, model string, attribute string, pos int, outcome string, value string, matched string, method string")
    scores = spark.createDataFrame([(1, "o/m", 1, 1, 0, 2, 0.5, 1.0, 0.667)], "item_id int, model string, hits int, misses int, fps int, total_expected int, recall double, precision double, f1 double")
    reports.write_run(events, scores, str(tmp_path / "run"))
    lines = [r.value for r in spark.read.text(str(tmp_path / "run/report/run=m")).collect()]
    assert lines[0].startswith("1 | o/m: 1 hits") and lines[1] == "  [a] v = g (string)" and lines[2] == "  [a] w"


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([(1, "m", "2024-01-01 00:10:00", 1.0, 2), (1, "m", "2024-01-01 00:10:00", 1.0, 2), (2, "m", "2024-01-01 00:50:00", 3.0, 4)], "call_id long, model string, called_at string, d double, t long")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = windowed_rollup(stream, ["d"], ["t"]).writeStream.format("memory").queryName("rolled").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination(90)
    row = spark.table("rolled").first()
    assert (row.calls, row.d_total, row.t) == (2, 4.0, 6)
