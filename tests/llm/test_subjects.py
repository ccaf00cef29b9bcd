import random

from quillspan.llm import subjects as s

TERMS = {
    "farm": ["grazing pasture", "cattle herd", "sheep dip", "milk yield", "goat market", "pig barn"],
    "code": ["unit test", "source repository", "cache miss", "stack trace", "release tag", "command line"],
    "law": ["court order", "privacy breach", "legal mandate", "travel ban", "liability clause", "review board"],
}
NEUTRAL = ["annual overview", "working group", "draft section"]


def document(rng, subjects):
    out = []
    for i in range(10):
        own = TERMS[subjects[i % len(subjects)]] if subjects and i < 8 else NEUTRAL
        out.append(f"In the {rng.randint(1990, 2020)} season we documented {rng.choice(own)} together with {rng.choice(own)} in the valley.")
    rng.shuffle(out)
    return " ".join(out)


def corpus():
    rng = random.Random(8)
    docs, labels, truth = [], [], {}
    for d in range(240):
        own = rng.sample(list(TERMS), rng.choice([0, 1, 1, 2]))
        text = document(rng, own)
        if d % 6 == 0:  # a passing mention
            text += " As a last step the team mentioned " + rng.choice(TERMS[rng.choice(list(TERMS))]) + " in the report."
        docs.append((d, text, "en" if d % 5 else None, f"s{d % 4}", "clash"))
        truth[d] = set(own)
        if d < 80 and own:
            labels += [(d, x if d != 3 else "law") for x in own]
    docs += [(900, None, "en", None, ""), (901, "", "en", "s1", ""), (902, "Short text.", "en", "s1", "")]
    return docs, labels, truth


SCHEMA = "doc_id long, text string, lang string, source string, subject string"
AREAS = [("farm", "Herds", "Cattle, goats and milk."), ("code", "Software", "Repositories and tests."), ("law", "Law", "Courts and privacy.")]


def test_held_out_accuracy(spark):
    docs, labels, truth = corpus()
    areas = spark.createDataFrame(AREAS, "subject string, title string, description string")
    found = s.subjects_of(spark.createDataFrame(docs, SCHEMA), areas, spark.createDataFrame(labels, "doc_id long, subject string"))
    got = {}
    for r in found.collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    held_out = [d for d in truth if d >= 80]
    right = sum(got.get(d, set()) == truth[d] for d in held_out)
    assert right >= 0.97 * len(held_out), (right, len(held_out))
    assert not {900, 901, 902} & set(got)
    shares = {r.subject: r.share for r in s.composition(found, spark.createDataFrame(docs, SCHEMA)).collect()}
    assert set(shares) == set(TERMS) and all(0 < x < 1 for x in shares.values())


def test_empty(spark):
    areas = spark.createDataFrame(AREAS, "subject string, title string, description string")
    none = spark.createDataFrame([], "doc_id long, subject string")
    docs = spark.createDataFrame([], SCHEMA)
    assert s.subjects_of(docs, areas, none).collect() == []
    assert s.subjects_of(docs, areas.where("false"), none).collect() == []
    one = spark.createDataFrame([(1, "Cattle and goats and milk and cattle and goats stood here.", "en", "a", "")], SCHEMA)
    s.subjects_of(one, areas, none).collect()


def test_languages_are_learned_from_tags(spark):
    from pyspark.sql import functions as F

    from quillspan.llm.language import learned

    texts = {
        "en": ["the herd was moved to the hills and the river rose", "we traced the spread of the fever with care", "further work is needed in the district"],
        "de": ["die herde wurde in die hügel gebracht und der fluss stieg", "wir verfolgten die ausbreitung des fiebers", "weitere arbeit ist im bezirk nötig"],
        "it": ["il gregge fu portato sulle colline e il fiume salì", "abbiamo seguito la diffusione della febbre", "altro lavoro serve nel distretto"],
    }
    rows = [(t, tag.upper() if i else f" {tag}") for tag, own in texts.items() for i, t in enumerate(own * 2)]
    rows += [(texts["de"][0], "en"), (texts["en"][1], "xx"), (None, "en"), ("", None)]
    languages = learned(spark.createDataFrame(rows, "text string, lang string"), F.col("text"), F.col("lang"))
    assert languages.names == ["de", "en", "it"]
    for tag, text in (("en", "the farmers were asked about the fever"), ("de", "die bauern wurden nach dem fieber gefragt"), ("it", "il fiume della febbre sulle colline")):
        assert languages.of(text.split()) == tag
    assert languages.of([], "IT ") == "it" and languages.of([], "zz") == "de"
    none = learned(spark.createDataFrame([], "text string, lang string"), F.col("text"), F.col("lang"))
    assert none.names == [] and none.of(["word"], "en") == "en"


def test_only_the_posterior_decides(spark):
    docs, labels, _ = corpus()
    frames = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(AREAS, "subject string, title string, description string"), spark.createDataFrame(labels, "doc_id long, subject string")
    loose = {(r.doc_id, r.subject): r.posterior for r in s.subjects_of(*frames, cutoff=0.0).collect()}
    for cutoff in (0.3, 0.9):
        assert {(r.doc_id, r.subject) for r in s.subjects_of(*frames, cutoff=cutoff).collect()} == {k for k, p in loose.items() if p > cutoff}


def test_validated_cutoff():
    assert s.validated([]) == 0.5
    assert s.validated([(0.9, 50, True), (0.4, 10, True), (0.35, 30, False)]) == 0.35
    assert s.validated([(0.9, 50, True), (0.4, 10, False)]) == 0.5
