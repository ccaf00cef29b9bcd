import json
import random

import numpy as np

from quillspan.llm import pairs as p
from quillspan.llm.labelling import fit

ABSTRACT = "We traced the spread of the fever in the valley from 1998 to 2003. The herd was moved to the hills, and the river rose in spring. Further work is needed in the district."
QUESTION = "Extract data used and host species from the abstract below."
SAID = ["The second half of the abstract points to {}.", "Stated directly in the methods as {}, with {} records behind it.", "It is not possible to tell the year, but {} is mentioned twice.", "Households that refused the visit were left out, which leaves {}."]
GERMAN = ["Die zweite Hälfte der Kurzfassung deutet auf {}.", "Der Text nennt {} im Satz über Bern, und das ist nicht zu übersehen."]


def answer(rng, frames=SAID, stop=True):
    out = {}
    for f in ("data_used", "host_species"):
        v = [rng.choice(["goats", "house mice", "farm survey"]) for _ in range(2)]
        reason = " ".join(rng.choice(frames).format(" and ".join(v), rng.randrange(900)) for _ in range(2))
        out[f] = {"values": v, "reasoning": reason if stop else reason[:-1]}
    return out


def planted():
    rng = random.Random(6)
    rows, truth = [], {}
    for i in range(600):
        good = answer(rng, stop=rng.random() < 0.8)
        text = json.dumps(good, indent=rng.choice([None, 1]))
        kind = None
        if i % 10 == 0:
            kind = ("empty", "refusal", "copy", "truncated", "language")[(i // 10) % 5]
            if kind == "empty":
                text = rng.choice([None, "", " \n", "{}", "null", '{"a": {"values": [], "reasoning": " "}}', "Sure! {}"])
            elif kind == "refusal":
                text = rng.choice(["I'm sorry, but I can't help with this request.", '{"note": "I must decline to answer."}', "Leider kann ich diesen Text nicht auswerten."])
            elif kind == "copy":
                text = rng.choice([QUESTION, ABSTRACT.upper(), json.dumps({"data_used": {"values": [ABSTRACT], "reasoning": ""}})])
            elif kind == "truncated":
                text = rng.choice([text[: int(len(text) * 0.7)].rstrip("}] \n"), json.dumps({**good, "host_species": {"values": ["goats"], "reasoning": "The second half of the abs"}})])
            else:
                text = json.dumps(answer(rng, GERMAN))
            truth[i] = kind
        elif i % 7 == 0:
            text = rng.choice(["```json\n{}\n```", "Here is the JSON:\n{}", "{}\nAll fields follow the abstract."]).replace("{}", text)
        rows.append((i, "A1", QUESTION, text, "clash"))
    return rows, truth


def test_planted_defects(spark):
    rows, truth = planted()
    frame = spark.createDataFrame(rows + rows[:20], "response_id long, abstract_id string, question string, content string, abstract string")
    prompts = spark.createDataFrame([("A1", ABSTRACT), ("A1", ABSTRACT), ("A2", None)], "abstract_id string, abstract string")
    labelled = p.defects(frame, prompts)
    assert labelled.count() == 600
    got = {r.response_id: r.defect for r in p.found(labelled).collect()}
    wrong = {i: (truth.get(i), got.get(i)) for i in set(truth) | set(got) if truth.get(i) != got.get(i)}
    assert len(wrong) <= 2, wrong


def test_missing_texts_and_empty_tables(spark):
    schema = "response_id long, abstract_id string, question string, content string"
    frame = spark.createDataFrame([(1, None, None, "x" * 100_000), (2, "no", "", None)], schema)
    prompts = spark.createDataFrame([], "abstract_id string, abstract string")
    assert {r.response_id: r.defect for r in p.found(p.defects(frame, prompts)).collect()}.get(2) == "empty"
    assert p.defects(spark.createDataFrame([], schema), prompts).collect() == []


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    truth = rng.random(20_000) < 0.1
    votes = []
    for right, cast in ((0.97, 0.9), (0.9, 0.6), (0.8, 1.0), (0.5, 1.0)):
        says = np.where(rng.random(len(truth)) < right, truth, ~truth)
        votes.append(np.where(rng.random(len(truth)) < cast, np.where(says, 1, -1), 0))
    patterns, inverse, counts = np.unique(np.stack(votes, axis=1), axis=0, return_inverse=True, return_counts=True)
    model = fit(patterns, counts)
    post = model.posterior(patterns)[inverse.ravel()]
    assert abs(model.prior - 0.1) < 0.03 and ((post > 0.5) == truth).mean() > 0.96
    assert model.posterior(np.zeros((1, 4), int))[0] == 0


UNSEEN = {
    "refusal": ["I'm afraid that handling this text falls outside what this service helps with.", "Handling such a text is not something this service helps with, sorry.", "This service cannot help with handling that text, I'm afraid."],
    "language": ["Il testo parla di capre e di topi che vivono nella valle, e non dice altro.", "Gli autori della ricerca non hanno indicato un altro valore per questa voce."],
}


def held_out(seed):
    """Pairs with wordings that no list and no other test has, and how they are meant."""
    rng = random.Random(seed)
    rows, truth = [], {}
    for i in range(800):
        good = answer(rng, stop=rng.random() < 0.8)
        text = json.dumps(good)
        if i % 8 == 0:
            kind = ("empty", "refusal", "refusal", "copy", "truncated", "language")[(i // 8) % 6]
            if kind == "empty":
                text = rng.choice([None, "```json\n{}\n```", '{"data_used": {"values": [], "reasoning": ""}}', "\t"])
            elif kind == "refusal":
                text = rng.choice(UNSEEN["refusal"] + ["I cannot help with handling such a text, I'm afraid.", "Sorry, I can't help with that text."] * 2)
            elif kind == "copy":
                text = rng.choice([ABSTRACT, f"> {QUESTION}", json.dumps({"host_species": {"values": [], "reasoning": ABSTRACT.lower()}})])
            elif kind == "truncated":
                text = rng.choice([text[: rng.randrange(60, len(text) - 5)], json.dumps({**good, "host_species": {"values": ["goats"], "reasoning": "Households that refused the vis"}})])
            else:
                text = json.dumps({f: {**x, "reasoning": " ".join(UNSEEN["language"])} for f, x in good.items()})
            truth[i] = kind
        rows.append((i, "A1", QUESTION, text))
    return rows, truth


def test_cutoffs_on_held_out_pairs(spark):
    """At its cutoff each defect is found about as well as at the best one of a grid."""
    rows, truth = held_out(12)
    frame = spark.createDataFrame(rows, "response_id long, abstract_id string, question string, content string")
    prompts = spark.createDataFrame([("A1", ABSTRACT, "en")], "abstract_id string, abstract string, lang string")
    labelled = {r.response_id: dict(zip(r.defects, r.posteriors)) for r in p.defects(frame, prompts, cutoffs=dict.fromkeys(p.DEFECTS, 0.02)).collect()}
    for d in p.DEFECTS:
        own = {i for i, kind in truth.items() if kind == d}
        f1 = {}
        for cutoff in (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9):
            # an answer of another defect may have this one too
            got = {i for i, post in labelled.items() if post.get(d, 0) > cutoff and (i in own or i not in truth)}
            f1[cutoff] = 2 * len(got & own) / (len(got) + len(own))
        print(d, {c: round(x, 3) for c, x in f1.items()})
        assert f1[p.CUTOFFS[d]] >= 0.9 and f1[p.CUTOFFS[d]] >= max(f1.values()) - 0.02, (d, f1)


def test_a_whole_sentence_stays_whole_in_a_larger_collection(spark):
    """The frame of a sentence without a full stop is judged by its own uses, not by its share of all."""
    frame_of_few = [(i, "A1", QUESTION, json.dumps({"data_used": {"values": ["goats"], "reasoning": f"One rare wording names goats{stop}"}})) for i, stop in ((0, ""), (1, "."), (2, "."))]
    rest = [(10 + i, "A1", QUESTION, json.dumps({"data_used": {"values": ["goats"], "reasoning": f"Wording number{chr(97 + i % 26)}{chr(97 + i // 26)} is met here once."}})) for i in range(600)]
    prompts = spark.createDataFrame([("A1", ABSTRACT)], "abstract_id string, abstract string")
    schema = "response_id long, abstract_id string, question string, content string"
    for rows in (frame_of_few + rest[:5], frame_of_few + rest):
        got = {r.response_id: r.defects for r in p.defects(spark.createDataFrame(rows, schema), prompts).collect()}
        assert "truncated" not in got[0]


def test_rows_of_null_key_and_repeated_rows(spark):
    schema = "response_id long, abstract_id string, question string, content string, tail string"
    rows = [(None, "A1", QUESTION, "", "x"), (None, "A1", QUESTION, "", "x"), (1, "A1", QUESTION, "", "x"), (1, "A1", QUESTION, "", "y")]
    prompts = spark.createDataFrame([("A1", ABSTRACT)], "abstract_id string, abstract string")
    assert sorted(str(r.response_id) for r in p.defects(spark.createDataFrame(rows, schema), prompts).collect()) == ["1", "None", "None"]
