import random

from quillspan.llm import leakage as k

WORDS = [f"w{i}" for i in range(400)]
COMMON = ["the", "of", "and", "in", "a"]


def sentence(rng, n=18):
    return " ".join(rng.choice(WORDS if rng.random() < 0.7 else COMMON) for _ in range(n)).capitalize() + "."


def changed(rng, text, edits):
    words = text.split()
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i : i + 1] = rng.choice([[], ["changed"], [words[i], "added"]])
    return " ".join(words).upper().replace("A", "А")  # a look-alike of another script


def corpus():
    rng = random.Random(7)
    items = [(100 + i, " ".join([sentence(rng), sentence(rng), "Shared words stand here in two of the items and so they do not count at all."]), "en", 0) for i in range(20)]
    items += [(200, "Too short a sentence.", "en", 0), (201, None, None, 0), (202, "", "en", 0)]
    docs, truth = [], set()
    for d in range(120):
        body = [sentence(rng) for _ in range(6)]
        if d % 3 == 0:
            item = items[rng.randrange(20)]
            body.insert(rng.randrange(6), changed(rng, item[1].split(". ")[rng.randrange(2)], rng.randrange(3)))
            truth.add((d, item[0]))
        if d % 3 == 1:  # a short quotation
            body.insert(2, " ".join(items[d % 20][1].split()[:7]) + ".")
        body.append("Shared words stand here in two of the items and so they do not count at all.")
        docs.append((d, "\n".join(body), "en"))
    docs += [(900, None, "en"), (901, "", "en"), (902, " ", None), (903, " ".join(sentence(rng) for _ in range(3000)) + " " + items[3][1], "en")]
    return docs, items, truth | {(903, 103)}


def test_planted_cases_both_ways(spark):
    docs, items, truth = corpus()
    d = spark.createDataFrame(docs + docs[:5], "doc_id long, text string, lang string")
    i = spark.createDataFrame(items + items[:3], "item_id long, abstract string, lang string, words int")
    assert {tuple(r) for r in k.leaked(d, i).collect()} == truth
    assert {tuple(r) for r in k.leaked(d, i, broadcast_bytes=0).collect()} == truth


def edits_between(passage, words):
    """Least number of edits between the passage and any part of the words, cell by cell."""
    row = [0] * (len(words) + 1)
    for i, x in enumerate(passage, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(words, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return min(row)


def heavily_changed(rng, text):
    """Up to a third of the words changed, left out or added, light ones as often as others."""
    words = text.split()
    for i in rng.sample(range(len(words)), rng.randrange(len(words) // 3 + 1)):
        words[i] = rng.choice(["", "changed", words[i] + " added", rng.choice(COMMON)])
    return " ".join(words)


def test_filter_and_check_lose_nothing(spark):
    """240 passages with up to a third of their words changed, against brute force over all of them."""
    rng = random.Random(11)
    items = [(1000 + i, sentence(rng, rng.randrange(14, 30)), "en") for i in range(240)]
    docs = [(i, " ".join([sentence(rng, 9), heavily_changed(rng, text), sentence(rng, 9)])) for i, (_, text, _) in enumerate(items)]
    passages = {item: k.words_of(text) for item, text, _ in items}
    truth = set()
    for doc, text in docs:
        words = k.words_of(text)
        for item, own in passages.items():
            if len(set(own) & set(words)) * 2 > len(set(own)) and edits_between(own, words) <= k.edits_of(len(own), 0.75):
                truth.add((doc, item))
    assert 80 < len(truth) < 240
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, abstract string, lang string")
    assert {tuple(r) for r in k.leaked(d, i).collect()} == truth
    assert {tuple(r) for r in k.leaked(d, i, broadcast_bytes=0).collect()} == truth


def test_check_of_windows():
    rng = random.Random(3)
    for _ in range(300):
        own, window = [rng.randrange(1, 5) for _ in range(6)], [rng.randrange(1, 5) for _ in range(rng.randrange(10))]
        padded = k.np.array([window + [0] * (10 - len(window))])
        for edits in range(4):
            assert k.within_edits(k.np.array([own]), padded, edits)[0] == (edits_between(own, window) <= edits)


def test_words():
    assert k.words_of("Café­ No-thing ＡＢ") == ["cafe", "no", "thing", "ab"]


def test_empty(spark):
    d = spark.createDataFrame([], "doc_id long, text string, lang string")
    i = spark.createDataFrame([], "item_id long, abstract string, lang string")
    full = spark.createDataFrame([(1, "x " * 20, "en")], "item_id long, abstract string, lang string")
    assert k.leaked(d, full).collect() == [] and k.leaked(d, i).collect() == []
    assert k.leaked(d, full, broadcast_bytes=0).collect() == [] and k.leaked(d, i, broadcast_bytes=-1).collect() == []


def test_null_keys_and_very_long_sentences(spark):
    rng = random.Random(4)
    body = sentence(rng, 2000)
    d = spark.createDataFrame([(None, body), (None, "x " + body.replace("w1 ", "")), (5, " ".join(body.split()[:1400]))], "doc_id long, text string")
    i = spark.createDataFrame([(9, body, None)], "item_id long, abstract string, lang string")
    for size in (0, 10**9):
        assert {tuple(r) for r in k.leaked(d, i, broadcast_bytes=size).collect()} == {(None, 9)}
