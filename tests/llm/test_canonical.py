import random
import string

from quillspan.llm import canonical as c

TERMS = {
    "a": ["open-air market capacity limit", "OAMCL"], "b": ["harbour closure"], "d": ["fully Bayesian renewal equation", "FBRE"],
    "e": ["house mice"], "f": ["hard ticks", "ixodids"], "g": ["school absence time series"],
}
SPELLINGS = {
    "Open_air  market capacity limit": "a", "limit, open-air market capacity": "a", "limit of open-air market capacity": "a", "oamcls": "a",
    "open-air market capcaity limit": "a", "market capacity limit": "a", "open. market capacity limit": "a", "harb0ur closuré (inferred)": "b",
    "use of harbour closure [1]": "b", "mainnly harbour closure.": "b", "fully bayes. renewal equation": "d", "house mices": "e", "hose mice": "e",
    "ixodid": "f", "library closure": None, "closure": "b", "FBRX": None, "-": None, "not mentioned": None, "goats": None, "absence time series": "g",
}


def reference(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_distances_and_tree_against_brute_force():
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    terms = sorted({word(rng.randint(0, 12)) for _ in range(150)} | {"x" * 80, "x" * 78 + "yy", ""})
    values = [word(rng.randint(0, 12)) for _ in range(80)] + ["x" * 79, "", "𝄞a"]
    tree = c.Tree()
    for t in terms:
        tree.add(t)
    for radius in (0, 1, 2):
        for v, found in zip(values, tree.within(values, radius)):
            assert sorted(found) == sorted((reference(v, t), t) for t in terms if reference(v, t) <= radius)


def test_within_one():
    assert c.within_one("abc", "acb") and c.within_one("abc", "ab") and c.within_one("abc", "abd") and c.within_one("a", "a")
    assert not c.within_one("abcd", "badc") and not c.within_one("abc", "cba")


def test_spellings():
    matcher = c.Matcher([(e, t) for e, terms in TERMS.items() for t in terms])
    for (text, entry), found in zip(SPELLINGS.items(), matcher.best(list(SPELLINGS))):
        assert (next(iter(found[2])) if found and len(found[2]) == 1 else None) == entry, text


def frames(spark):
    rows = [(i, "f", [text, None, " ", text]) for i, text in enumerate(SPELLINGS)]
    rows += [(90, "none", ["house mice"]), (91, "f", []), (92, "f", None), (93, "f", ["z" * 5000]), (0, "f", [next(iter(SPELLINGS)), None, " ", next(iter(SPELLINGS))])]
    values = c.members(spark.createDataFrame(rows, "id int, attr string, vals array<string>"), "id", "attr", "vals")
    entries = spark.createDataFrame(
        [(e, "f", t[0], [*t[1:], None, " "]) for e, t in TERMS.items()] + [("x", "f", None, None)], "iri string, field string, label string, alts array<string>"
    )
    return values, c.entry_terms(entries, "iri", "field", "label", "alts")


def test_broadcast_and_shards_agree(spark):
    values, terms = frames(spark)
    near = {(r.key, r.pos): r.entry for r in c.match(values, terms).collect()}
    far = {(r.key, r.pos): r.entry for r in c.match(values, terms, limit=2, shards=3, blocks=2).collect()}
    assert near == far
    assert near == {(i, p): e or "" for i, e in enumerate(SPELLINGS.values()) for p in (0, 3)} | {(93, 0): ""}


def test_empty(spark):
    values, terms = frames(spark)
    assert c.match(values.where("false"), terms).collect() == [] and c.match(values, terms.where("false")).collect() == []


def test_random_slips_are_found():
    rng = random.Random(5)
    matcher = c.Matcher([(e, t) for e, terms in TERMS.items() for t in terms])
    for entry, terms in TERMS.items():
        for _ in range(20):
            t = list(c.plain(terms[0]))
            t[rng.randrange(len(t))] = rng.choice(string.ascii_lowercase)
            found = matcher.best(["".join(t)])[0]
            assert found and found[2] == {entry}


def test_codes_and_near_forms_in_any_shard(spark):
    """A code of one entry and the near form of another answer the same, whatever the shard."""
    entries = [("A", "SEIR"), ("B", "seirs"), ("C", "CALM"), ("D", "calms model"), ("E", "calms"), ("F", "harbour closures"), ("G", "harbour closure")]
    terms = spark.createDataFrame([("f", e, t) for e, t in entries], "field string, entry string, term string")
    asked = ["seirz", "seirs", "SEIR", "seir", "calm", "calms", "clams", "harbour closurs", "harbour closurez", "the of mainly harbour closure", "closure, harbour"]
    values = spark.createDataFrame([(i, "f", 0, v) for i, v in enumerate(asked)], "key long, field string, pos int, value string")
    whole = {r.key: r.entry for r in c.match(values, terms).collect()}
    matcher = c.Matcher(entries)
    assert whole == {i: (min(x[2]) if x and len(x[2]) == 1 else "") for i, x in enumerate(matcher.best(asked))}
    for shards in (2, 3, 7):
        assert {r.key: r.entry for r in c.match(values, terms, limit=0, shards=shards, blocks=2).collect()} == whole


def test_all_readings_are_read():
    words = [f"w{i}" for i in range(8)]
    assert c.plain("w7 w0 w1 w2 w3 w4 w5 w6") in c.readings(", ".join(words))
    assert c.readings(", ".join(words * 400), 60) == []
    assert c.readings("the " * 300 + "ticks", 6)[-1] == "ticks"


def test_swaps_slips_and_trees_against_brute_force():
    rng = random.Random(9)
    terms = sorted({"".join(rng.choice("abcd ") for _ in range(rng.randint(5, 9))).strip() for _ in range(300)})
    forms = {t: c.Form(c.EXACT, t, t, False) for t in map(c.plain, terms) if len(t) > c.SHORT}
    matcher = c.Matcher(forms=forms)
    assert sorted(matcher.trees[0].terms) == sorted(forms)
    values = ["".join(rng.choice("abcd") for _ in range(rng.randint(5, 9))) for _ in range(400)]
    for v, found in zip(values, matcher.best(values)):
        near = {t for t in forms for s in c.readings(v) if c.within_one(s, t)}
        want = {v} & set(forms) or near
        assert (found[2] if found else set()) == want


def test_many_terms_without_driver_trees(spark):
    terms = spark.range(3_000).selectExpr(
        "'f' as field", "concat('e', id) as entry", "translate(concat(hex(xxhash64(id)), ' ', hex(xxhash64(id, 1))), '0123456789', 'GHIJKLMNOP') as term"
    )
    values = terms.selectExpr("entry as key", "field", "0 as pos", "concat(substr(term, 1, 20), 'Q', substr(term, 22)) as value").where("pmod(xxhash64(key), 20) = 0")
    got = c.match(values, terms, limit=1000, shard_forms=15_000).collect()
    assert len(got) == values.count() and all(r.entry == r.key for r in got)


def test_null_keys_are_kept(spark):
    rows = [(None, "f", ["house mice"]), (None, "f", ["house mice"]), (1, "f", ["ixodids"]), (1, "f", ["ixodids"])]
    values = c.members(spark.createDataFrame(rows, "id int, attr string, vals array<string>"), "id", "attr", "vals")
    assert sorted((str(r.key), r.value) for r in values.collect()) == [("1", "ixodids"), ("None", "house mice"), ("None", "house mice")]
