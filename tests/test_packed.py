import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
import pyarrow as pa

from quillspan.operators.packed import split_batch, split_packed

CASES = {
    "a; b ;c": ["a", "b", "c"],
    '"x; y", z': ["x; y", "z"],
    '"the ""old"" camp"|b': ['the "old" camp', "b"],
    "'the \"old\" camp', b": ['the "old" camp', "b"],
    '["a, b", "the \\"old\\" camp"]': ["a, b", 'the "old" camp'],
    "['a, b', 'c']": ["a, b", "c"],
    "1) x, 2) 1,250 homes": ["x", "1,250 homes"],
    "1. x 2. y 3. z": ["x", "y", "z"],
    "(a) x (east, west) (b) y": ["x (east, west)", "y"],
    "(i) x (ii) y": ["x", "y"],
    "- x\n- y": ["x", "y"],
    "• x\r\n• y": ["x", "y"],
    "R&D site / on/off-site, and z": ["R&D site", "on/off-site", "z"],
    "a, b, & c": ["a", "b", "c"],
    "a, , b,": ["a", "b"],
    "ducks and geese, dogs": ["ducks and geese", "dogs"],
    "trial & error": ["trial & error"],
    'half "open, b': ['half "open', "b"],
    "dogs' food, cats": ["dogs' food", "cats"],
    "a (b, c": ["a (b", "c"],
    "": [], " ; , ": [], "-": ["-"], "n/a": ["n/a"], "a\tb": ["a", "b"], "a；b": ["a", "b"],
}


def split(texts):
    parent, position, text = split_batch(pa.array(texts, pa.string()))
    out = [[] for _ in texts]
    for p, k, t in zip(parent, position, text.to_pylist()):
        assert k == len(out[p])
        out[p].append(t)
    return out


@pytest.mark.parametrize("text", CASES)
def test_cases(text):
    assert split([text]) == [CASES[text]]


def test_neighbours_do_not_matter():
    texts = [None, *CASES, None, "", *reversed(CASES)]
    assert split(texts) == [CASES.get(t, []) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="ab \"'(),;|/1.-[]\n&é•\\", max_size=30), max_size=8))
def test_any_text_alone_or_in_a_batch(texts):
    assert split(texts) == [split([t])[0] for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abc ,;\"", min_size=1, max_size=8).filter(lambda t: t.strip(' ') == t and t.strip('" ')), min_size=2, max_size=6))
def test_quoted_round_trip(items):
    packed = "; ".join('"' + i.replace('"', '""') + '"' for i in items)
    assert split([packed]) == [items]


def test_table(spark):
    rows = [(1, "a;b", 0), (1, "a;b", 0), (2, None, 0), (3, "x" * 100_000 + "|y", 0), (None, "p,q", 0)]
    got = split_packed(spark.createDataFrame(rows, "k long, v string, pos int"), "k", "v").collect()
    assert sorted((str(r.k), r.pos, r["item"][:1], r.n_items) for r in got) == [
        ("1", 0, "a", 2), ("1", 1, "b", 2), ("3", 0, "x", 2), ("3", 1, "y", 2), ("None", 0, "p", 2), ("None", 1, "q", 2),
    ]
    assert split_packed(spark.createDataFrame([], "k long, v string"), "k", "v").collect() == []


def test_long_numberings():
    from quillspan.operators.packed import label_of

    assert [label_of("roman", n) for n in (4, 14, 40, 49, 99, 1994)] == ["iv", "xiv", "xl", "xlix", "xcix", "mcmxciv"]
    assert [label_of("letter", n) for n in (1, 26, 27, 702, 703)] == ["a", "z", "aa", "zz", "aaa"]
    for kind, marks in (("roman", "({})"), ("letter", "{})"), ("number", "{}.")):
        items = [f"item {kind} of {n * n}" for n in range(1, 1201)]
        packed = " ".join(marks.format(label_of(kind, n)) + " " + x for n, x in enumerate(items, 1))
        assert split([packed, packed]) == [items, items]


def test_rows_of_null_key_all_stay(spark):
    rows = [(None, "a;b"), (None, "a;b"), (None, "c"), (1, "a"), (1, "a"), (1, "d")]
    got = split_packed(spark.createDataFrame(rows, "k long, v string"), "k", "v").collect()
    assert sorted((str(r.k), r["item"]) for r in got) == [("1", "a"), ("1", "d"), ("None", "a"), ("None", "a"), ("None", "b"), ("None", "b"), ("None", "c")]
