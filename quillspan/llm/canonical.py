"""Free-entered values to the entries of a canonical list.

Values and entries are brought to a plain spelling, entries also to the shortened and
inflected forms in which people write them. All forms of all entries are made and weighed
against each other once, by a shuffle on the form: a form names the entries that give it
in the plainest way, and accepts no slip if it is a code of any entry.

A BK-tree over the forms under the Levenshtein distance, a true metric, is searched with a
radius of 1, so that the triangle inequality prunes subtrees and no form within one slip is
lost; two swapped neighbours, also one slip, are 2 apart and are found by looking up the
swaps of the value. The tree is walked for all open values of a task at once: at each node
the distances of the values that reach it are computed together, bit-parallel.

Trees are built by tasks, one per field and shard, from finished forms. Trees of a proven
size are broadcast and the values stay where they are; with more forms every shard answers
for blocks of distinct values, and the winners of the shards are merged. The answers do not
depend on the way: a shard knows nothing that the whole does not.
"""

from __future__ import annotations

import math
import pickle
import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.runtime import cut, delivered_once

# Words put before a value, and notes put behind it, that do not change what it names.
BEFORE = ("the", "use of", "mainly", "reported", "of")
NOTES = re.compile(r"[\s_-]*(?:\((?:inferred|not[\s_-]+mentioned)\)|\[\d+\])")
ABBREVIATED = range(3, 7)
RADIUS = 1
SHORT = 4
WIDE = 128  # characters up to which texts share a matrix
FEW = 24  # values up to which one by one is faster than together
EXACT, INFLECTED, SHORTENED = 0, 1, 2


def plain(text: str) -> str:
    """Lower case without accents, notes, and doubled or unusual blanks; 0 in a word is an o."""
    text = unicodedata.normalize("NFKD", text.lower())
    text = "".join(c for c in text if not unicodedata.combining(c))
    text = NOTES.sub("", text)
    text = re.sub(r"(?<=[a-z])0|0(?=[a-z])", "o", text)
    text = re.sub(r"[\s_*\-‐-―]+", " ", text)
    return re.sub(r"\s+([.,;])", r"\1", text).strip(" .;,")


def within_one(a: str, b: str) -> bool:
    """Whether one slip (a character more, less or other, or two swapped) turns a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    x, y = a[i:], b[i:]
    return x[1:] == y[1:] or x == y[1:] or x[1:] == y or (x[:2] == y[1::-1] and x[2:] == y[2:] and len(x) > 1)


def readings(text: str, longest: int | None = None) -> list[str]:
    """The plain spellings a value may stand for: as written, words in front taken off, and
    inverted orders (``last, first`` and ``last of first``) turned round, also repeatedly.

    Every turn takes a comma or a word away, so there is an end to them. A value whose words
    that must stay have more letters than ``longest``, the longest form and a slip, has none.
    """
    first = plain(text)
    if longest is not None and len(first) > longest:
        kept = [w.strip(".;()[]") for w in re.split(r"[ ,]+", first)]
        if sum(len(w) for w in kept if not _may_go(w)) > longest:
            return []
    out, seen, open_ = [], {""}, [first]
    for s in open_:  # grows while it is walked
        if s in seen:
            continue
        seen.add(s)
        out.append(s)
        words = s.split(" ")
        for lead in BEFORE:
            n = lead.count(" ") + 1
            if len(words) > n:
                head = " ".join(words[:n])
                if head == lead or (len(lead) > SHORT and within_one(head, lead)):
                    open_.append(" ".join(words[n:]))
        if "," in s:
            a, b = s.split(",", 1)
            open_.append(plain(b.strip() + " " + a.strip()))
            a, b = s.rsplit(",", 1)
            open_.append(plain(b.strip() + " " + a.strip()))
        turned = re.fullmatch(r"(\S+) of (.+)", s)
        if turned:
            open_.append(plain(turned[2] + " " + turned[1]))
    return out


_LEADING = frozenset(w for lead in BEFORE for w in lead.split())
_NOTED = frozenset(("inferred", "not", "mentioned"))


def _may_go(word: str) -> bool:
    """Whether some turn may take the word away: a word in front, or a part of a note."""
    return word in _LEADING or word in _NOTED or word.isdigit() or any(len(x) > SHORT and within_one(word, x) for x in _LEADING)


def entry_forms(term: str) -> dict[str, int]:
    """Forms under which an entry's term may be written, with their kind; the term first."""
    words = term.lower().split()
    forms = {plain(term): EXACT}

    def add(text: str, kind: int) -> None:
        text = plain(text)
        if text and text not in forms:
            forms[text] = kind

    add(term + "s", INFLECTED)
    if len(words) > 1:
        for i, word in enumerate(words):
            rest = words[:i] + words[i + 1 :]
            add(" ".join(rest), SHORTENED)
            add(" ".join(rest) + "s", SHORTENED)
    for i, word in enumerate(words):
        for k in ABBREVIATED:
            if k < len(word):
                cut = " ".join([*words[:i], word[:k] + ".", *words[i + 1 :]])
                add(cut, SHORTENED)
                add(cut + "s" if i < len(words) - 1 else cut, SHORTENED)
    return forms


def is_code(term: str) -> bool:
    """An acronym: too short for a slip to be told from another acronym."""
    return len(plain(term)) <= SHORT or (term.strip().isupper() and " " not in term.strip() and len(term.strip()) <= 6)


@dataclass
class Tree:
    """BK-tree: each node's children by their Levenshtein distance from it."""

    terms: list[str] = field(default_factory=list)
    children: list[dict[int, int]] = field(default_factory=list)

    @classmethod
    def of(cls, terms: Iterable[str]) -> Tree:
        """The tree of distinct terms, level by level: a node's terms are measured together."""
        tree, terms = cls(), sorted(set(terms))
        text = Texts(terms)
        open_ = [(np.arange(len(terms)), -1, 0)] if terms else []
        while open_:
            who, parent, edge = open_.pop()
            node, rest = len(tree.terms), who[1:]
            tree.terms.append(terms[who[0]])
            tree.children.append({})
            if parent >= 0:
                tree.children[parent][edge] = node
            if len(rest):
                far = text.distances(terms[who[0]], rest)
                order = np.argsort(far, kind="stable")
                split = np.flatnonzero(np.diff(far[order])) + 1
                open_ += [(own, node, int(far[at])) for own, at in zip(np.split(rest[order], split), order[np.append(0, split)])]
        return tree

    def add(self, term: str) -> None:
        self.terms.append(term)
        self.children.append({})
        new = len(self.terms) - 1
        at = 0
        while new:
            d = _levenshtein(self.terms[at], term)
            if d == 0 or d not in self.children[at]:
                self.children[at].setdefault(d, new)
                return
            at = self.children[at][d]

    def within(self, values: list[str], radius: int) -> list[list[tuple[int, str]]]:
        """For each value every term within the radius, with its distance."""
        found: list[list[tuple[int, str]]] = [[] for _ in values]
        if not self.terms or not values:
            return found
        text = Texts(values)
        open_ = [(0, np.arange(len(values)))]
        while open_:
            node, who = open_.pop()
            far = text.distances(self.terms[node], who)
            for i in np.flatnonzero(far <= radius):
                found[who[i]].append((int(far[i]), self.terms[node]))
            for edge, child in self.children[node].items():
                near = who[np.abs(far - edge) <= radius]
                if len(near):
                    open_.append((child, near))
        return found


class Texts:
    """Many texts as one matrix of character codes, for distances to one term at a time."""

    def __init__(self, values: list[str]):
        self.values = values
        self.length = np.array([len(v) for v in values], int)
        self.wide = self.length > WIDE  # kept out, so that one long text does not widen all
        width = int(self.length[~self.wide].max(initial=0))
        padded = (("" if w else v).ljust(width, "\0") for v, w in zip(values, self.wide))
        points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.alphabet, codes = np.unique(points, return_inverse=True)
        self.codes = codes.astype(np.int32).reshape(len(values), width).T.copy() if width else np.zeros((0, len(values)), np.int32)

    def distances(self, term: str, who: np.ndarray) -> np.ndarray:
        """Levenshtein distances of the texts ``who`` to the term (Myers' bit vectors)."""
        m = len(term)
        if m == 0:
            return self.length[who]
        if m > 63 or len(who) <= FEW or self.wide[who].any():
            return np.array([_levenshtein(term, self.values[i]) for i in who])
        masks = np.zeros(len(self.alphabet), np.uint64)
        places = defaultdict(int)
        for i, c in enumerate(term):
            places[ord(c)] |= 1 << i
        where = np.searchsorted(self.alphabet, list(places))
        for at, (point, bits) in zip(where, places.items()):
            if at < len(self.alphabet) and self.alphabet[at] == point:
                masks[at] = bits
        length = self.length[who]
        one, top = np.uint64(1), np.uint64(m - 1)
        plus = np.full(len(who), (1 << m) - 1, np.uint64)
        minus = np.zeros(len(who), np.uint64)
        score = np.full(len(who), m)
        for j in range(int(length.max(initial=0))):
            eq = masks[self.codes[j, who]]
            xv = eq | minus
            xh = (((eq & plus) + plus) ^ plus) | eq
            ph, mh = minus | ~(xh | plus), plus & xh
            live = j < length
            score += live * ((ph >> top & one).astype(int) - (mh >> top & one).astype(int))
            ph, mh = (ph << one) | one, mh << one
            plus, minus = mh | ~(xv | ph), ph & xv
        return score


def _levenshtein(a: str, b: str) -> int:
    """The same bit vectors in one long integer, for terms beyond a machine word."""
    if not a:
        return len(b)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(a):
        masks[c] |= 1 << i
    full, top = (1 << len(a)) - 1, 1 << (len(a) - 1)
    plus, minus, score = full, 0, len(a)
    for c in b:
        eq = masks.get(c, 0)
        xv, xh = eq | minus, (((eq & plus) + plus) ^ plus) | eq
        ph, mh = (minus | ~(xh | plus)) & full, plus & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = (ph << 1 | 1) & full, (mh << 1) & full
        plus, minus = (mh | ~(xv | ph)) & full, ph & xv
    return score


@dataclass(frozen=True)
class Form:
    """What a form names: the least and the greatest of its entries, how plainly, and whether it is a code."""

    kind: int
    low: str
    high: str
    code: bool


def forms_of(entries: Iterable[tuple[str, str]]) -> Iterator[tuple[str, int, str, bool]]:
    """``form, kind, entry, code`` for each form of each (entry, term)."""
    for entry, term in entries:
        code = is_code(term)
        for form, kind in entry_forms(term).items():
            yield form, kind, entry, code


def weighed(forms: Iterable[tuple[str, int, str, bool]]) -> dict[str, Form]:
    """Each form with the entries that give it in the plainest way."""
    out: dict[str, Form] = {}
    for form, kind, entry, code in forms:
        old = out.get(form)
        if old is None or kind < old.kind:
            out[form] = Form(kind, entry, entry, code or (old is not None and old.code))
        elif kind == old.kind:
            out[form] = Form(kind, min(old.low, entry), max(old.high, entry), code or old.code)
        elif code and not old.code:
            out[form] = Form(old.kind, old.low, old.high, True)
    return out


class Matcher:
    """The forms of one field, or a shard of them, and the trees over those that accept a slip."""

    def __init__(self, entries: Iterable[tuple[str, str]] = (), forms: dict[str, Form] | None = None):
        self.forms = weighed(forms_of(entries)) if forms is None else forms
        # shortened forms are many and come last in rank: they are searched only for what the others leave open
        open_ = [f for f, x in self.forms.items() if not x.code and len(f) > SHORT]
        self.trees = tuple(Tree.of(f for f in open_ if (self.forms[f].kind == SHORTENED) == last) for last in (False, True))
        self.longest = max(map(len, self.forms), default=0) + RADIUS

    def best(self, values: list[str]) -> list[tuple[int, int, set[str]] | None]:
        """For each value the least (slips, kind) reached and the entries that reach it,
        of each form its least and greatest."""
        read = [[s for s in readings(v, self.longest) if len(s) <= self.longest] for v in values]
        first = [self._met(0, [(s, s) for s in r]) for r in read]
        for tree, last in zip(self.trees, (False, True)):
            rest = sorted({s for r, hit in zip(read, first) if hit is None for s in r})
            near: dict[str, tuple[int, int, set[str]]] = {}
            for s, found in zip(rest, tree.within(rest, RADIUS)):
                terms = [t for _, t in found] + [t for t in self._swaps(s) if (self.forms[t].kind == SHORTENED) == last]
                got = self._met(1, [(s, t) for t in terms])
                if got:
                    near[s] = got
            met = [[near[s] for s in r if s in near] for r in read]
            first = [hit if hit is not None or not m else _merge(m) for hit, m in zip(first, met)]
        return first

    def _swaps(self, s: str) -> list[str]:
        """Forms that accept a slip and are the text with two neighbours swapped."""
        turned = (s[:i] + s[i + 1] + s[i] + s[i + 2 :] for i in range(len(s) - 1))
        return [t for t in turned if t in self.forms and not self.forms[t].code and len(t) > SHORT]

    def _met(self, slips: int, pairs: list[tuple[str, str]]) -> tuple[int, int, set[str]] | None:
        held = [self.forms[t] for _, t in pairs if t in self.forms]
        return _merge([(slips, x.kind, {x.low, x.high}) for x in held]) if held else None


def _merge(found: list[tuple[int, int, set[str]]]) -> tuple[int, int, set[str]]:
    least = min((d, k) for d, k, _ in found)
    return (*least, set().union(*(e for d, k, e in found if (d, k) == least)))


def members(rows: DataFrame, key: str, field_: str, values: str) -> DataFrame:
    """``key, field, pos, value``: the members of each row's list that are not null or blank.

    ``pos`` is the index in the list. Rows delivered more than once count once, by ``key``;
    different lists under one key keep a row each, and so do rows of null key.
    """
    one = delivered_once(rows.select(F.col(key).alias("_k"), F.col(field_).alias("_f"), F.col(values).alias("_v")), "_k")
    exploded = one.select(F.col("_k").alias("key"), F.col("_f").alias("field"), F.posexplode("_v").alias("pos", "value"))
    return exploded.where(F.col("value").isNotNull() & F.col("value").rlike(r"(?U)\S"))


def entry_terms(entries: DataFrame, entry: str, field_: str, label: str, alt_terms: str) -> DataFrame:
    """``field, entry, term``: label and alternative terms of each entry, blanks left out."""
    every = F.concat(F.array(F.col(label)), F.coalesce(F.col(alt_terms), F.array().cast("array<string>")))
    terms = entries.select(F.col(field_).alias("field"), F.col(entry).alias("entry"), F.explode(every).alias("term"))
    kept = terms.where(
        F.col("term").rlike(r"(?U)\S") & F.col("entry").rlike(r"(?U)\S") & F.col("field").isNotNull()
    )
    return kept.distinct()


def finished_forms(terms: DataFrame) -> DataFrame:
    """``field, form, kind, low, high, code``: all forms of a field's entries, weighed over all of them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(f, *x) for f, e, t in batch[["field", "entry", "term"]].itertuples(index=False) for x in forms_of([(e, t)])]
            yield pd.DataFrame(rows, columns=["field", "form", "kind", "entry", "code"])

    made = terms.mapInPandas(run, "field string, form string, kind int, entry string, code boolean")
    by_kind = made.groupBy("field", "form", "kind").agg(
        F.min("entry").alias("low"), F.max("entry").alias("high"), F.max("code").alias("code")
    )
    return by_kind.groupBy("field", "form").agg(
        F.min("kind").alias("kind"), F.min_by("low", "kind").alias("low"), F.min_by("high", "kind").alias("high"), F.max("code").alias("code")
    )


def built(forms: DataFrame) -> DataFrame:
    """``field, shard, matcher``: the forms and trees of each shard, built by its task."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        own = {r.form: Form(r.kind, r.low, r.high, bool(r.code)) for r in pdf.itertuples(index=False)}
        return pd.DataFrame({"field": pdf["field"][:1], "shard": pdf["shard"][:1], "matcher": [pickle.dumps(Matcher(forms=own))]})

    return forms.groupBy("field", "shard").applyInPandas(build, "field string, shard int, matcher binary")


def match(
    values: DataFrame, terms: DataFrame, limit: int = 200_000, shards: int | None = None, blocks: int | None = None,
    shard_forms: int = 100_000, block_values: int = 100_000,
) -> DataFrame:
    """``key, field, pos, value, entry``: each value with the entry of its field that it names.

    ``values`` has the columns of ``members``, ``terms`` those of ``entry_terms``. ``entry``
    is empty where no form of an entry is within one slip, or where the closest forms
    belong to different entries; codes of few letters must be met exactly. Values of
    fields without entries are left out. Null or blank values, empty lists and empty
    tables give no rows; repeated values keep a row each; very long values are compared
    whole. ``limit`` is the number of forms, of 64 characters on average, up to which the
    trees are broadcast; beyond it a shard has about ``shard_forms`` forms and a block about
    ``block_values`` values, unless ``shards`` and ``blocks`` are given. The result is the same.
    """
    forms = cut(finished_forms(terms))
    sizes = forms.groupBy("field").agg(F.count("*").alias("n"), F.sum(F.length("form")).alias("length")).collect()  # a row a field
    if sum(r["n"] for r in sizes) <= limit and sum(r["length"] for r in sizes) <= 64 * limit:
        return _match_broadcast(values, built(forms.withColumn("shard", F.lit(0))).collect())  # of checked size
    number = {r["field"]: shards or max(1, math.ceil(r["n"] / shard_forms)) for r in sizes}
    return _match_sharded(values, forms, number, blocks, block_values)


@lru_cache(maxsize=64)
def _loaded(matcher: bytes) -> Matcher:
    """A matcher that a worker's tasks share."""
    return pickle.loads(matcher)


def _match_broadcast(values: DataFrame, trees: list) -> DataFrame:
    sent = values.sparkSession.sparkContext.broadcast({r["field"]: bytes(r["matcher"]) for r in trees})
    kept = values.where(F.col("field").isin(sorted(r["field"] for r in trees)))
    schema = ", ".join(f"{c} {t}" for c, t in values.select("key", "field", "pos", "value").dtypes) + ", entry string"

    def answer(table: pa.Table) -> Iterator[pa.RecordBatch]:
        out = np.full(table.num_rows, "", object)
        fields = np.array(table.column("field").to_pylist(), object)
        texts = np.array(table.column("value").to_pylist(), object)
        for f in set(fields.tolist()):
            at = np.flatnonzero(fields == f)
            distinct, inverse = np.unique(texts[at], return_inverse=True)
            found = _loaded(sent.value[f]).best(distinct.tolist())
            name = [next(iter(x[2])) if x and len(x[2]) == 1 else "" for x in found]
            out[at] = np.array(name, object)[inverse]
        yield from table.append_column("entry", pa.array(out, pa.string())).to_batches()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= 100_000:
                yield from answer(pa.Table.from_batches(held))
                held = []
        if held:
            yield from answer(pa.Table.from_batches(held))

    return kept.select("key", "field", "pos", "value").mapInArrow(run, schema)


def _match_sharded(values: DataFrame, forms: DataFrame, shards: dict[str, int], blocks: int | None, block_values: int) -> DataFrame:
    """Every shard of a field's forms answers for every block of its distinct values.

    Shards and blocks are sized by counts, so a field that holds most values or most forms is
    split like any other. A tree is built once and sent to the blocks.
    """
    spark = forms.sparkSession
    number = spark.createDataFrame(sorted(shards.items()), "field string, shards int") if shards else None
    if number is None:
        return values.where("false").select("key", "field", "pos", "value", F.lit("").alias("entry"))
    kept = values.join(F.broadcast(number.select("field")), "field", "left_semi")  # a row a field
    distinct = cut(kept.select("field", "value").distinct())
    counts = distinct.groupBy("field").agg(F.count("*").alias("n")).collect()
    sizes = [(r["field"], shards[r["field"]], blocks or max(1, math.ceil(r["n"] / block_values))) for r in counts]
    sized = F.broadcast(spark.createDataFrame(sizes, "field string, shards int, blocks int"))
    placed = forms.join(F.broadcast(number), "field")
    trees = cut(built(placed.withColumn("shard", F.pmod(F.xxhash64("form"), F.col("shards")).cast("int")).drop("shards")))
    asked = distinct.join(sized, "field").select(
        "field", "value", F.pmod(F.xxhash64("value"), F.col("blocks")).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"),
    )
    held = trees.join(sized, "field").select("field", "shard", "matcher", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def run(key: tuple, queries: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        texts = queries["value"].tolist()
        found = _loaded(bytes(own["matcher"].iloc[0])).best(texts) if len(own) and texts else [None] * len(texts)
        rows = [(key[0], v, x[0], x[1], min(x[2]), max(x[2])) for v, x in zip(texts, found) if x]
        return pd.DataFrame(rows, columns=["field", "value", "slips", "kind", "low", "high"])

    keys = ["field", "shard", "block"]
    answers = asked.groupBy(keys).cogroup(held.groupBy(keys)).applyInPandas(
        run, "field string, value string, slips int, kind int, low string, high string"
    )
    rank = F.col("slips") * 10 + F.col("kind")
    by_rank = answers.groupBy("field", "value", rank.alias("rank")).agg(F.min("low").alias("low"), F.max("high").alias("high"))
    named = by_rank.groupBy("field", "value").agg(F.min_by("low", "rank").alias("low"), F.min_by("high", "rank").alias("high"))
    entry = F.when(F.col("low") == F.col("high"), F.col("low")).otherwise("")
    return kept.join(named, ["field", "value"], "left").select("key", "field", "pos", "value", F.coalesce(entry, F.lit("")).alias("entry"))
