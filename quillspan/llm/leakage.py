"""Held-out passages in a training corpus, by a prefix-filtered set join.

A passage is a sentence of an evaluation item that stands in no other item. A document
repeats it if somewhere at most ``edits`` words have to be changed, left out or added, a
quarter of the passage's words with the default ``share``: single words may be changed, and
one change in fourteen words already breaks half of the five-word shingles.

The prefix of a passage are ``edits + 2`` shingles of one to four words that do not overlap,
chosen so that they are rarest together. So many edits leave two of them untouched: a
document that repeats the passage has two of them, at places whose distance is off by no
more than ``edits``, and no repeat is lost. What the prefix finds is verified exactly, by the
least number of edits between the passage and a window of its size.

The documents are read once. Passages of a proven size are broadcast as an index of prefix
shingles; more of them stay a table that is joined by shingle, of which the documents send
only what a Bloom filter of fixed size lets through. Both ways give the same rows.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspan.runtime import cut

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"(?<=[.!?。])[\"'»”)]*\s+|\n+")
#: Words of the widest shingle.
WIDEST = 4
#: Prefix shingles beyond the edits: so many of them are left unchanged in every repeat.
SPARE = 2
#: Bits of the Bloom filter (2 MB).
BLOOM_BITS = 1 << 24
# Letters of other scripts that look like Latin ones, and those.
LOOKALIKES = "аеорсухіѕјԁһвкмнтαοερνικτ"
LATIN = "aeopcyxisjdhbkmhtaoepvikt"


def _folding() -> dict[int, str | None]:
    """Characters to what they are compared as: accents off, look-alikes Latin, joiners gone."""
    table: dict[int, str | None] = {}
    for c in range(0x80, 0x2000):
        if unicodedata.category(chr(c)) in ("Ll", "Lu", "Lo", "Lm"):
            base = "".join(x for x in unicodedata.normalize("NFKD", chr(c)) if not unicodedata.combining(x)).lower()
            if base and base != chr(c):
                table[c] = base
        elif unicodedata.combining(chr(c)):
            table[c] = None
    table.update({ord(a): b for a, b in zip(LOOKALIKES, LATIN)})
    table.update({ord(a.upper()): b for a, b in zip(LOOKALIKES, LATIN)})
    table.update({c: chr(c - 0xFEE0).lower() for c in range(0xFF01, 0xFF5F)})
    return table


FOLD = _folding()


JOINERS = re.compile("[\u00ad\u200b\u200c\u200d\u2060\ufeff]")


def raw_words(text: str) -> list[str]:
    """The words of a text in lower case, before folding."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", JOINERS.sub("", text))
    return WORD.findall(text)


def words_of(text: str) -> list[str]:
    """The words of a text as they are compared: case, accents, marks and layout left out."""
    return [w if w.isascii() else w.translate(FOLD) for w in raw_words(text)]


class Numbers(dict):
    """Written word to its number in a vocabulary, -1 without one; remembers what it was asked."""

    def __init__(self, vocabulary: dict[str, int], remembered: int = 1_000_000):
        super().__init__(vocabulary)
        self.vocabulary, self.remembered = vocabulary, remembered

    def __missing__(self, word: str) -> int:
        if len(self) > self.remembered:
            self.clear()
            self.update(self.vocabulary)
        self[word] = number = self.vocabulary.get(word if word.isascii() else word.translate(FOLD), -1)
        return number


def number_of(word: str) -> int:
    """A word's number: the same wherever it is read. 0 stands for no word."""
    return (xxhash.xxh64_intdigest(word) >> 1) | 1


class WordNumbers(dict):
    """Written word to the number of its folded form; remembers what it was asked."""

    def __init__(self, remembered: int = 1_000_000):
        super().__init__()
        self.remembered = remembered

    def __missing__(self, word: str) -> int:
        if len(self) > self.remembered:
            self.clear()
        self[word] = number = number_of(word if word.isascii() else word.translate(FOLD))
        return number


def passages_of(items: DataFrame, item: str, text: str, lang: str, least_words: int) -> DataFrame:
    """``item, lang, words``: sentences of enough words that stand in exactly one item."""
    kind = items.schema[item].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, body, language in batch.itertuples(index=False):
                for sentence in SENTENCE.split(body or ""):
                    if len(sentence.split()) >= least_words:
                        rows.append((key, language or "", words_of(sentence)))
            yield pd.DataFrame(rows, columns=["item", "lang", "words"])

    cut = items.select(F.col(item), F.col(text), F.lower(F.col(lang))).mapInPandas(
        run, f"item {kind}, lang string, words array<string>"
    )
    once = cut.groupBy("words").agg(
        F.countDistinct("item").alias("n"), F.min("item").alias("item"), F.min("lang").alias("lang")
    )
    return once.where((F.col("n") == 1) & (F.size("words") > 1)).select("item", "lang", "words")


def edits_of(n: np.ndarray | int, share: float):
    """Words of a passage of ``n`` that may change so that ``share`` of it is left."""
    return np.floor((1 - share) * np.asarray(n) + 1e-9).astype(int)


def shingles(word: np.ndarray, width: int) -> np.ndarray:
    """Numbers of all runs of ``width`` words, from the words' own numbers."""
    h = word.astype(np.uint64)
    for j in range(1, width):
        h = (h[:-1] ^ (h[:-1] >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + word[j:].astype(np.uint64)
    return ((h ^ (h >> np.uint64(31))) + np.uint64(width)).view(np.int64)


def prefixes(rarity: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and widths of ``parts`` shingles that do not overlap and are rarest together.

    For passages of one length, a row each with the share of passages that hold its words. A
    shingle is expected as often as the product of its words' shares says; the sum over the
    prefix is made least, word by word.
    """
    rows, n = rarity.shape
    logs = np.concatenate([np.zeros((rows, 1)), np.cumsum(np.log(rarity), axis=1)], axis=1)
    least = np.full((n + 1, rows, parts + 1), np.inf)
    least[:, :, 0] = 0
    taken = np.zeros((n + 1, rows, parts + 1), np.int8)
    for end in range(1, n + 1):
        least[end] = least[end - 1]
        for width in range(1, min(WIDEST, end) + 1):
            cost = least[end - width, :, :-1] + np.exp(logs[:, end] - logs[:, end - width])[:, None]
            better = cost < least[end, :, 1:]
            least[end, :, 1:][better] = cost[better]
            taken[end, :, 1:][better] = width
    each, end, left = np.arange(rows), np.full(rows, n), np.full(rows, parts)
    places, widths = np.zeros((rows, parts), np.int32), np.zeros((rows, parts), np.int32)
    while (left > 0).any():
        width = np.where(left > 0, taken[end, each, left], 0).astype(int)
        here = width > 0
        end -= np.where(left > 0, np.maximum(width, 1), 0)
        places[each[here], left[here] - 1], widths[each[here], left[here] - 1] = end[here], width[here]
        left -= here
    return places, widths


def prefixed(passages: DataFrame, share: float) -> DataFrame:
    """``_pid, _item, words, tokens, places, widths``: word numbers and prefix of each passage."""
    held = passages.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("held"))
    total = passages.agg(F.count("*").alias("total"))
    placed = passages.withColumn("_pid", F.xxhash64("words", "item")).select("_pid", "item", F.posexplode("words").alias("at", "word"))
    rows = placed.join(held, "word").crossJoin(F.broadcast(total)).groupBy("_pid", "item").agg(  # total is one row
        F.array_sort(F.collect_list(F.struct("at", "word", (F.col("held") / (F.col("total") + 1)).alias("r")))).alias("all")  # one passage
    )
    kind = passages.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes = batch["w"].map(len)
            for n in sorted(set(sizes)):
                own = batch[sizes == n]
                words = np.array([[number_of(w) for w in x] for x in own["w"]], np.int64)
                places, widths = prefixes(np.stack(own["r"].tolist()), int(edits_of(n, share)) + SPARE)
                wide = [shingles(words.ravel(), w) for w in range(1, WIDEST + 1)]
                starts = places + n * np.arange(len(own))[:, None]
                tokens = [[int(wide[w - 1][p]) for p, w in zip(*x)] for x in zip(starts, widths)]
                yield pd.DataFrame({"_pid": own["_pid"], "_item": own["item"], "words": list(words), "tokens": tokens,
                                    "places": list(places), "widths": list(widths)})

    arrays = "words array<bigint>, tokens array<bigint>, places array<int>, widths array<int>"
    return rows.select("_pid", "item", F.col("all.word").alias("w"), F.col("all.r").alias("r")).mapInPandas(
        run, f"_pid bigint, _item {kind}, {arrays}"
    )


@dataclass
class Index:
    """Passages and the postings of their prefix shingles."""

    item: list
    size: np.ndarray
    words: np.ndarray
    start: np.ndarray
    widths: list[int]
    tokens: np.ndarray
    first: np.ndarray
    passage: np.ndarray
    place: np.ndarray

    @classmethod
    def build(cls, rows: list) -> Index:
        token = np.array([t for r in rows for t in r["tokens"]], np.int64)
        passage = np.repeat(np.arange(len(rows)), [len(r["tokens"]) for r in rows])
        place = np.array([p for r in rows for p in r["places"]], np.int64)
        by = np.argsort(token, kind="stable")
        tokens, first = np.unique(token[by], return_index=True)
        widths = sorted({w for r in rows for w in r["widths"]})
        size = np.array([len(r["words"]) for r in rows], np.int64)
        words = np.array([w for r in rows for w in r["words"]], np.int64)
        return cls(
            [r["_item"] for r in rows], size, words, np.cumsum(size) - size, widths, tokens, np.append(first, len(token)),
            passage[by], place[by],
        )

    def bloom(self) -> np.ndarray:
        bits = np.zeros(BLOOM_BITS, bool)
        bits[self.tokens & (BLOOM_BITS - 1)] = True
        return bits


def numbered(texts: list[str | None], numbers: WordNumbers) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of many texts in a row, and where each text ends."""
    ids: list[int] = []
    ends = []
    for text in texts:
        if text:
            ids.extend([numbers[w] for w in raw_words(text)])
        ends.append(len(ids))
    return np.array(ids, np.int64), np.array(ends, np.int64)


def hits(word: np.ndarray, doc: np.ndarray, widths: list[int], bloom: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and numbers of the shingles within one text that may be prefix shingles."""
    at, token = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for width in widths:
        if len(word) >= width:
            own = shingles(word, width)
            here = np.flatnonzero(bloom[own & (BLOOM_BITS - 1)])
            here = here[doc[here] == doc[here + width - 1]]
            at.append(here)
            token.append(own[here])
    return np.concatenate(at), np.concatenate(token)


def search(index: Index, bloom: np.ndarray, texts: list[str | None], share: float, numbers: WordNumbers) -> list[tuple[int, int]]:
    """(text, passage) for each text that repeats a passage."""
    word, end = numbered(texts, numbers)
    doc = np.repeat(np.arange(len(texts)), np.diff(end, prepend=0))
    at, token = hits(word, doc, index.widths, bloom)
    if not len(at) or not len(index.tokens):
        return []
    slot = np.minimum(np.searchsorted(index.tokens, token), len(index.tokens) - 1)
    right = index.tokens[slot] == token
    at, slot = at[right], slot[right]
    count = index.first[slot + 1] - index.first[slot]
    post = np.repeat(index.first[slot] - np.cumsum(count) + count, count) + np.arange(count.sum())
    passage, begin = index.passage[post], np.repeat(at, count) - index.place[post]
    # by text and passage in the order of where the passage would begin; each hit needs another one near
    pair = np.repeat(doc[at], count) * len(index.item) + passage
    by = np.lexsort((begin, pair))
    pair, begin, passage = pair[by], begin[by], passage[by]
    edits = edits_of(index.size, share)[passage]
    near = np.zeros(len(pair), bool)
    close = (pair[1:] == pair[:-1]) & (np.diff(begin) <= edits[1:])
    near[1:] |= close
    near[:-1] |= close
    near[1:] &= ~((pair[1:] == pair[:-1]) & (begin[1:] == begin[:-1]))  # one of equal ones
    pair, begin, passage = pair[near], begin[near], passage[near]
    owner, n = pair // len(index.item), index.size[passage]
    starts = np.append(0, end)
    found = np.zeros(len(passage), bool)
    for size in np.unique(n):
        k = int(edits_of(size, share))
        # a text shorter than what must be left of a passage cannot repeat it
        who = np.flatnonzero((n == size) & (starts[owner + 1] - starts[owner] >= size - k))
        span = begin[who][:, None] + np.arange(-k, size + k)
        inside = (span >= starts[owner[who]][:, None]) & (span < starts[owner[who] + 1][:, None])
        window = np.where(inside, word[np.clip(span, 0, len(word) - 1)], 0)
        found[who] = within_edits(index.words[index.start[passage[who]][:, None] + np.arange(size)], window, k)
    return sorted({(int(t), int(p)) for t, p in zip(owner[found], passage[found])})


def within_edits(passages: np.ndarray, windows: np.ndarray, edits: int) -> np.ndarray:
    """Whether each passage meets some part of its window with at most ``edits`` words changed,
    left out or added. A row each; the number 0 stands for no word."""
    out = np.zeros(len(passages), bool)
    who = np.arange(len(passages))
    steps = np.arange(windows.shape[1] + 1, dtype=np.int16)
    cost = np.zeros((len(passages), windows.shape[1] + 1), np.int16)
    for i in range(passages.shape[1]):
        new = np.empty_like(cost)
        new[:, 0] = i + 1
        np.minimum(cost[:, :-1] + (windows != passages[:, i : i + 1]), cost[:, 1:] + 1, out=new[:, 1:])
        cost = np.minimum.accumulate(new - steps, axis=1) + steps
        if i % 4 == 3 or i == passages.shape[1] - 1:
            live = cost.min(axis=1) <= edits
            if not live.all():
                who, cost, windows, passages = who[live], cost[live], windows[live], passages[live]
    out[who] = True
    return out


def leaked(
    documents: DataFrame,
    items: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "abstract",
    item_lang: str = "lang",
    least_words: int = 14,
    share: float = 0.75,
    broadcast_bytes: int = 64_000_000,
) -> DataFrame:
    """``key, item``: each document with each item of which it repeats a passage.

    ``share`` is the part of a passage's words that must be left in place: at most the rest
    may be changed, left out or added in between. Passages up to ``broadcast_bytes`` of word
    numbers are broadcast, more are joined by shingle, with the same rows. Null and empty
    texts, and items of short sentences only, give no rows; repeated rows of either table
    count once, also under a null key. Very long texts are searched whole. Empty tables give
    an empty result; other columns are ignored.
    """
    passages = cut(prefixed(passages_of(items, item, item_text, item_lang, least_words), share))
    size = passages.agg(F.coalesce(F.sum(8 * F.size("words") + 20 * F.size("tokens")), F.lit(0))).first()[0]
    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    found = _broadcast(rows, passages, share) if size <= broadcast_bytes else _joined(rows, passages, share)
    return found.distinct().select(F.col("_key").alias(key), F.col("_item").alias(item))


def _broadcast(rows: DataFrame, passages: DataFrame, share: float) -> DataFrame:
    index = Index.build(sorted(passages.collect(), key=lambda r: r["_pid"]))  # of checked size
    sent = rows.sparkSession.sparkContext.broadcast(index)
    kind, item_kind = rows.schema["_key"].dataType.simpleString(), passages.schema["_item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, bloom = WordNumbers(), sent.value.bloom()
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                pairs = search(sent.value, bloom, part.column(1).to_pylist(), share, numbers)
                if pairs:
                    held = pa.array([sent.value.item[p] for _, p in pairs])
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array([t for t, _ in pairs])), held], names=["_key", "_item"]
                    )

    return rows.mapInArrow(run, f"_key {kind}, _item {item_kind}")


def _joined(rows: DataFrame, passages: DataFrame, share: float) -> DataFrame:
    """The same with the passages as a table: shingles of the documents meet those of the prefixes
    in an equi-join, and each document's window goes with the passage to its check."""
    tokens = passages.select("_pid", F.size("words").alias("n"), F.explode(F.arrays_zip("tokens", "places", "widths")).alias("t"))
    prefix = tokens.select("_pid", "n", F.col("t.tokens").alias("token"), F.col("t.places").alias("place"))
    widths = sorted(r[0] for r in tokens.select("t.widths").distinct().collect())  # four at most
    bit = F.col("token").bitwiseAND(F.lit(BLOOM_BITS - 1))
    # rows of 4,096 bytes, 512 at most
    parts = prefix.groupBy(F.bitmap_bucket_number(bit).alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")).collect()
    bits = np.zeros(BLOOM_BITS + (1 << 15), bool)
    for r in parts:
        own = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
        lo = (r["at"] - 1) * len(own) + 1  # bucket numbers count from 1 over positions from 1
        lo = 0 if r["at"] == 0 else lo
        bits[lo : lo + len(own)] |= own.astype(bool)
    sent = rows.sparkSession.sparkContext.broadcast(np.packbits(bits[:BLOOM_BITS]))
    kind, item_kind = rows.schema["_key"].dataType.simpleString(), passages.schema["_item"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, bloom = WordNumbers(), np.unpackbits(sent.value).astype(bool)
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                word, end = numbered(part.column(1).to_pylist(), numbers)
                doc = np.repeat(np.arange(part.num_rows), np.diff(end, prepend=0))
                at, token = hits(word, doc, widths, bloom)
                by = np.argsort(doc[at], kind="stable")
                at, token = at[by], token[by]
                begin = np.append(0, end)
                split = np.searchsorted(doc[at], np.arange(part.num_rows + 1)).astype(np.int32)
                place = (at - begin[doc[at]]).astype(np.int32)
                words = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(word))
                out = pa.RecordBatch.from_arrays(
                    [part.column(0), words, pa.ListArray.from_arrays(pa.array(split), pa.array(token)),
                     pa.ListArray.from_arrays(pa.array(split), pa.array(place))], names=["_key", "words", "tokens", "places"]
                )
                yield out.filter(pa.array(np.diff(split) > 0))

    arrays = "words array<bigint>, tokens array<bigint>, places array<int>"
    read = cut(rows.mapInArrow(run, f"_key {kind}, {arrays}").withColumn("_row", F.monotonically_increasing_id()))
    met = read.select("_row", F.explode(F.arrays_zip("tokens", "places")).alias("h")).select(
        "_row", F.col("h.tokens").alias("token"), F.col("h.places").alias("at")
    )
    hit = met.join(prefix, "token").select("_row", "_pid", "n", (F.col("at") - F.col("place")).alias("begin"))
    allowed = F.floor((1 - share) * F.col("n") + 1e-9)
    order = Window.partitionBy("_row", "_pid").orderBy("begin")
    far = F.lit(1 << 40)
    before, after = (F.coalesce(f("begin").over(order), far) for f in (F.lag, F.lead))
    placed = hit.withColumn("_b", F.abs(F.col("begin") - before)).withColumn("_a", F.abs(after - F.col("begin")))
    pairs = placed.where((F.least("_b", "_a") <= allowed) & (F.col("_b") > 0)).select("_row", "_pid", "begin")
    edits = F.floor((1 - share) * F.size("p_words") + 1e-9).cast("int")
    lo = F.greatest(F.col("begin") - edits, F.lit(0))
    hi = F.least(F.col("begin") + F.size("p_words") + edits, F.size("words"))
    asked = (
        pairs.join(passages.select("_pid", "_item", F.col("words").alias("p_words")), "_pid")
        .join(read.select("_row", "_key", "words"), "_row")
        .where(F.size("words") >= F.size("p_words") - edits)
        .select("_key", "_item", "p_words", F.slice("words", lo + 1, F.greatest(hi - lo, F.lit(0))).alias("window"))
    )

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, window = batch.column(2), batch.column(3)
            n, m = (np.asarray(pc.list_value_length(c)) for c in (own, window))
            kept = np.zeros(batch.num_rows, bool)
            for size in np.unique(n):
                k, who = int(edits_of(size, share)), np.flatnonzero(n == size)
                padded = np.zeros((len(who), size + 2 * k), np.int64)
                padded[np.arange(size + 2 * k) < m[who][:, None]] = np.asarray(pc.list_flatten(window.take(pa.array(who))))
                passage = np.asarray(pc.list_flatten(own.take(pa.array(who)))).reshape(len(who), size)
                kept[who] = within_edits(passage, padded, k)
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(kept)) for c in batch.columns[:2]], names=["_key", "_item"])

    return asked.mapInArrow(check, f"_key {kind}, _item {item_kind}")
