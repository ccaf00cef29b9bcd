"""Languages told apart by character n-grams, learned from the tags of a collection.

A language is a tag that enough texts carry; which letters follow each other in it is
counted over the words of those texts. Wrong tags are few among many and only blur the
counts. A text is in the language under which its words are most likely, whatever its own
tag says. Nothing is known beforehand, no language and no word of one.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = re.compile(r"[^\W\d_]+")
WIDTH = 3


def grams_of(word: str) -> list[str]:
    """The runs of three characters in a word, with a blank at both ends."""
    padded = f" {word} "
    return [padded[i : i + WIDTH] for i in range(len(padded) - WIDTH + 1)]


@dataclass
class Languages:
    """Log probabilities of each n-gram in every language, and of one that was never seen."""

    names: list[str]
    weights: dict[str, np.ndarray]
    unseen: np.ndarray
    known: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def learn(cls, counts: Iterable[tuple[str, str, int]], texts: dict[str, int], least_share: float = 0.01, least: int = 3) -> Languages:
        """``counts`` are tag, n-gram and occurrences, ``texts`` how many texts carry each tag."""
        total = sum(texts.values())
        names = sorted(t for t, n in texts.items() if n >= least and n >= least_share * total)
        place = {t: i for i, t in enumerate(names)}
        table: dict[str, np.ndarray] = {}
        for tag, gram, n in counts:
            if tag in place:
                table.setdefault(gram, np.zeros(len(names)))[place[tag]] += n
        size = sum(table.values(), np.zeros(len(names))) + 0.5 * (len(table) + 1)
        unseen = np.log(0.5 / size)
        return cls(names, {g: np.log((x + 0.5) / size) for g, x in table.items()}, unseen)

    def of_word(self, word: str) -> np.ndarray:
        """The word's log probability in every language."""
        if len(self.known) > 500_000:
            self.known.clear()
        found = self.known.get(word)
        if found is None:
            found = self.known[word] = sum((self.weights.get(g, self.unseen) for g in grams_of(word)), np.zeros(len(self.names)))
        return found

    def scores(self, words: Iterable[str]) -> np.ndarray:
        """The words' log probability in every language, each distinct word once."""
        return sum((self.of_word(w) for w in set(words)), np.zeros(len(self.names)))

    def of(self, words: Iterable[str], given: str | None = None) -> str:
        """The language of words in lower case; of none at all the one given, if it is known."""
        words = set(words)
        if words and self.names:
            return self.names[int(self.scores(words).argmax())]
        tag = (given or "").strip().lower()
        return tag if tag in self.names or not self.names else self.names[0]


class Speech(dict):
    """Words to rows of a growing table of their log probabilities, for many texts at once."""

    def __init__(self, languages: Languages, remembered: int = 500_000):
        super().__init__()
        self.languages, self.remembered = languages, remembered
        self.rows: list[np.ndarray] = []

    def __missing__(self, word: str) -> int:
        self[word] = number = len(self.rows)
        self.rows.append(self.languages.of_word(word))
        return number

    def scores(self, texts: list[list[str]]) -> np.ndarray:
        """The log probability of each text's words in every language, a row a text."""
        if len(self.rows) > self.remembered:
            self.clear()
            self.rows = []
        ids = [self[w] for words in texts for w in words]
        out = np.zeros((len(texts), len(self.languages.names)))
        if ids:
            owner = np.repeat(np.arange(len(texts)), [len(words) for words in texts])
            table = np.stack(self.rows)[ids]
            for i in range(out.shape[1]):
                out[:, i] = np.bincount(owner, table[:, i], minlength=len(texts))
        return out


def learned(texts: DataFrame, text: Column, tag: Column, least_share: float = 0.01) -> Languages:
    """The languages of a table of tagged texts, from counts that Spark adds up.

    What comes to the driver is one row per tag and n-gram, bounded by the alphabets.
    """
    rows = texts.select(text.alias("_text"), F.lower(F.trim(tag)).alias("_tag")).where("_text is not null and _tag <> ''")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words: dict[str, Counter] = {}
        texts: Counter = Counter()
        for batch in batches:
            for body, own in batch.itertuples(index=False):
                words.setdefault(own, Counter()).update(WORD.findall(body.lower()))
                texts[own] += 1
        for own, counts in words.items():
            grams: Counter = Counter({"": texts[own]})  # the texts themselves
            for word, n in counts.items():
                for gram in grams_of(word):
                    grams[gram] += n
            yield pd.DataFrame({"tag": own, "gram": list(grams), "n": list(grams.values())})

    summed = rows.mapInPandas(run, "tag string, gram string, n bigint").groupBy("tag", "gram").agg(F.sum("n").alias("n")).collect()
    counts = [(r["tag"], r["gram"], r["n"]) for r in summed if r["gram"]]
    return Languages.learn(sorted(counts), {r["tag"]: r["n"] for r in summed if not r["gram"]}, least_share)
