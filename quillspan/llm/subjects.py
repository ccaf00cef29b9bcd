"""Subject areas of documents, from labelling functions and an accuracy-learning latent model.

A lexicon per language is learned from a bounded sample of hand-labelled documents: each of
their sentences belongs to one of the document's subjects or to none, and which one is
estimated together with the words of each subject by expectation-maximization. The languages
are learned from the same sample. Over all documents, labelling functions then vote on every
subject: the lexicon (the share of sentences that belong to the subject, in bands), the
section (its opening sentence), addresses in the text, and the source (how common the
subject is in it). The latent model of ``labelling`` learns their accuracies from the vote
patterns of the whole corpus and the labels of the sample, and documents get the subjects
whose posterior exceeds the cutoff: nothing else decides.

Texts are read once for the lexicon's sample and once for the votes, and never shuffled.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.llm.labelling import fit
from quillspan.llm.language import Languages, learned as learned_languages
from quillspan.llm.leakage import FOLD, JOINERS, Numbers
from quillspan.runtime import cut

TOKEN = re.compile(r"[^\W_]+|[.!?](?=\s)|\n")
ADDRESS = re.compile(r"\S+@\S+|\w+://\S+|www\.\S+")
NONE_BONUS = 1.0
#: How far a hand label is trusted.
RIGHT = 0.98
FUNCTIONS = ("lexicon", "section", "address", "source")
#: Where the model starts from, by the lexicon's vote of 0 to 2 and -4 to -1.
START = np.array([0.1, 0.95, 0.95, 0.02, 0.02, 0.1, 0.3])
#: From how many times the wanted share on a share is clear.
CLEAR = 1.5


def tokens_of(text: str) -> list[str]:
    """Words in lower case and folded, and the marks that end a sentence."""
    text = text.lower()
    if not text.isascii():
        text = unicodedata.normalize("NFC", JOINERS.sub("", text))
    return TOKEN.findall(text)


def sentences_of(text: str) -> list[list[str]]:
    """The words of each sentence that has any, numbers left out."""
    out, current = [], []
    for w in [*tokens_of(text), "\n"]:
        if w in ".!?\n":
            if current:
                out.append(current)
            current = []
        elif not w[0].isdigit():
            current.append(w if w.isascii() else w.translate(FOLD))
    return out


def learn(texts: list[list[list[str]]], labels: list[set[int]], subjects: int, rounds: int = 15) -> dict[str, np.ndarray]:
    """Log weights of each word for every subject and, last, for none.

    ``texts`` are documents as sentences as words, ``labels`` their subjects. A sentence
    may belong to the document's subjects, to none or, at odds of one in a thousand, to
    another (wrong labels, passing mentions). Words of one sentence only are left out.
    """
    held = Counter(w for t in texts for s in t for w in set(s))
    vocabulary = {w: i for i, w in enumerate(sorted(w for w, n in held.items() if n >= 2))}
    size, classes = len(vocabulary), subjects + 1
    row, column, owner = [], [], []
    for d, text in enumerate(texts):
        for sentence in text:
            own = {vocabulary[w] for w in sentence if w in vocabulary}
            row += [len(owner)] * len(own)
            column += own
            owner.append(d)
    if not row:
        return {}
    row, column, owner = np.array(row), np.array(column), np.array(owner)
    of_doc = np.zeros((len(texts), classes))
    for d, own in enumerate(labels):
        of_doc[d, list(own)] = 1
    allowed = np.maximum(of_doc[owner], 1e-3)
    allowed[:, -1] = 0.5
    # start: how much more often documents with the word have the subject than documents at large
    seen = np.unique(np.stack([owner[row], column]), axis=1)
    base = np.maximum(of_doc.mean(axis=0), 1e-9)
    has = np.stack([np.bincount(seen[1], of_doc[seen[0], c], minlength=size) for c in range(classes)], axis=1)
    lift = (has + 2 * base) / (np.bincount(seen[1], minlength=size) + 2)[:, None] / base
    weight = np.log(np.maximum(lift, 0.3))
    weight[:, -1] = 0
    for _ in range(rounds):
        score = np.stack([np.bincount(row, weight[column, c], minlength=len(owner)) for c in range(classes)], axis=1)
        score += np.log(allowed)
        post = np.exp(score - score.max(axis=1, keepdims=True))
        post /= post.sum(axis=1, keepdims=True)
        count = np.stack([np.bincount(column, post[row, c], minlength=size) for c in range(classes)], axis=1)
        rate = count.sum(axis=1) / len(owner)
        weight = np.log((count + rate[:, None]) / (post.sum(axis=0) + 1)) - np.log(rate)[:, None]
    return {w: weight[i] for w, i in vocabulary.items()}


def lexicon(
    documents: DataFrame, chosen: DataFrame, areas: DataFrame, names: list[str], key: str, text: str, lang: str
) -> tuple[DataFrame, Languages]:
    """``lang, word, weights`` learned from the sample of labelled documents and the descriptions,
    and the languages of the sample."""
    place = {n: i for i, n in enumerate(names)}
    rows = documents.select(F.col(key).alias("_id"), F.col(text).alias("text"), F.col(lang).alias("given"))
    taught = cut(rows.join(F.broadcast(chosen), "_id").select("text", "given", "subjects"))
    languages = learned_languages(taught, F.col("text"), F.col("given"))
    described = areas.select(
        F.concat_ws(". ", "title", "description").alias("text"), F.lit(None).cast("string").alias("given"), F.array("subject").alias("subjects")
    )

    def spoken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            langs = [languages.of({w for s in sentences_of(t or "") for w in s}, g) for t, g in zip(batch["text"], batch["given"])]
            yield batch.assign(lang=langs)[["lang", "text", "subjects"]]

    def teach(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = [sentences_of(t or "") for t in pdf["text"]]
        learned = learn(texts, [{place[s] for s in own} for own in pdf["subjects"]], len(names))
        learned = learned or {"\0": np.zeros(len(names) + 1)}  # a word that no text has
        rows = [(pdf["lang"].iloc[0], w, x.tolist()) for w, x in learned.items()]
        return pd.DataFrame(rows, columns=["lang", "word", "weights"])

    every = taught.unionByName(described).mapInPandas(spoken, "lang string, text string, subjects array<string>")
    # one group a language, of at most the sample
    return every.groupBy("lang").applyInPandas(teach, "lang string, word string, weights array<double>"), languages


class Reader:
    """The lexicons of all languages as one table of weights, to read many texts at once."""

    def __init__(self, rows: list, subjects: int, languages: Languages):
        words = sorted({r["word"] for r in rows})
        self.vocabulary = {w: i for i, w in enumerate(words)}
        self.subjects = subjects
        self.languages = languages.names or sorted({r["lang"] for r in rows}) or [""]
        self.weight = np.zeros((len(self.languages), len(words) + 1, subjects + 1), np.float32)
        for r in rows:
            if r["lang"] in self.languages:
                self.weight[self.languages.index(r["lang"]), self.vocabulary[r["word"]]] = r["weights"]
        self.speech = np.zeros((len(self.languages), len(words) + 1), np.float32)
        if languages.names:
            for w, i in self.vocabulary.items():
                self.speech[:, i] = languages.of_word(w)

    def numbers(self) -> Numbers:
        marks = {".": -2, "!": -2, "?": -2, "\n": -2}
        numbers = Numbers({**self.vocabulary, **marks})
        return numbers

    def read(self, texts: list[str | None], given: list[str | None], numbers: Numbers):
        """For each text: sentences of each subject (last: of none), the opening's subject, the address's.

        The latter two are -1 where there is none.
        """
        n, classes = len(texts), self.subjects + 1
        ids, ends = [], []
        for t in texts:
            if t:
                ids.extend([numbers[w] for w in tokens_of(t)])
            ids.append(-2)
            ends.append(len(ids))
        word = np.array(ids)
        doc = np.repeat(np.arange(n), np.diff(ends, prepend=0))
        known = np.where(word >= 0, word, self.weight.shape[1] - 1)
        said = np.stack([np.bincount(doc, x[known], minlength=n) for x in self.speech], axis=1)
        lang = said.argmax(axis=1)
        for i in np.flatnonzero(~said.any(axis=1)):  # no word that the sample has
            own = (given[i] or "").strip().lower()
            lang[i] = self.languages.index(own) if own in self.languages else 0
        sentence = np.concatenate([[0], np.cumsum(word == -2)[:-1]])
        total = int(sentence[-1]) + 1
        length = np.bincount(sentence, word >= -1, minlength=total)
        at = np.flatnonzero(word >= 0)
        score = np.zeros((total, classes), np.float32)
        weights = self.weight[lang[doc[at]], word[at]]
        for c in range(classes):
            score[:, c] = np.bincount(sentence[at], weights[:, c], minlength=total)
        score[:, -1] += NONE_BONUS
        topic = score.argmax(axis=1)
        owner = np.zeros(total, int)
        owner[sentence] = doc
        full = np.flatnonzero(length > 0)
        counts = np.bincount(owner[full] * classes + topic[full], minlength=n * classes).reshape(n, classes)
        opening = np.full(n, -1)
        opening[owner[full[::-1]]] = topic[full[::-1]]
        opening[opening == self.subjects] = -1
        address = np.full(n, -1)
        for i, t in enumerate(texts):
            if t and ("@" in t or "://" in t or "www." in t):
                found = [numbers[w] for a in ADDRESS.findall(t) for w in tokens_of(a)]
                own = self.weight[lang[i], [w for w in found if w >= 0]].sum(axis=0)
                if own[:-1].max(initial=0) > 2:
                    address[i] = int(own[:-1].argmax())
        return counts, opening, address


def subjects_of(
    documents: DataFrame,
    areas: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    source: str = "source",
    share: float = 0.2,
    cutoff: float | None = None,
    sample: int = 20_000,
) -> DataFrame:
    """``key, subject, posterior, sentence_share``: each document with its subjects.

    ``areas`` has subject, title and description, ``labels`` doc_id and subject. The
    lexicon votes by the share of the document's sentences that belong to a subject, all of
    them counted, in bands around ``share``, with a single sentence apart from several; what
    each band is worth is learned like everything else.
    ``cutoff`` is, if it is not given, the one between 0.3 and 0.5 under which the
    subjects of the sample's documents agree best with their labels (by F1). ``sample`` bounds the labelled documents that the lexicon is learned from (the first
    by hash); everything else covers all documents. Null, empty and very short texts have
    no subject and no row; texts are read whole. Repeated rows of ``documents`` come out
    repeatedly. Without labels the descriptions alone teach the lexicon; empty tables give
    an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    names = sorted(r["subject"] for r in areas.select("subject").where("subject is not null").distinct().collect())
    if not names:
        shape = "subject string, posterior double, sentence_share double"
        return spark.createDataFrame([], f"{key} {documents.schema[key].dataType.simpleString()}, {shape}")
    own = labels.where(F.col("subject").isin(*names)).groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_set("subject").alias("subjects")  # as many as there are subject areas
    )
    chosen = cut(own.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    learned, languages = lexicon(documents, chosen, areas, names, key, text, lang)
    sent = spark.sparkContext.broadcast(Reader(learned.collect(), len(names), languages))  # bounded by the sample
    k = len(names)
    kind, source_kind = (documents.schema[c].dataType.simpleString() for c in (key, source))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader, numbers = sent.value, None
        for batch in batches:
            numbers = numbers if numbers is not None else reader.numbers()
            for lo in range(0, len(batch), 1000):
                part = batch.iloc[lo : lo + 1000]
                counts, opening, address = reader.read(part["_text"].tolist(), part["_lang"].tolist(), numbers)
                yield pd.DataFrame(
                    {"_key": part["_key"].to_numpy(), "_source": part["_source"].to_numpy(), "n": counts.sum(axis=1).astype("int32"),
                     "counts": list(counts[:, :k].astype("int32")), "opening": opening.astype("int32"), "address": address.astype("int32")}
                )

    rows = documents.select(
        F.col(key).alias("_key"), F.col(source).alias("_source"), F.col(lang).alias("_lang"), F.col(text).alias("_text")
    ).mapInPandas(run, f"_key {kind}, _source {source_kind}, n int, counts array<int>, opening int, address int")
    read = cut(rows.where("n > 0"))

    def of(place: int) -> Column:
        return F.get("counts", F.lit(place))

    def lexical(count: Column, n: Column) -> Column:
        return count >= share * n

    per_source = read.groupBy("_source").agg(
        F.array(*[F.avg(lexical(of(i), F.col("n")).cast("double")) for i in range(k)]).alias("usual")
    )
    overall = read.agg(*[F.avg(lexical(of(i), F.col("n")).cast("double")).alias(f"s{i}") for i in range(k)]).first()
    mean = F.array(*[F.lit(float(overall[i] or 0.0)) for i in range(k)])
    joined = read.join(per_source, read["_source"].eqNullSafe(per_source["_source"]), "left").drop(per_source["_source"])

    def band(count: Column, n: Column) -> Column:
        """The lexicon's vote: the share in bands, where a single sentence is a passing mention."""
        return (
            F.when(count >= CLEAR * share * n, 2).when(lexical(count, n) & (count > 1), 1)
            .when(lexical(count, n), -1).when(count > 1, -2).when(count == 1, -3).otherwise(-4)
        )

    def vote(picked: Column, i: int) -> Column:
        return F.when(picked < 0, 0).when(picked == i, 1).otherwise(-1)

    votes = F.array(
        *[
            F.struct(
                F.lit(i).alias("place"),
                F.array(
                    band(of(i), F.col("n")),
                    # an opening that is the subject's only sentence says no more than the lexicon does
                    F.when((F.col("opening") == i) & (of(i) == 1), 0).otherwise(vote(F.col("opening"), i)),
                    vote(F.col("address"), i),
                    F.when(F.get("usual", F.lit(i)) > 2 * F.get(mean, F.lit(i)), 1)
                    .when(F.get("usual", F.lit(i)) < F.get(mean, F.lit(i)) / 2, -1)
                    .otherwise(0),
                ).alias("votes"),
                (of(i) / F.col("n")).alias("sentence_share"),
                F.array_contains("subjects", names[i]).alias("labelled"),
            )
            for i in range(k)
        ]
    )
    # documents of the sample teach the accuracies with their labels, all others without
    voted = joined.join(F.broadcast(chosen), F.col("_key") == F.col("_id"), "left").select("_key", F.inline(votes))
    patterns = voted.groupBy("place", "votes", "labelled").agg(F.count("*").alias("n")).collect()  # 6 * 3 ** 3 a subject at most, for each kind of label
    table, judged = [], []
    for i in range(k):
        own = [r for r in patterns if r["place"] == i]
        if own:
            matrix = np.array([r["votes"] for r in own])
            with_, without = (sum(r["n"] for r in own if r["labelled"] is x) for x in (True, False))
            # a label is missing as often as one is wrong
            missing = min(0.5, (1 - RIGHT) * with_ / max(without, 1))
            taught = np.array([{None: np.nan, True: RIGHT, False: missing}[r["labelled"]] for r in own])
            model = fit(matrix, np.array([r["n"] for r in own]), START[matrix[:, 0]], known=taught)
            posterior = model.posterior(matrix).tolist()
            judged += [(p, r["n"], r["labelled"]) for r, p in zip(own, posterior) if r["labelled"] is not None]
            table += {(i, names[i], tuple(r["votes"]), p) for r, p in zip(own, posterior)}
    limit = validated(judged) if cutoff is None else cutoff
    table = [(i, name, list(v), p) for i, name, v, p in table if p > limit]
    known = spark.createDataFrame(table, "place int, subject string, votes array<int>, posterior double")
    return voted.join(F.broadcast(known), ["place", "votes"]).select(
        F.col("_key").alias(key), "subject", F.round("posterior", 6).alias("posterior"), "sentence_share"
    )


def validated(judged: list[tuple[float, int, bool]], low: float = 0.3, high: float = 0.5) -> float:
    """The cutoff between ``low`` and ``high`` of greatest F1 over (posterior, count, label); of equal
    ones, and without labels, the highest."""
    wanted = sum(n for _, n, label in judged if label)
    best, limit = -1.0, high
    for c in sorted({high, low, *(p for p, _, _ in judged if low < p < high)}, reverse=True):
        taken = [(n, label) for p, n, label in judged if p > c]
        f1 = 2 * sum(n for n, label in taken if label) / max(1, sum(n for n, _ in taken) + wanted)
        if f1 > best:
            best, limit = f1, c
    return limit


def composition(found: DataFrame, documents: DataFrame, key: str = "doc_id") -> DataFrame:
    """``subject, documents, share``: how many documents, and what part of all, have each subject."""
    total = documents.count()
    return found.groupBy("subject").agg(F.countDistinct(key).alias("documents")).withColumn(
        "share", F.col("documents") / F.lit(max(total, 1))
    )
