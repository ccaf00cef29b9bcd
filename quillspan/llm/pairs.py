"""Defective prompt and response pairs, from noisy labelling functions and a label model.

For each defect several labelling functions look at a pair from different sides; the model
of ``labelling`` learns how far each can be trusted and gives every pair a posterior for
every defect. A pair keeps all defects whose posterior exceeds their cutoff.

What the functions need to know they learn from the collection itself. Whether a text breaks
off within a sentence: sentences are reduced to their frame (values, names, numbers and
quotations left out), and a last sentence without its full stop is whole if its frame has
one elsewhere at least as often. How refusals are worded: by the contrast of answers without
values in which a first person declines and those in which none does. What a language looks
like: by the character n-grams of abstracts and answers under the tags of the abstracts, and
by how unlike the others an answer is.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.llm.labelling import fit_on
from quillspan.llm.language import WORD as SPOKEN, Languages, Speech, learned
from quillspan.operators.lookups import small
from quillspan.plans.answers_queries import KNOWN_FIELDS
from quillspan.runtime import cut, delivered_once

DEFECTS = ("empty", "refusal", "copy", "truncated", "language")
CUTOFFS = {"empty": 0.5, "refusal": 0.5, "copy": 0.5, "truncated": 0.5, "language": 0.5}
#: Functions that see different signs of a defect, each enough by itself, by place.
ALTERNATIVE = {"truncated": (0, 2, 3)}
#: The fields that questions ask for, as they are written there.
FIELDS = tuple(f.replace("_", " ") for f in KNOWN_FIELDS)
#: Log odds from which a language is told from another, and n-grams from which an answer can be unlike others.
TOLD, ENOUGH = 4.0, 30
#: Deviations from the usual likeness beyond which an answer is in another language.
UNLIKE = 6.0

# A first person who will not or cannot, in four languages.
DECLINES = re.compile(
    r"\b(?:i (?:can ?not|can'?t|won'?t|will not|am not able|am unable|must decline|do not feel comfortable|refuse)|"
    r"i'?m (?:not able|unable)|"
    r"(?:kann|darf|möchte|werde) ich\b.{0,60}\bnicht|ich (?:kann|darf|möchte|werde|muss)\b.{0,60}\b(?:nicht|ablehnen)|"
    r"je (?:ne peux|ne suis|ne souhaite|dois refuser|refuse)|il m'est impossible|"
    r"(?:no puedo|no me es posible|debo negarme|me niego|no quiero|no debo))"
)
# How such answers open.
OPENINGS = re.compile(
    r"\b(?:sorry|unfortunately|regrettably|i apologi[sz]e|as an ai|"
    r"leider|es tut mir leid|entschuldig|désolé|malheureusement|je regrette|lamentablemente|lo siento|por desgracia|disculp)"
)
# Words that stand around an answer and say nothing.
WRAPPING = frozenset("sure here is the json result answer output end of".split())
QUOTED = re.compile(r"“[^”]*”?|„[^“”]*[“”]?|«[^»]*»?|‘[^’]*’")
ENDED = re.compile(r"[.!?。…][\"'”»)\]]*\s*$")
SENTENCE = re.compile(r"(?<=[.!?])\s+")
LABEL = re.compile(r"(?:^|\n|(?<=\. ))([a-z][a-z _]{2,40}): (.*?)\.(?= )", re.S)
WORD = re.compile(r"[^\W_]+")


def repaired(content: str) -> tuple[str, object]:
    """``("json", value)``, ``("broken", None)`` or ``("prose", None)``: fences, text around
    the object and trailing commas are repaired first."""
    text = content.strip()
    text = re.sub(r"^```\w*\s*|\s*```$", "", text)
    for part in (text, text[text.find("{") : text.rfind("}") + 1] if "{" in text else ""):
        if part:
            try:
                return "json", json.loads(re.sub(r",\s*([}\]])", r"\1", part), strict=False)
            except ValueError:
                continue
    return ("broken", None) if re.search(r"[\[{]\s*[\"{\[]", text) or text[:1] in "{[" else ("prose", None)


def strings_of(value: object) -> list[str]:
    if isinstance(value, str):
        return [value]
    if isinstance(value, dict):
        return [s for v in value.values() for s in strings_of(v)]
    if isinstance(value, list):
        return [s for v in value for s in strings_of(v)]
    return [] if value is None or isinstance(value, bool) else [str(value)]


def parts_of(content: str) -> tuple[str, list[str], list[str], list[list[str]]]:
    """State, value texts, reasoning texts, and the values that go with each reasoning."""
    state, value = repaired(content)
    if state == "json" and isinstance(value, dict):
        values, reasons, beside = [], [], []
        for payload in value.values():
            if isinstance(payload, dict):
                own = strings_of(payload.get("values"))
                why = " ".join(strings_of({k: v for k, v in payload.items() if k != "values"}))
            else:
                own, why = [], " ".join(strings_of(payload))
            values += own
            reasons.append(why)
            beside.append(own)
        around = re.sub(r"```\w*", "", content)
        lead = around[: around.find("{")] if "{" in around else ""
        if len(lead.split()) > 4:
            reasons.insert(0, lead)
            beside.insert(0, [])
        return state, values, reasons, beside
    if state == "json":
        return state, [], strings_of(value), [[] for _ in strings_of(value)]
    if state == "broken":
        found = [_unescaped(x) for x in re.findall(r'"reasoning"\s*:\s*"((?:[^"\\]|\\.)*)', content)]
        lists = re.findall(r'"values"\s*:\s*\[([^\]]*)', content)
        values = [_unescaped(x) for part in lists for x in re.findall(r'"((?:[^"\\]|\\.)*)"', part)]
        return state, values, found, [values for _ in found]
    shown = [v.strip() for _, own in LABEL.findall(content) for v in own.split(",")]
    named = [v for v in shown if v and v != "–"]
    return state, named, [content], [named]


def _unescaped(text: str) -> str:
    try:
        return json.loads(f'"{text}"', strict=False)
    except ValueError:
        return text


def masked(text: str, values: list[str]) -> str:
    """The text with quotations as ``§`` and the values it speaks of as ``¤``."""
    text = QUOTED.sub("§", text)
    low = text.lower()
    if len(low) != len(text):  # letters whose small form is longer
        low = text
    spans: list[tuple[int, int]] = []
    for form in sorted({form.lower() for v in values for form in (v.strip(), v.strip(" .")) if form}, key=len, reverse=True):
        at = low.find(form)
        while at >= 0:
            end = at + len(form)
            free = not (at and _in_word(low[at - 1])) and not (end < len(low) and _in_word(low[end]))
            if free and all(end <= lo or hi <= at for lo, hi in spans):
                spans.append((at, end))
            at = low.find(form, end if free else at + 1)
    for lo, hi in sorted(spans, reverse=True):
        text = text[:lo] + "¤" + text[hi:]
    return re.sub(r"¤(?:,? (?:and|und|et|y) ¤|, ?¤)*", "¤", text)


def _in_word(c: str) -> bool:
    return c.isalnum() or c == "_"


def frame(sentence: str) -> str:
    """A masked sentence without its numbers and names."""
    s = re.sub(r"^\[[^\]]*\]\s*", "", sentence.strip()).rstrip(" .!?")
    s = re.sub(r"\d+(?:[.,]\d+)*", "0", s)
    first, _, rest = s.partition(" ")
    rest = re.sub(r"(?<!\w)[A-ZÄÖÜÉ][\w'’]*(?:[- ][A-ZÄÖÜÉ][\w'’]*)*", "¶", rest)
    return f"{first} {rest}".lower() if rest else first.lower()


def told(scores: np.ndarray) -> np.ndarray:
    """The place of the clearly most likely language in each row of log probabilities; -1 if none is."""
    if scores.shape[1] < 2:
        return np.full(len(scores), -1)
    order = np.sort(scores, axis=1)
    return np.where(order[:, -1] - order[:, -2] >= TOLD, scores.argmax(axis=1), -1)


def language_votes(rows: list[tuple[str, str, str]], speech: Speech) -> tuple[list[list[int]], list[float | None]]:
    """Votes on the language of each (question, abstract, own text), and how like the expected
    languages the text's words are: the mean log probability of an n-gram."""
    words = [[SPOKEN.findall(t.lower()) for t in texts] for texts in zip(*rows)] if rows else [[], [], []]
    asked, told_in, scores = told(speech.scores(words[0])), told(speech.scores(words[1])), speech.scores(words[2])
    spoken = told(scores)
    votes, like = [], []
    foreign = [i for i in range(len(rows)) if spoken[i] >= 0 and spoken[i] not in (asked[i], told_in[i])]
    sentences = [(i, SPOKEN.findall(x.lower())) for i in foreign for x in SENTENCE.split(rows[i][2])]
    heard: dict[int, list[int]] = {}
    for (i, _), place in zip(sentences, told(speech.scores([w for _, w in sentences]))):
        if place >= 0:
            heard.setdefault(i, []).append(int(place))
    for i in range(len(rows)):
        expected = {int(asked[i]), int(told_in[i])} - {-1}
        other = [h not in expected for h in heard.get(i, [])]
        votes.append([
            0 if spoken[i] < 0 or not expected else 1 if spoken[i] not in expected else -1,
            # sentence by sentence, where the whole is not as expected
            0 if spoken[i] < 0 or not expected else 1 if sum(other) > len(other) / 2 else -1,
            0 if asked[i] < 0 or spoken[i] < 0 else 1 if spoken[i] != asked[i] else -1,
        ])
        size = sum(map(len, words[2][i]))
        near = scores[i][sorted(expected)] if expected else scores[i]
        like.append(float(near.max()) / size if size >= ENOUGH and len(near) else None)
    return votes, like


def pairs_in(words: list[str]) -> set[tuple[str, str]]:
    return set(zip(words, words[1:]))


def votes_of(question: str, abstract: str, content: str | None) -> dict:
    """Votes for each defect but the language, the frame of an unended last sentence, the ended
    frames, the own words of an answer without values, and the text that tells its language."""
    text = content or ""
    state, values, reasons, beside = parts_of(text)
    said = " ".join(r for r in reasons if r and r.strip())
    has_value = any(re.search(r"\w|[?–-]", v) for v in values)
    has_text = bool(WORD.search(said))
    shown = [v for v in values if WORD.search(v)]

    blank = not has_value and not has_text
    bare = re.sub(r'"[^"]*"\s*:|```\w*|\b(?:null|json|true|false)\b', "", text)
    empty = [1 if blank else -1, 1 if set(WORD.findall(bare.lower())) <= WRAPPING else -1, 1 if not text.strip() else 0]

    low = re.sub(r"[’`]", "'", said.lower())
    few = not shown
    refusal = [
        1 if DECLINES.search(low) else -1,
        1 if OPENINGS.search(low) else 0,
        0 if few or state == "prose" else -1,
    ]

    answer = WORD.findall((" ".join([*values, said]) if state == "json" else text).lower())
    got = pairs_in(answer)
    asked, told = pairs_in(WORD.findall(question.lower())), pairs_in(WORD.findall(abstract.lower()))
    of_question = len(got & asked) / max(1, len(asked)) if len(asked) > 3 else 0.0
    of_abstract = len(got & told) / max(1, len(told)) if len(told) > 3 else 0.0
    own = len(got - asked - told) / max(1, len(got))
    copy = [
        1 if max(of_question, of_abstract) >= 0.5 else -1,
        1 if got and own <= 0.5 and len(got) > 3 else -1,
        1 if max(of_question, of_abstract) >= 0.75 else 0 if max(of_question, of_abstract) >= 0.3 else -1,
    ]

    ended, tail, last = [], "", len(reasons) - 1
    for i, (reason, beside_it) in enumerate(zip(reasons, beside)):
        sentences = [x for x in SENTENCE.split(masked(reason, beside_it).strip()) if x.strip()]
        for j, sentence in enumerate(sentences):
            if j < len(sentences) - 1 or ENDED.search(sentence):
                ended.append(frame(sentence))
            elif i == last and state != "broken":
                tail = frame(sentence)
    spoken_of = text.lower().replace("_", " ")
    wanted = [(at, f) for f in FIELDS if (at := question.lower().rfind(f)) >= 0]
    truncated = [
        1 if state == "broken" else 0 if not text.strip() else -1,
        0 if not wanted or not text.strip() else -1 if max(wanted)[1] in spoken_of else 1,
    ]

    free = masked(said, [v for v in values if len(v.strip()) > 3])
    # the words of an answer without values that are its own, not those of the prompt
    own_words = sorted({*WORD.findall(low)} - {*WORD.findall(question.lower())} - {*WORD.findall(abstract.lower())}) if few else []
    votes = {"empty": empty, "refusal": refusal, "copy": copy, "truncated": truncated}
    return {**votes, "tail": tail, "ended": sorted(set(ended)), "words": own_words, "free": free}


def languages_of(pairs: DataFrame, sample: int) -> Languages:
    """The languages of abstracts and answers under the tags of the abstracts, learned from
    ``sample`` pairs, the first by hash; without tags all are one language."""
    tag = F.coalesce(F.nullif(F.trim("lang"), F.lit("")), F.lit("untold"))
    chosen = pairs.select("content", "abstract", tag.alias("tag")).orderBy(F.xxhash64("content")).limit(sample)
    return learned(chosen.select(F.explode(F.array("content", "abstract")).alias("text"), "tag"), F.col("text"), F.col("tag"))


def examined(responses: DataFrame, prompts: DataFrame, sample: int) -> DataFrame:
    """``response_id``, votes by defect, ``tail``, ``ended``, ``words`` and ``like`` of each response."""
    one = delivered_once(responses.select("response_id", "abstract_id", "question", "content"), "response_id")
    tag = F.max("lang") if "lang" in prompts.columns else F.lit(None).cast("string")
    texts = prompts.groupBy(F.col("abstract_id").alias("_a")).agg(F.max("abstract").alias("abstract"), tag.alias("lang"))
    joined = cut(one.join(texts, F.col("abstract_id") == F.col("_a"), "left").select("response_id", "question", "abstract", "content", "lang"))
    languages = languages_of(joined, sample)
    names = [*DEFECTS, "tail", "ended", "words", "like"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        speech = Speech(languages)
        for batch in batches:
            texts = [(q or "", a or "", c) for q, a, c in zip(batch["question"], batch["abstract"], batch["content"])]
            seen = [votes_of(*x) for x in texts]
            votes, like = language_votes([(q, a, x["free"]) for (q, a, _), x in zip(texts, seen)], speech)
            out = pd.DataFrame({n: votes if n == "language" else like if n == "like" else [x[n] for x in seen] for n in names})
            yield out.assign(response_id=batch["response_id"].to_numpy(), like=out["like"].astype("float64"))[["response_id", *names]]

    kind = responses.schema["response_id"].dataType.simpleString()
    schema = f"response_id {kind}, " + ", ".join(f"{d} array<int>" for d in DEFECTS)
    schema += ", tail string, ended array<string>, words array<string>, like double"
    out = joined.drop("lang").mapInPandas(run, schema)
    return cut(out.withColumn("_row", F.monotonically_increasing_id()))


def whole_sentences(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``tail`` of the last sentences that are whole without a full stop, and ``start``, the hash of
    every beginning of a whole sentence.

    A frame is whole if it ends two answers' sentences with a full stop or more, and no fewer
    than it is left without one; both grow alike with the collection.
    """
    ended = rows.select(F.explode("ended").alias("frame")).groupBy("frame").agg(F.count("*").alias("ended"))
    tails = rows.where("tail <> ''").groupBy("tail").agg(F.count("*").alias("left"))
    frames = cut(ended.where("ended >= 2"))
    whole = tails.join(frames, F.col("tail") == F.col("frame")).where("ended >= left").select("tail")
    starts = frames.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("frame")), lambda i: F.xxhash64(F.substring("frame", F.lit(1), i)))).alias("start"))
    return whole, starts.distinct()


def refusal_words(rows: DataFrame) -> DataFrame:
    """``_row, worded``: whether an answer without values is worded like those that decline.

    A word's weight is the log odds of its standing in answers without values in which a
    first person declines against answers with values; a word must stand in two of the
    former, and in a hundredth of them, so there are at most a hundred times as many as an
    answer has. Answers with none of these words have no vote.
    """
    declines = (F.get("refusal", F.lit(0)) == 1) | (F.get("refusal", F.lit(1)) == 1)
    few, others = rows.where(F.size("words") > 0), rows.where(F.size("words") == 0)
    seeds = few.where(declines).select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("a"))
    sizes = rows.agg(F.count_if((F.size("words") > 0) & declines).alias("s"), F.count_if(F.size("words") == 0).alias("o")).first()
    kept = small(cut(seeds.where(F.col("a") >= max(2, 0.01 * sizes["s"]))))
    used = others.select(F.explode(F.array_distinct(F.split(F.concat_ws(" ", "ended"), r"[^\p{L}\p{N}]+"))).alias("word"))
    usual = used.join(kept.select("word"), "word", "left_semi").groupBy("word").agg(F.count("*").alias("b"))
    odds = F.log((F.col("a") + 0.5) / (sizes["s"] + 1)) - F.log((F.coalesce("b", F.lit(0)) + 0.5) / (sizes["o"] + 1))
    weights = kept.join(usual, "word", "left").select("word", odds.alias("odds"))
    long = few.select("_row", F.explode("words").alias("word"))
    summed = long.join(small(cut(weights)), "word").groupBy("_row").agg(F.sum("odds").alias("odds"))
    return summed.select("_row", F.when(F.col("odds") > 0, 1).otherwise(-1).alias("worded"))


def judged(rows: DataFrame) -> DataFrame:
    """The votes of ``examined`` with those that need the whole collection."""
    whole, starts = whole_sentences(rows)
    usual = rows.agg(F.percentile_approx("like", 0.5, 10_000).alias("m")).first()["m"]
    off = F.abs(F.col("like") - F.lit(usual).cast("double"))
    spread = rows.agg(F.percentile_approx(off, 0.5, 10_000).alias("d")).first()["d"]
    broken = F.get("truncated", F.lit(0)) == 1
    ended = (F.col("tail") == "") | F.col("_whole").isNotNull()
    unlike = F.when(F.col("like").isNull(), 0).when(F.col("like") < F.lit(usual) - UNLIKE * F.greatest(F.lit(spread), F.lit(0.02)), 1).otherwise(-1)
    return (
        rows.join(whole.select("tail", F.lit(True).alias("_whole")), "tail", "left")
        .withColumn("_start", F.when(F.col("tail") != "", F.xxhash64("tail")))
        .join(starts.select(F.col("start").alias("_start"), F.lit(True).alias("_begun")), "_start", "left")
        .join(refusal_words(rows), "_row", "left")
        .select(
            "response_id", "empty", "copy",
            F.concat("truncated", F.array(
                F.when(broken, 0).when(ended, -1).otherwise(1),
                F.when(broken, 0).when(ended, -1).when(F.col("_begun"), 1).otherwise(0),
            )).alias("truncated"),
            F.concat("refusal", F.array(F.coalesce("worded", F.when(F.size("words") == 0, -1).otherwise(0)))).alias("refusal"),
            F.concat("language", F.array(unlike)).alias("language"),
        )
    )


def defects(
    responses: DataFrame, prompts: DataFrame, cutoffs: dict[str, float] | None = None, sample: int = 5_000
) -> DataFrame:
    """``response_id, defects, posteriors``: every pair with all its defects, strongest first.

    ``responses`` has response_id, abstract_id, question and content, ``prompts`` has
    abstract_id, abstract and, if it is known, lang; other columns are ignored. Null and
    blank contents are empty answers; a missing question or abstract gives no vote on
    copying or language. Responses delivered more than once, unchanged, count once; those of
    null key all stay; of abstracts under one id the largest text counts. ``sample`` bounds
    the pairs that the languages are learned from. Empty tables give an empty result. Very
    long answers are judged whole.
    """
    limits = {**CUTOFFS, **(cutoffs or {})}
    voted = cut(judged(examined(responses, prompts, sample)))
    spark = responses.sparkSession
    out = voted
    for d in DEFECTS:
        _, patterns, posterior = fit_on(voted.select(d), d, alternative=ALTERNATIVE.get(d))
        found = spark.createDataFrame(
            pd.DataFrame({"_p": [list(p) for p in patterns], "_post_" + d: np.asarray(posterior, float)}),
            f"_p array<int>, _post_{d} double",
        )
        out = out.join(F.broadcast(found), F.col(d) == F.col("_p"), "left").drop("_p")  # 3 ** 4 patterns at most
    every = F.array(
        *[F.struct(F.col("_post_" + d).alias("posterior"), F.lit(-i).alias("rank"), F.lit(d).alias("defect"),
                   F.lit(limits[d]).alias("cutoff")) for i, d in enumerate(DEFECTS)]
    )
    kept = F.sort_array(F.filter(every, lambda x: x.posterior > x.cutoff), asc=False)
    return out.select(
        "response_id",
        F.transform(kept, lambda x: x.defect).alias("defects"),
        F.transform(kept, lambda x: F.round(x.posterior, 4)).alias("posteriors"),
    )


def found(labelled: DataFrame) -> DataFrame:
    """``response_id, defect``: the one defect of each defective pair.

    Defects are named in the order in which they explain each other: what is empty says
    nothing, a refusal may break off or be in another language, and so may a copy.
    """
    first = F.array(*[F.lit(d) for d in DEFECTS])
    one = F.get(F.filter(first, lambda d: F.array_contains("defects", d)), F.lit(0))
    return labelled.where(F.size("defects") > 0).select("response_id", one.alias("defect"))
