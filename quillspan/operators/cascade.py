"""The tiered matcher: vectors, then a judge for open cases, then string rules.

The judge is asked only about gated rows: they are filtered first and answered in
``mapInPandas``, one request a row, so that no plan ever evaluates it for a decided case.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.dates import month_of
from quillspan.functions.vectors import AMBIGUOUS, MATCH, NO_MATCH, UNAVAILABLE
from quillspan.operators.matching import DATE_ATTRIBUTES, outcomes

KEYS = ("item_id", "model", "attribute", "pos")


class Judge(Protocol):
    """Answers a prompt with one word; raises if it cannot."""

    def judge(self, prompt: str) -> str: ...


def judge_prompt(attribute: Column, value: Column, expected: Column) -> Column:
    """What the judge is asked: a line each for the question, the attribute, the value and the
    expected ones, the latter two as JSON, so that line breaks and quotes do not disturb."""
    asked = F.lit("Two annotators read the same abstract. Do they name the same thing?")
    answer = F.lit("Answer with one word, MATCH if the first names any of the second's, otherwise NO_MATCH.")
    one = F.regexp_extract(F.to_json(F.array(value)), r"(?s)^\[(.*)\]$", 1)
    return F.concat_ws(
        "\n", asked, F.concat(F.lit("Attribute: "), attribute), F.concat(F.lit("First value: "), one),
        F.concat(F.lit("Second values: "), F.to_json(expected)), answer,
    )


def verdict(answer: str, value: str, expected: list[str]) -> str | None:
    """The expected value that the judge's answer names: the first that contains the value or
    is contained in it, else the first; none unless it says MATCH."""
    said = answer.strip().upper()
    if "MATCH" not in said or "NO_MATCH" in said:
        return None
    low = value.lower()
    return next((e for e in expected if e.lower() in low or low in e.lower()), expected[0])


def judged(open_cases: DataFrame, gold: DataFrame, factory: Callable[[], Judge]) -> DataFrame:
    """``*KEYS, matched, method``: the judge's matches; cases it fails on go on to the string rules.

    The expected values of one case are those of its own item and attribute.
    """
    expected = gold.groupBy("item_id", "attribute").agg(
        F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_g")
    )
    asked = open_cases.join(expected, ["item_id", "attribute"]).select(
        *KEYS, "value", F.transform("_g", lambda x: x.value).alias("expected")
    ).withColumn("prompt", judge_prompt(F.col("attribute"), F.col("value"), F.col("expected")))
    kinds = dict(asked.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in KEYS) + ", matched string, method string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = factory()
        for batch in batches:
            named = []
            for p, v, e in zip(batch["prompt"], batch["value"], batch["expected"]):
                try:
                    named.append(verdict(judge.judge(p), v, list(e)))
                except Exception:  # one failed request must not fail the job
                    named.append(None)
            yield batch[list(KEYS)].assign(matched=named, method="llm")

    return asked.mapInPandas(run, schema).where(F.col("matched").isNotNull())


def cascade(
    extracted: DataFrame,
    gold: DataFrame,
    attributes: DataFrame,
    vectors: DataFrame | None = None,
    judge: Callable[[], Judge] | None = None,
    low: float = 0.50,
    high: float = 0.85,
    strict_gate: bool = False,
    answered: DataFrame | None = None,
) -> DataFrame:
    """Events of ``matching.outcomes`` with the methods ``vector``, ``date_format``, ``llm``, ``string``.

    ``vectors`` are ensemble decisions per extracted value: ``*KEYS, decision, best_match,
    score``; values of date attributes take no vector decision. A mismatch is turned into a
    match if the value is the same month as the first gold value. The judge sees unmatched
    values without a score or with one strictly between the thresholds, and with
    ``strict_gate`` all open and unavailable ones. Rejected values still meet the string rules.
    ``answered`` is that of ``matching.outcomes``.
    """
    rows = extracted
    done = None
    if vectors is not None:
        seen = vectors.where(~F.col("attribute").isin(*DATE_ATTRIBUTES))
        rows = extracted.join(seen.select(*KEYS, "decision", "best_match", "score"), list(KEYS), "left")
        first = gold.groupBy("item_id", "attribute").agg(F.min(F.struct("pos", "value")).alias("_f"))
        rows = rows.join(first.select("item_id", "attribute", F.col("_f.value").alias("_first")), ["item_id", "attribute"], "left")
        rescued = (F.col("decision") == NO_MATCH) & (month_of(F.col("value")) == month_of(F.col("_first")))
        rows = rows.withColumn(
            "matched", F.when(F.col("decision") == MATCH, F.col("best_match")).when(rescued, F.col("_first"))
        ).withColumn("method", F.when(F.col("decision") == MATCH, "vector").when(rescued, "date_format"))
        done = rows.where(F.col("matched").isNotNull()).select(*KEYS, "matched", "method")
    if judge is not None:
        open_cases = rows
        if vectors is not None:
            between = F.col("score").isNull() | ((F.col("score") > low) & (F.col("score") < high))
            if strict_gate:
                between = between | F.col("decision").isin(AMBIGUOUS, UNAVAILABLE)
            open_cases = rows.where(F.col("matched").isNull() & between)
        by_judge = judged(open_cases.select(*KEYS, "value"), gold, judge)
        done = by_judge if done is None else done.unionByName(by_judge)
    return outcomes(extracted, gold, attributes, done, answered)
