"""Vector tier of matching: best candidates, ensembles of encoders, threshold sweeps."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.vectors import AMBIGUOUS, MATCH, NO_MATCH, UNAVAILABLE, cosine, decision, rank_of
from quillspan.operators.lookups import small


class Encoder(Protocol):
    """Texts to vectors of one length; made once a task from a factory that can be sent."""

    def encode(self, texts: list[str]) -> list[list[float]]: ...


def encoded(texts: DataFrame, column: str, factory: Callable[[], Encoder]) -> DataFrame:
    """``column, vector`` for each distinct text; null vectors where the encoder fails."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = None
        for batch in batches:
            try:
                encoder = encoder or factory()
                vectors: list = list(encoder.encode(batch[column].tolist()))
            except Exception:  # an encoder that is not there makes the tier unavailable, not the job fail
                vectors = [None] * len(batch)
            yield pd.DataFrame({column: batch[column], "vector": vectors})

    distinct = texts.select(column).where(F.col(column).isNotNull()).distinct()
    return distinct.mapInPandas(run, f"{column} string, vector array<double>")


def best_candidate(pairs: DataFrame, keys: Sequence[str], score: str, pos: str, value: str) -> DataFrame:
    """``*keys, best_match, score``: the highest score, of equal ones the first position.

    Groups whose scores are all null keep a row of null score.
    """
    held = F.when(F.col(score).isNotNull(), F.struct(F.col(score).alias("s"), (-F.col(pos)).alias("p"), F.col(value).alias("v")))
    return pairs.groupBy(*keys).agg(F.max(held).alias("_b")).select(
        *keys, F.col("_b.v").alias("best_match"), F.col("_b.s").alias("score")
    )


def _units(rows: pa.Table, dims: int | None) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length, the places of the vectors that have a direction, and these as unit rows.

    Vectors that are null, have a member that is null or not finite, or are all zero have none.
    """
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    for i, v in enumerate(rows.column("vector").to_pylist()):
        if v and None not in (head := v[:dims]):
            a = np.array(head, dtype="float64")
            if np.isfinite(a).all() and (size := np.sqrt(a @ a)) > 0:
                found.setdefault(len(a), []).append((i, a / size))
    return {n: (np.array([i for i, _ in xs]), np.array([a for _, a in xs])) for n, xs in found.items()}


def nearest(
    rows: DataFrame, id: str, vector: str, encoders: Sequence[tuple[str, int | None]], block: int = 500, asked: Column | None = None
) -> DataFrame:
    """``id, encoder, place, best_match, score``: the best other vector of all, for every vector asked.

    ``asked`` is a condition on ``rows`` that says which vectors ask, all of them without it;
    what may be the answer is always every row.

    An encoder is a name and how many of the first members it uses (all for None); ``place``
    is its position. The score is the cosine clamped to 0..1, at 9 digits; of equal ones the
    smallest id is named. A vector without a direction, or without another of its length,
    keeps a row of null score.

    Ids are salted into blocks of about ``block`` rows, those that ask and all rows each by
    their own number. Each pair of blocks is one product of matrices, from which one row per
    vector and encoder leaves; the maximum over the blocks is an aggregation. Every asked
    vector meets every row, so the work grows with the product of both numbers; a row is sent
    to as many groups as there are blocks of asked vectors.
    """
    held = rows.select(
        F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"), (F.lit(True) if asked is None else asked).alias("_ask")
    )
    sizes = held.agg(F.count("*").alias("n"), F.count_if("_ask").alias("asked")).first()
    n, m = (max(1, -(-sizes[c] // block)) for c in ("n", "asked"))
    part, asking = (F.pmod(F.xxhash64("id"), F.lit(k)).cast("int") for k in (n, m))
    asked = held.where("_ask").select("id", "vector", asking.alias("_q"), F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("_c"))
    others = held.select("id", "vector", F.explode(F.sequence(F.lit(0), F.lit(m - 1))).alias("_q"), part.alias("_c"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("id")
        ids, candidates = left.column("id").to_numpy(), right.column("id").to_numpy()
        out = []
        for place, (name, dims) in enumerate(encoders):
            match, score = np.full(len(ids), -1), np.full(len(ids), np.nan)
            known = _units(right, dims)
            for size, (at, a) in _units(left, dims).items():
                if size not in known:
                    continue
                to, b = known[size]
                products = np.round(np.clip(a @ b.T, 0.0, 1.0), 9)
                products[ids[at][:, None] == candidates[to][None, :]] = -1.0  # a vector is no match of itself
                top = products.argmax(axis=1)
                best = products[np.arange(len(at)), top]
                match[at[best >= 0]], score[at[best >= 0]] = candidates[to][top[best >= 0]], best[best >= 0]
            none = np.isnan(score)
            out.append(pa.table({
                "id": ids, "encoder": pa.array([name] * len(ids), pa.string()), "place": np.full(len(ids), place, dtype="int32"),
                "match": pa.array(match, pa.int64(), mask=none), "score": pa.array(score, pa.float64(), mask=none),
            }))
        return pa.concat_tables(out)

    partial = asked.groupBy("_q", "_c").cogroup(others.groupBy("_q", "_c")).applyInArrow(
        run, "id long, encoder string, place int, match long, score double"
    )
    return best_candidate(partial, ("id", "encoder", "place"), "score", "match", "match").withColumnRenamed("id", id)


def decided(best: DataFrame, high: float = 0.85, low: float = 0.50) -> DataFrame:
    """``best`` with its decision; a clear mismatch names no match, an unavailable score reads 0."""
    verdict = decision(F.col("score"), high, low)
    return (
        best.withColumn("decision", verdict)
        .withColumn("best_match", F.when(F.col("decision").isin(MATCH, AMBIGUOUS), F.col("best_match")))
        .withColumn("score", F.coalesce("score", F.lit(0.0)))
    )


def single_threshold(best: DataFrame, threshold: float = 0.75) -> DataFrame:
    """``best`` with a yes/no match; the match is named only where the threshold is reached."""
    hit = F.coalesce(F.col("score") >= threshold, F.lit(False))
    return best.withColumn("is_match", hit).withColumn("best_match", F.when(hit, F.col("best_match")))


def ensemble(by_encoder: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``*keys, decision, best_match, score, encoder`` over the decisions of several encoders.

    Any match wins, else any open case, the best of its kind by raw score and then by
    ``order``. If all available encoders see no match, so does the ensemble, without a
    name; if some are unavailable the case stays open, at the best score. With none
    available it is unavailable at 0.
    """
    def top(kind: str) -> Column:
        entry = F.struct(F.col("score").alias("s"), (-F.col(order)).alias("o"), F.col("best_match").alias("m"), F.col("encoder").alias("e"))
        return F.max(F.when(F.col("decision") == kind, entry))

    agg = by_encoder.groupBy(*keys).agg(
        top(MATCH).alias("_m"), top(AMBIGUOUS).alias("_a"), top(NO_MATCH).alias("_n"),
        F.count_if(F.col("decision") == UNAVAILABLE).alias("_u"),
    )
    verdict = (
        F.when(F.col("_m").isNotNull(), MATCH)
        .when(F.col("_a").isNotNull(), AMBIGUOUS)
        .when(F.col("_n").isNotNull() & (F.col("_u") == 0), NO_MATCH)
        .when(F.col("_n").isNotNull(), AMBIGUOUS)
        .otherwise(UNAVAILABLE)
    )
    chosen = F.coalesce("_m", "_a", "_n")
    return agg.select(
        *keys, verdict.alias("decision"), F.coalesce("_m.m", "_a.m").alias("best_match"),
        F.coalesce(chosen.getField("s"), F.lit(0.0)).alias("score"), chosen.getField("e").alias("encoder"),
    )


def ranked(by_encoder: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """``*keys, ranking, text``: the encoders' scores, best first, as structs and as one line.

    Scores descend, nulls last; then better decisions, the lower-case name, the given order.
    """
    entry = F.struct(
        F.col("score").isNull().alias("missing"), (-F.col("score")).alias("down"), rank_of(F.col("decision")).alias("rank"),
        F.lower("encoder").alias("name"), F.col(order).alias("place"), "encoder", "decision", "score", "best_match",
    )
    gathered = by_encoder.groupBy(*keys).agg(F.array_sort(F.collect_list(entry)).alias("ranking"))  # one an encoder
    line = F.transform(
        "ranking",
        lambda x: F.concat_ws(
            ":", x.encoder, x.decision, F.when(x.score.isNull(), "n/a").otherwise(F.format_string("%.3f", x.score)), x.best_match
        ),
    )
    return gathered.select(*keys, F.transform("ranking", lambda x: x.encoder).alias("ranking"), F.array_join(line, "; ").alias("text"))


def tier_counts(decisions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """How many cases the vector tier decided, left open, or could not see, per ``keys``.

    A mismatch that a date rule turns into a match (``rescued``) is no rejection.
    """
    return decisions.groupBy(*keys).agg(
        F.count_if(F.col("decision") == MATCH).alias("auto_match"),
        F.count_if((F.col("decision") == NO_MATCH) & ~F.col("rescued")).alias("auto_reject"),
        F.count_if(F.col("decision") == AMBIGUOUS).alias("ambiguous"),
        F.count_if(F.col("decision") == UNAVAILABLE).alias("unavailable"),
    )


def sweep(pairs: DataFrame, score: str, expected: str, thresholds: Sequence[float]) -> DataFrame:
    """Confusion counts, precision, recall, f1 and accuracy at each threshold; null scores skipped.

    Pairs are scored once and read once: each row is repeated per threshold inside the
    task and combined there, so what is shuffled is one row per threshold and task.
    """
    yes, truth = F.col(score) >= F.col("threshold"), F.col(expected)
    counted = (
        pairs.where(F.col(score).isNotNull())
        .withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
        .groupBy("threshold")
        .agg(
            F.count_if(yes & truth).alias("tp"), F.count_if(yes & ~truth).alias("fp"),
            F.count_if(~yes & truth).alias("fn"), F.count_if(~yes & ~truth).alias("tn"),
        )
    )

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, a / b).otherwise(0.0)

    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return (
        counted.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
        .withColumn("accuracy", ratio(tp + tn, tp + fp + fn + tn))
    )


def best_threshold(swept: DataFrame, metric: str = "f1") -> DataFrame:
    """The row of the highest metric, of equal ones the lowest threshold."""
    best = swept.agg(F.max(F.struct(F.col(metric), -F.col("threshold"))).getField("col2").alias("_t"))
    return swept.join(F.broadcast(best), F.col("threshold") == -F.col("_t")).drop("_t")


def grid(first: float = 0.5, last: float = 0.95, step: float = 0.05) -> list[float]:
    """Thresholds ``first + i * step`` in binary floating point."""
    return [first + i * step for i in range(round((last - first) / step) + 1)]


def candidate_pairs(extracted: DataFrame, gold: DataFrame, vectors: DataFrame) -> DataFrame:
    """Long pairs of one (item, attribute) with the cosine of their vectors.

    ``vectors`` is (text, encoder, vector); values without a vector have a null score.
    """
    left = vectors.select(F.col("text").alias("value"), F.col("encoder"), F.col("vector").alias("_a"))
    right = vectors.select(F.col("text").alias("gold_value"), F.col("encoder"), F.col("vector").alias("_b"))
    pairs = extracted.select("item_id", "model", "attribute", "pos", "value").join(
        gold.select("item_id", "attribute", F.col("pos").alias("gold_pos"), F.col("value").alias("gold_value")),
        ["item_id", "attribute"],
    )
    scored = pairs.join(small(left), "value", "left").join(small(right), ["gold_value", "encoder"], "left")
    return scored.withColumn("score", cosine(F.col("_a"), F.col("_b"))).drop("_a", "_b")
