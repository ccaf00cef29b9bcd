"""Label model: noisy votes to posteriors, by expectation-maximization.

Labelling functions vote for (above 0), against (below 0) or not at all (0) a latent yes/no
label; a function that sees degrees votes with several values on either side. Given the
label their votes are taken as independent; how often each function votes which way under
either label, and how common the label is, are learned without labels. Rows matter only by
their votes, so the corpus is reduced to the counts of distinct vote patterns by a map-side
combined shuffle, and the model is fitted on these. There are at most as many of them as
combinations of votes, whatever the corpus.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


#: How often a function is believed to vote yes without and with the label, before any vote
#: is seen, and the number of votes that this belief weighs.
BELIEF = (0.01, 0.7)
WEIGHT = 10


@dataclass
class LabelModel:
    """``prior`` of the label; ``rates[j][v]``: how often function j votes v, without and with the label."""

    prior: float
    rates: list[dict[int, np.ndarray]]

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Probability of the label for each row of votes; 0 where nothing voted."""
        votes = np.asarray(votes, int)
        odds = np.full(len(votes), math.log(self.prior) - math.log1p(-self.prior))
        for j, rates in enumerate(self.rates):
            for value, (without, with_) in rates.items():
                odds += np.where(votes[:, j] == value, math.log(with_) - math.log(without), 0.0)
        return np.where((votes != 0).any(axis=1), 1 / (1 + np.exp(-np.clip(odds, -500, 500))), 0.0)


def fit(
    votes: np.ndarray, counts: np.ndarray, start: np.ndarray | None = None, rounds: int = 200, known: np.ndarray | None = None
) -> LabelModel:
    """The model of vote patterns (rows of votes) that occur ``counts`` times.

    Not voting is no evidence. Starts from the share of votes in favour, or from given
    posteriors; rates are drawn towards ``BELIEF`` with some weight, and a function is held to
    vote in favour under the label at least as often as without it. ``known`` gives the
    probability of the label where it has been looked up, NaN elsewhere; such patterns keep it,
    and for the rates the others together weigh no more than they do, so that many guesses
    cannot drown what was looked up.
    """
    votes, counts = np.asarray(votes, int), np.asarray(counts, float)
    if votes.size == 0 or counts.sum() == 0:
        return LabelModel(0.5, [{} for _ in range(votes.shape[1] if votes.ndim == 2 else 0)])
    cast = (votes != 0).sum(axis=1)
    if start is None:
        start = np.where(cast > 0, (votes > 0).sum(axis=1) / np.maximum(cast, 1), 0.0)
        start = np.clip(start, 0.02, 0.98)
    counts = np.where(cast > 0, counts, 0.0)
    known = np.full(len(counts), np.nan) if known is None else np.asarray(known, float)
    post, model = np.where(np.isnan(known), start, known), None
    looked_up = counts[~np.isnan(known)].sum()
    guessed = counts.sum() - looked_up
    scale = np.where(np.isnan(known), min(1.0, looked_up / guessed) if looked_up and guessed else 1.0, 1.0)
    for _ in range(rounds):
        prior = float(np.clip((counts @ post + 1) / (counts.sum() + 2), 1e-6, 1 - 1e-6))
        weights = (counts * scale * (1 - post), counts * scale * post)
        model = LabelModel(prior, [_rates(votes[:, j], weights) for j in range(votes.shape[1])])
        new = np.where(np.isnan(known), model.posterior(votes), known)
        if np.abs(new - post).max() < 1e-6:
            break
        post = new
    return model


def _rates(votes: np.ndarray, weights: tuple[np.ndarray, np.ndarray]) -> dict[int, np.ndarray]:
    """How often one function votes which way, without and with the label."""
    values = sorted({-1, 1, *votes.tolist()} - {0})
    sides = {v: sum((u > 0) == (v > 0) for u in values) for v in values}
    rates = {v: np.empty(2) for v in values}
    for y, weight in enumerate(weights):
        total = weight[votes != 0].sum()
        for v in values:
            belief = (BELIEF[y] if v > 0 else 1 - BELIEF[y]) / sides[v]
            rates[v][y] = (weight[votes == v].sum() + belief * WEIGHT) / (total + WEIGHT)
    favour = sum(rates[v] for v in values if v > 0)
    if favour[1] < favour[0]:  # worse than no function: it says nothing
        rates = {v: np.full(2, x.mean()) for v, x in rates.items()}
    return rates


def either(votes: np.ndarray, functions: tuple[int, ...]) -> np.ndarray:
    """Starting posteriors where each of some functions sees a sign that is enough by itself."""
    return np.where((votes[:, functions] > 0).any(axis=1), 0.9, 0.05)


def fit_on(
    rows: DataFrame, votes: str, alternative: tuple[int, ...] | None = None
) -> tuple[LabelModel, list[tuple[int, ...]], np.ndarray]:
    """The model of an array column of votes, its distinct patterns and their posteriors."""
    patterns = rows.groupBy(votes).agg(F.count("*").alias("n")).collect()
    seen = sorted((tuple(r[votes]), r["n"]) for r in patterns)
    if not seen:
        return fit(np.empty((0, 0)), np.empty(0)), [], np.empty(0)
    matrix = np.array([p for p, _ in seen], int)
    start = either(matrix, alternative) if alternative else None
    model = fit(matrix, np.array([n for _, n in seen]), start)
    return model, [p for p, _ in seen], model.posterior(matrix)
