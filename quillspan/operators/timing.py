"""Rollups of durations and token counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rollup(rows: DataFrame, keys: Sequence[str], durations: Sequence[str], tokens: Sequence[str]) -> DataFrame:
    """``*keys, calls``, per duration its total, count and average, and the token sums.

    Null durations count nowhere, and a duration without values has a null total and
    average; null tokens count as 0. Durations as decimals add up to the same total in any order. One map-side combined aggregation.
    """
    measures = [F.count(F.lit(1)).alias("calls")]
    for c in durations:
        total, n = F.sum(c).cast("double"), F.count(c)
        measures += [total.alias(f"{c}_total"), n.alias(f"{c}_n"), F.when(n > 0, total / n).alias(f"{c}_avg")]
    measures += [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in tokens]
    return rows.groupBy(*keys).agg(*measures)
