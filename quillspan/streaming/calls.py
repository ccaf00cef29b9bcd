"""Rollups of a stream of calls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.operators.timing import rollup


def windowed_rollup(
    calls: DataFrame, durations: list[str], tokens: list[str], time: str = "called_at", window: str = "1 hour", late: str = "3 days"
) -> DataFrame:
    """Duration and token rollup by model and time window; rows later than ``late`` are left out.

    Repeated deliveries of a ``call_id`` count once as long as their time is within ``late``.
    """
    timed = calls.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    once = timed.dropDuplicates(["call_id", "_t"])
    return rollup(once.withColumn("window", F.window("_t", window)), ("window", "model"), durations, tokens)
