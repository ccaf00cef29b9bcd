"""Percentiles with a guaranteed relative error, from counts in logarithmic buckets.

A value x other than 0 falls into the bucket ``ceil(ln|x| / ln g)`` of its sign, where
``g = (1 + a) / (1 - a)``; the middle of a bucket is within the share ``a`` of each of its
values. A sketch is a table of bucket counts, so sketches of partitions, days or models
are combined by adding the counts of equal buckets, exactly and in any order. Counting is
combined map-side: a group sends at most one row per bucket and task, and the number of
buckets is bounded by the range of doubles, however many values there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.runtime import delivered_once

ACCURACY = 0.01


def gamma(accuracy: float) -> float:
    return (1 + accuracy) / (1 - accuracy)


def sign_of(x: Column) -> Column:
    """-1, 0 or 1; null for null, NaN and infinite values."""
    usable = x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.when(usable, F.signum(x).cast("int"))


def bucket_of(x: Column, accuracy: float) -> Column:
    """The bucket within the sign; 0 for the value 0."""
    return F.when(x == 0, 0).otherwise(F.ceil(F.log(F.abs(x)) / F.lit(math.log(gamma(accuracy)))).cast("int"))


def sketch(rows: DataFrame, keys: Sequence[str], fields: Sequence[str], accuracy: float = ACCURACY) -> DataFrame:
    """``*keys, field, sign, bucket, n``: bucket counts of each field in each group.

    Values that are null, NaN or infinite are counted in a row of null sign and bucket, so
    that none is lost; null keys are groups of their own. Every row counts: drop repeated
    deliveries first. An empty table gives an empty sketch. Columns of ``rows`` other than
    keys and fields are ignored, even ones named like the sketch's.
    """
    long = rows.select(
        *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)],
        F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("double").alias("x")) for f in fields])),
    )
    sign = sign_of(F.col("x"))
    counted = (
        long.withColumn("sign", sign)
        .withColumn("bucket", F.when(F.col("sign").isNotNull(), bucket_of(F.col("x"), accuracy)))
        .groupBy(*[f"_k{i}" for i in range(len(keys))], "field", "sign", "bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    return counted.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keys)], "field", "sign", "bucket", "n")


def combined(sketches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One sketch per group of ``keys``: equal buckets added up over all other keys."""
    return sketches.groupBy(*keys, "field", "sign", "bucket").agg(F.sum("n").alias("n"))


def percentiles(
    sketches: DataFrame, keys: Sequence[str], shares: Sequence[float], accuracy: float = ACCURACY
) -> DataFrame:
    """``*keys, field, share, value, n``: the value at each share of each group's sketch.

    The value at share q is that of rank ``floor(1 + q (n - 1))`` in ascending order; what
    is returned differs from it by at most ``accuracy`` of its size. ``n`` is the number of
    usable values; groups without any have no row. Values below the smallest normal double
    (about 2e-308) may miss the bound.
    """
    g = gamma(accuracy)
    order = F.col("sign") * 10_000_000 + F.col("sign") * F.col("bucket")
    group = Window.partitionBy(*keys, "field")  # rows are buckets, whose number is bounded
    upto = group.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (
        combined(sketches.where(F.col("sign").isNotNull()), keys)
        .withColumn("_upto", F.sum("n").over(upto))
        .withColumn("_total", F.sum("n").over(group))
        .withColumn("share", F.explode(F.array(*[F.lit(float(q)) for q in shares])))
        .withColumn("_rank", F.floor(F.lit(1) + F.col("share") * (F.col("_total") - 1)))
    )
    value = F.col("sign") * F.pow(F.lit(g), F.col("bucket")) * F.lit(2 / (1 + g))
    return placed.where((F.col("_upto") - F.col("n") < F.col("_rank")) & (F.col("_rank") <= F.col("_upto"))).select(
        *keys, "field", "share", value.alias("value"), F.col("_total").alias("n")
    )


def once(rows: DataFrame, key: str, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """The rows without repeated deliveries, told by ``key`` and all columns used; null keys all stay."""
    return delivered_once(rows.select(key, *keys, *fields), key)
