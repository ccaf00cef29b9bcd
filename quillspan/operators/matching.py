"""Extracted against gold values: string rules, hits, misses, false positives, scores.

Everything stays behind the equi-key (item, attribute): candidates of an extracted value
are the gold values of its own attribute, and theta rules never become a global join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions.dates import month_of
from quillspan.functions.text import absent, either_contains, loose, split_values, without_annotations
from quillspan.operators.lookups import canonical
from quillspan.runtime import once

ITEM = ("item_id", "attribute")
DATE_ATTRIBUTES = ("study_dates_start", "study_dates_end")


def gold_long(gold: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """``item_id, attribute, pos, raw, stripped, value, forms`` from item_id, attribute, values.

    ``raw`` is as given, ``stripped`` without annotations, ``value`` with synonyms unified.
    """
    rows = gold.select(*ITEM, F.posexplode("values").alias("pos", "raw"))
    rows = rows.withColumn("stripped", without_annotations(F.col("raw"))).withColumn("value", F.col("stripped"))
    rows = canonical(rows, "value", synonyms) if synonyms is not None else rows
    return rows.withColumn("forms", forms(F.col("value")))


def extracted_long(cells: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """``item_id, model, attribute, pos, value, forms`` from comma-joined cells; blanks left out.

    A cell is cut at every comma, those inside a value too. Synonyms are unified first,
    then the spellings of an absent value.
    """
    rows = cells.select("item_id", "model", "attribute", F.posexplode(split_values(F.col("cell"))).alias("pos", "value"))
    rows = rows.where(F.col("value") != "")
    if synonyms is not None:
        rows = canonical(rows, "value", synonyms)
    return once(rows, "value", absent(F.col("value"))).withColumn("forms", forms(F.col("value")))


def forms(value: Column) -> Column:
    """The loose and the month form of a value, made once before values are paired."""
    return F.struct(loose(value).alias("loose"), month_of(value).alias("month"))


def string_rule(extracted: Column, expected: Column) -> Column:
    """Equal loose forms, one containing the other, or the same month; of two ``forms``."""
    a, b = extracted.getField("loose"), expected.getField("loose")
    return (a == b) | either_contains(a, b) | (extracted.getField("month") == expected.getField("month"))


def first_match(candidates: DataFrame, keys: tuple[str, ...], rule: Column, pos: str, value: str) -> DataFrame:
    """``*keys, matched``: the value of least position among candidates that meet the rule."""
    return candidates.where(rule).groupBy(*keys).agg(F.min(F.struct(pos, value)).alias("_m")).select(
        *keys, F.col(f"_m.{value}").alias("matched")
    )


def outcomes(
    extracted: DataFrame, gold: DataFrame, attributes: DataFrame, matched: DataFrame | None = None, answered: DataFrame | None = None
) -> DataFrame:
    """One row per event: ``item_id, model, attribute, pos, outcome, value, matched, method``.

    ``extracted`` and ``gold`` are the long forms, ``attributes`` the (item_id, attribute)
    pairs that the gold standard has at all. ``matched`` may bring decisions of earlier
    tiers: ``item_id, model, attribute, pos, matched, method``. ``answered`` has the
    (item_id, model) pairs that are scored, those without any value too; without it they
    are the pairs in ``extracted``. The outcome is ``hit``, ``false_positive``, ``miss`` (of
    each pair that is scored) or ``not_expected``; attributes whose gold is empty have no
    events. Repeated gold values are missed as often as they stand; several extracted
    values may hit the same one.
    """
    keys = ("item_id", "model", "attribute", "pos")
    has_gold = gold.select(*ITEM).distinct()
    expected = extracted.join(has_gold, list(ITEM), "left_semi")
    candidates = expected.join(
        gold.select(*ITEM, F.col("pos").alias("_gpos"), F.col("value").alias("_gold"), F.col("forms").alias("_gforms")), list(ITEM)
    )
    by_string = first_match(candidates, keys, string_rule(F.col("forms"), F.col("_gforms")), "_gpos", "_gold").withColumn(
        "method", F.lit("string")
    )
    tiers = by_string.select(*keys, F.lit(1).alias("_tier"), "matched", "method")
    if matched is not None:
        tiers = tiers.unionByName(matched.select(*keys, F.lit(0).alias("_tier"), "matched", "method"))
        tiers = tiers.groupBy(*keys).agg(F.min(F.struct("_tier", "matched", "method")).alias("_b")).select(
            *keys, "_b.matched", "_b.method"
        )
    judged = expected.join(tiers.select(*keys, "matched", "method"), list(keys), "left").select(
        *keys,
        F.when(F.col("matched").isNotNull(), "hit").otherwise("false_positive").alias("outcome"),
        "value", "matched", "method",
    )
    other = extracted.join(attributes.select(*ITEM).distinct(), list(ITEM), "left_anti").select(
        *keys, F.lit("not_expected").alias("outcome"), "value",
        F.lit(None).cast("string").alias("matched"), F.lit(None).cast("string").alias("method"),
    )
    models = (extracted if answered is None else answered).select("item_id", "model").distinct()
    wanted = gold.select("item_id", "attribute", F.col("pos").alias("gpos"), "stripped", F.col("value").alias("matched"))
    met = judged.where("outcome = 'hit'").select("item_id", "model", "attribute", "matched").distinct()
    missed = (
        wanted.join(models, "item_id")
        .join(met, ["item_id", "model", "attribute", "matched"], "left_anti")
        .select(
            "item_id", "model", "attribute", F.col("gpos").alias("pos"), F.lit("miss").alias("outcome"),
            F.col("stripped").alias("value"), F.lit(None).cast("string").alias("matched"), F.lit(None).cast("string").alias("method"),
        )
    )
    return judged.unionByName(other).unionByName(missed)


def ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(0.0)


def scores(events: DataFrame, totals: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """``*keys``, hits, misses, fps, total_expected, recall, precision, f1.

    ``totals`` has item_id, model and total_expected, the gold values before annotations
    are taken off. Sums come before ratios, so values over several items are micro-averages.
    """
    counted = events.groupBy("item_id", "model").agg(
        F.count_if(F.col("outcome") == "hit").alias("hits"),
        F.count_if(F.col("outcome") == "miss").alias("misses"),
        F.count_if(F.col("outcome") == "false_positive").alias("fps"),
    )
    zero = {"hits": 0, "misses": 0, "fps": 0}
    per = totals.join(counted, ["item_id", "model"], "left").na.fill(zero)
    summed = per.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("hits", "misses", "fps", "total_expected")])
    recall = ratio(F.col("hits"), F.col("total_expected"))
    precision = ratio(F.col("hits"), F.col("hits") + F.col("fps"))
    return summed.withColumn("recall", recall).withColumn("precision", precision).withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def event_table(events: DataFrame) -> DataFrame:
    """Hits, misses and false positives as one flat table, in report order."""
    names = F.when(F.col("outcome") == "hit", "Hit").when(F.col("outcome") == "miss", "Miss").otherwise("False Positive")
    return (
        events.where(F.col("outcome") != "not_expected")
        .select("item_id", "model", "attribute", names.alias("result"), "value", "matched", "method", "pos")
        .orderBy("model", "item_id", "attribute", "result", "pos")
    )
