"""Light validation of answers against field rules, as arrays of errors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.functions import answers
from quillspan.operators.lookups import small

FREE = "free"


def allowed_of_vocabulary(classes: DataFrame, free: Sequence[str] = ()) -> DataFrame:
    """``field, value``: labels and alternative terms as the allowed values of a schema field."""
    every = F.concat(F.array("label"), F.coalesce("alt_terms", F.array().cast("array<string>")))
    long = classes.select(F.col("schema_field").alias("field"), F.explode(every).alias("value"))
    return long.where(F.col("value").rlike(r"\S") & ~F.col("field").isin(*free, "")).distinct()


def light_errors(
    rows: DataFrame, key: str, fields: str, allowed: DataFrame, known: Sequence[str], required: Sequence[str] = ()
) -> DataFrame:
    """``key, error, field, detail``: one row per fault of each answer.

    ``fields`` maps field names to their JSON text. Errors: ``missing`` (a required field),
    ``unexpected`` (not among ``known``), ``not_object``, ``missing_key`` (values or
    reasoning), ``values_not_list``, ``reasoning_not_text``, and ``unsupported`` for every
    value outside the field's allowed ones; fields without allowed values take any text.
    """
    absent = rows.select(
        key, F.explode(F.array_except(F.array(*map(F.lit, required)).cast("array<string>"), F.map_keys(fields))).alias("field")
    ).select(key, F.lit("missing").alias("error"), "field", F.lit("").alias("detail"))
    long = rows.select(key, F.explode(fields).alias("field", "p"))
    p, inside = F.col("p"), answers.is_object(F.col("p"))
    values = F.get_json_object(p, "$.values")

    keys = F.coalesce(F.json_object_keys(p), F.array().cast("array<string>"))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(p), "$.reasoning", "variant"))

    def has(name: str) -> Column:
        return F.array_contains(keys, name)

    def entry(test: Column, error: str, detail: str = "") -> Column:
        return F.when(test, F.struct(F.lit(error).alias("error"), F.lit(detail).alias("detail")))

    is_known = F.col("field").isin(*known)
    faults = F.array(
        entry(~is_known, "unexpected"),
        entry(is_known & ~inside, "not_object"),
        entry(is_known & inside & ~has("values"), "missing_key", "values"),
        entry(is_known & inside & ~has("reasoning"), "missing_key", "reasoning"),
        entry(is_known & inside & ~answers.is_list(values), "values_not_list"),
        entry(is_known & inside & ~kind.isin("STRING", "VOID"), "reasoning_not_text"),
    )
    shape = long.select(key, "field", F.inline(F.filter(faults, lambda x: x.isNotNull())))
    held = long.where(is_known & inside & answers.is_list(values)).select(
        key, "field", F.explode(answers.members(values)).alias("value")
    ).where("value is not null")
    outside = (
        held.join(small(allowed.select("field").distinct()), "field", "left_semi")
        .join(small(allowed), ["field", "value"], "left_anti")
        .select(key, F.lit("unsupported").alias("error"), "field", F.col("value").alias("detail"))
    )
    return absent.unionByName(shape.select(key, "error", "field", "detail")).unionByName(outside)
