"""Model answers: repair of their JSON, and their fields as typed values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillspan.functions.text import absent, stripped

STRICT = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}
EMPTY = "array<string>"


def without_fence(content: Column) -> Column:
    """The inside of a text that is one code fence as a whole, else the text."""
    text = stripped(content)
    inside = F.regexp_extract(text, r"(?is)^```(?:json)?\s*(.*?)\s*```$", 1)
    return F.when(text.rlike(r"(?is)^```(?:json)?\s*.*?\s*```$"), stripped(inside)).otherwise(text)


def repaired(content: Column) -> Column:
    """From the first ``{`` to the last ``}``, without commas before a closing bracket."""
    body = F.regexp_extract(content, r"(?s)(\{.*\})", 1)
    return F.regexp_replace(body, r",\s*([}\]])", "$1")


def as_object(text: Column) -> Column:
    """Fields of one JSON object and their JSON text; null unless it is nothing but that.

    Of equal names the last counts; the wrapping array refuses text behind the object.
    """
    wrapped = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", STRICT)
    only = F.transform(F.array(wrapped), lambda x: F.when(F.size(x) == 1, F.get(x, F.lit(0))))
    return F.when(text.rlike(r"^\s*\{"), F.get(only, F.lit(0)))


def is_object(json_text: Column) -> Column:
    return F.coalesce(json_text.rlike(r"^\s*\{"), F.lit(False))


def is_list(json_text: Column) -> Column:
    return F.coalesce(json_text.rlike(r"^\s*\["), F.lit(False))


def members(json_text: Column) -> Column:
    """The members of a list's JSON text; of other text the text itself; null gives none."""
    return F.when(is_list(json_text), F.from_json(json_text, EMPTY)).when(
        json_text.isNotNull(), F.array(json_text)
    ).otherwise(F.array().cast(EMPTY))


def clean_values(json_text: Column) -> Column:
    """The values of a field, stripped, blanks and nulls left out, absent spellings unified."""
    held = F.filter(F.transform(members(json_text), stripped), lambda v: v.isNotNull() & (v != ""))
    return F.transform(held, lambda v: absent(v))


def payload_values(payload: Column) -> Column:
    """The ``values`` of a field's object, or the payload itself where it is none."""
    return F.when(is_object(payload), F.get_json_object(payload, "$.values")).otherwise(payload)


def payload_reasoning(payload: Column) -> Column:
    return F.when(is_object(payload), stripped(F.get_json_object(payload, "$.reasoning")))


def joined_values(payload: Column) -> Column:
    """The values as one comma-joined text; nulls are written ``None`` as in the source format."""
    values = F.from_json(F.get_json_object(payload, "$.values"), EMPTY)
    as_text = F.array_join(F.transform(values, lambda v: F.coalesce(v, F.lit("None"))), ", ")
    raw = F.get_json_object(payload, "$.values")
    return (
        F.when(~is_object(payload), payload)
        .when(is_list(raw), as_text)
        .when(raw.isNull(), F.when(F.array_contains(F.json_object_keys(payload), "values"), "None").otherwise(""))
        .otherwise(raw)
    )


def gold_values(gold: Column) -> Column:
    """Gold values of a field in any of their five encodings, in order.

    Null and empty texts are left out, blank ones too save in a bare text or ``values``.
    """
    none = F.array().cast(EMPTY)

    def nonblank(x: Column) -> Column:
        return F.filter(x, lambda v: v.isNotNull() & (stripped(v) != ""))

    def of_values(x: Column, keep_blank: bool) -> Column:
        raw = F.get_json_object(x, "$.values")
        kept = F.filter(members(raw), lambda v: v.isNotNull() & (v != ""))
        return F.when(is_list(raw), kept if keep_blank else nonblank(kept)).otherwise(nonblank(members(raw)))

    def of_object(x: Column, keep_blank: bool) -> Column:
        value = F.get_json_object(x, "$.value")
        has_values = x.rlike(r'"values"\s*:')
        first, second = (has_values, ~has_values) if keep_blank else (value.isNull(), value.isNotNull())
        return F.when(first, of_values(x, keep_blank)).when(second, nonblank(F.array(value))).otherwise(none)

    def of_member(x: Column) -> Column:
        return F.when(is_object(x), of_object(x, False)).otherwise(nonblank(F.array(stripped(x))))

    return (
        F.when(gold.isNull(), none)
        .when(is_list(gold), F.flatten(F.transform(F.from_json(gold, EMPTY), of_member)))
        .when(is_object(gold), of_object(gold, True))
        .otherwise(F.array(gold))
    )
