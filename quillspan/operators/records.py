"""Delimited text records: loading the sound ones, setting apart the rest with the fault.

A record is first cut into nullable text columns, then every cast and constraint rule is
evaluated as a column expression into one array of faults; rows with an empty array are
loaded, the others are reported. All of it is built-in expressions on single rows: no
shuffle besides the one that counts a redelivered record once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.runtime import delivered_once, once

MARK = "\x01"


@dataclass(frozen=True)
class Field:
    """A column of the record: its name, Spark type, and the rule its text must meet."""

    name: str
    type: str
    valid: Callable[[Column], Column]


def positive_integer(text: Column) -> Column:
    return text.rlike(r"^[0-9]+\z") & (text.try_cast("bigint") > 0)


def non_negative_integer_or_empty(text: Column) -> Column:
    return (text == "") | (text.rlike(r"^[0-9]+\z") & text.try_cast("bigint").isNotNull())


def non_negative_decimal_or_empty(text: Column) -> Column:
    """Finite as a double; exponents allowed, ``-0`` counts as 0."""
    number = text.try_cast("double")
    return (text == "") | (
        text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z")
        & (number >= 0)
        & (number < float("inf"))
    )


def not_blank(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def boolean_word(text: Column) -> Column:
    return F.lower(text).isin("true", "false")


def matches(pattern: str) -> Callable[[Column], Column]:
    return lambda text: text.rlike(pattern)


def json_object(text: Column) -> Column:
    """Whether the text is one JSON object and nothing else, by the strict grammar.

    The wrapping array makes trailing text a fault; ``NaN`` and single quotes are refused.
    """
    options = {"allowSingleQuotes": "false", "allowNonNumericNumbers": "false", "mode": "PERMISSIVE"}
    parsed = F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<map<string,string>>", options)
    one = F.exists(F.array(parsed), lambda x: x.isNotNull() & (F.size(x) == 1) & F.get(x, F.lit(0)).isNotNull())
    return text.rlike(r"^[ \t\r\n]*\{") & text.rlike(r"\}[ \t\r\n]*\z") & one


def json_object_or_empty(text: Column) -> Column:
    return (text == "") | json_object(text)


def pieces_of(line: Column) -> Column:
    """The record cut at its quotes: even members stand outside quotes, odd ones inside.

    The mark that ``fields_of`` puts between fields is escaped where the text has it.
    """
    return F.split(F.replace(line, F.lit(MARK), F.lit(MARK + "E")), '"', -1)


def well_formed(pieces: Column) -> Column:
    """RFC 4180: each field holds no quote, or is quoted whole with inner quotes doubled.

    Cut at the quotes, a piece between two quoted stretches is empty (a doubled quote) or
    starts and ends with a comma; the outermost pieces touch a comma or are empty.
    """
    n = F.size(pieces)
    ends = F.transform(
        pieces,
        lambda x, i: (i % 2 == 1)
        | (x == "")
        | (((i == 0) | x.startswith(",")) & ((i == n - 1) | x.endswith(","))),
    )
    return (n % 2 == 1) & F.forall(ends, lambda x: x)


def fields_of(pieces: Column) -> Column:
    """The fields of a well-formed record, unquoted."""
    n = F.size(pieces)
    joined = F.array_join(
        F.transform(
            pieces,
            lambda x, i: F.when(i % 2 == 1, x)
            .when((x == "") & (i > 0) & (i < n - 1), F.lit('"'))
            .otherwise(F.replace(x, F.lit(","), F.lit(MARK + "S"))),
        ),
        "",
    )
    return F.transform(
        F.split(joined, MARK + "S", -1), lambda x: F.replace(x, F.lit(MARK + "E"), F.lit(MARK))
    )


def parse_records(
    rows: DataFrame, key: str, line: str, fields: Sequence[Field], cast: bool = True
) -> DataFrame:
    """One row per record: ``key``, the typed ``fields``, ``faults`` and ``bad_fields``.

    ``faults`` holds ``quoting``, ``columns`` or ``value``, in this order and at most one of
    the first two; ``bad_fields`` names the fields with invalid values. Sound records have
    both arrays empty; unsound ones have null fields. Empty text in a typed field loads as
    null, in a text field as the empty string.

    A null record has the fault ``columns``, as has an empty one. Records delivered more
    than once, unchanged, count once; different texts under one key keep a row each, and so
    do records of null key. They are counted after they are parsed, so that whoever takes
    only the sound or the faulty ones shuffles only those. An empty table gives an empty
    result; other columns, even ones named like the fields, are ignored.
    """
    one = rows.select(F.col(key).alias("_key"), F.col(line).alias("_line"))
    text = F.coalesce(F.col("_line"), F.lit(""))
    cut = once(one, "_pieces", pieces_of(text))
    cut = once(cut, "_formed", well_formed(F.col("_pieces")))
    cut = once(cut, "_f", F.when(F.col("_formed"), fields_of(F.col("_pieces"))))
    cut = cut.withColumn("_right", F.col("_formed") & (F.size("_f") == len(fields)) & F.col("_line").isNotNull())
    bad = F.filter(
        F.array(
            *[
                F.when(F.coalesce(f.valid(F.get("_f", F.lit(i))), F.lit(False)), F.lit(None)).otherwise(F.lit(f.name))
                for i, f in enumerate(fields)
            ]
        ),
        lambda x: x.isNotNull(),
    )
    empty = F.array().cast("array<string>")
    marked = once(cut, "bad_fields", F.when(F.col("_right"), bad).otherwise(empty)).withColumn(
        "faults",
        F.when(~F.col("_formed"), F.array(F.lit("quoting")))
        .when(~F.col("_right"), F.array(F.lit("columns")))
        .when(F.size("bad_fields") > 0, F.array(F.lit("value")))
        .otherwise(empty),
    )
    typed = []
    for i, f in enumerate(fields):
        value = F.get("_f", F.lit(i))
        if cast and f.type != "string":
            value = F.nullif(value, F.lit("")).try_cast(f.type)
        typed.append(F.when(F.size("faults") == 0, value).alias(f.name))
    parsed = marked.select(F.col("_key").alias("_id"), *typed, "faults", "bad_fields", F.col("_line").alias("raw"))
    return delivered_once(parsed, "_id").withColumnRenamed("_id", key)


def sound(parsed: DataFrame) -> DataFrame:
    """The loaded records, without the fault columns."""
    return parsed.where(F.size("faults") == 0).drop("faults", "bad_fields", "raw")


def faulty(parsed: DataFrame, key: str) -> DataFrame:
    """``key, fault, bad_fields, raw``: the records set apart, each with its first fault."""
    return parsed.where(F.size("faults") > 0).select(
        key, F.get("faults", F.lit(0)).alias("fault"), "bad_fields", "raw"
    )


#: The export of model responses.
RESPONSE_EXPORT = (
    Field("response_id", "bigint", positive_integer),
    Field("abstract_id", "string", matches(r"^AB[0-9]{9}\z")),
    Field("model", "string", not_blank),
    Field("done", "boolean", boolean_word),
    Field("request_duration_s", "double", non_negative_decimal_or_empty),
    Field("completion_tokens", "bigint", non_negative_integer_or_empty),
    Field("content", "string", json_object_or_empty),
)
