"""Normal forms of texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Spellings of an absent value and what they become.
ABSENT = {
    "unspecified": "not specified",
    "unknown": "not specified",
    "n/a": "not applicable",
    "none": "not mentioned",
    "not available": "not mentioned",
    "not stated": "not mentioned",
    "not reported": "not mentioned",
}


def stripped(x: Column) -> Column:
    """Without white space at both ends, of any script."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def without_annotations(x: Column) -> Column:
    """Without the notes ``(inferred)`` and ``(not mentioned)``, in this case only."""
    return stripped(F.regexp_replace(x, r"(?U)\s*\((?:inferred|not mentioned)\)", ""))


def field_name(x: Column) -> Column:
    """A field's plain name: marks of emphasis and headings off, lower case, underscores."""
    bare = x
    for pattern in (r"^\*+", r"\*+$", r"^_+", r"_+$", r"^#+\s*"):
        bare = F.regexp_replace(bare, pattern, "")
    return F.translate(F.lower(stripped(bare)), " -", "__")


def loose(x: Column) -> Column:
    """The form in which values are compared by the string rules."""
    return F.translate(stripped(F.lower(x)), "-_", "  ")


def either_contains(a: Column, b: Column) -> Column:
    """One of two loose forms contains the other, both of three characters or more."""
    return (F.length(a) >= 3) & (F.length(b) >= 3) & (F.contains(a, b) | F.contains(b, a))


def split_values(x: Column) -> Column:
    """Members of a comma-joined value, stripped, blanks kept."""
    return F.transform(F.split(x, ",", -1), stripped)


def listed(x: Column) -> Column:
    """Members of a comma-joined setting, stripped, blanks left out."""
    return F.filter(split_values(x), lambda v: v != "")


def absent(x: Column, words: dict[str, str] | None = None) -> Column:
    """Spellings of an absent value to their common form, other texts as they are."""
    known = F.create_map(*[F.lit(w) for pair in (words or ABSENT).items() for w in pair])
    return F.coalesce(F.try_element_at(known, F.lower(stripped(x))), x)


def safe_name(x: Column) -> Column:
    """A folder name from a model name: its last part, other signs as one dash."""
    leaf = F.element_at(F.split(stripped(x), "/"), -1)
    dashed = F.regexp_replace(leaf, r"[^A-Za-z0-9._-]+", "-")
    return F.coalesce(F.nullif(F.regexp_replace(dashed, r"^[._-]+|[._-]+$", ""), F.lit("")), F.lit("unknown-model"))


def folder_name(models: Column) -> Column:
    """The folder of a run over an array of models."""
    return F.when(F.size(models) == 1, safe_name(F.get(models, F.lit(0)))).otherwise("multi-model")


def html_escaped(x: Column) -> Column:
    out = x
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(sign), F.lit(name))
    return out


def short_id(iri: Column) -> Column:
    """What follows the last ``/`` and then the last ``#``."""
    return F.element_at(F.split(F.element_at(F.split(iri, "/"), -1), "#"), -1)


def shortened(x: Column, length: int, mark: str = "...") -> Column:
    return F.concat(F.substring(x, 1, length), F.lit(mark))


def seconds_text(x: Column) -> Column:
    return F.when(x.isNull(), "n/a").otherwise(F.format_string("%.2fs", x))
