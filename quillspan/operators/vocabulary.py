"""Controlled vocabulary from ontology classes: fields, terms, enumerations, synonyms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspan.functions.text import stripped
from quillspan.operators.lookups import small


def live_classes(classes: DataFrame) -> DataFrame:
    """Classes with an IRI that are not deprecated; repeated rows once, by ``iri``."""
    kept = classes.where(F.col("iri").rlike(r"\S") & ~F.coalesce("deprecated", F.lit(False)))
    return kept.groupBy("iri").agg(
        F.min(F.struct("label", "alt_terms", "definition", "parent_iri")).alias("c")
    ).select("iri", "c.*")


def field_terms(classes: DataFrame, rules: DataFrame, renamed: dict[str, str] | None = None) -> DataFrame:
    """``field, iri, label, alt_terms, definition``: the classes of each field.

    ``rules`` has field, parent_iris and label_patterns: a class belongs to a field if its
    parent or grandparent is listed or its label contains a pattern. A deprecated parent
    is not looked through, as it is no class. ``renamed`` fields are appended to another
    field, a class that fits both standing there twice. Rules are few and broadcast if so.
    """
    live = live_classes(classes)
    up = live.select(F.col("iri").alias("parent_iri"), F.col("parent_iri").alias("_grand"))
    known = live.join(up, "parent_iri", "left")
    one = F.lower(F.coalesce("label", F.lit("")))
    fits = (
        F.coalesce(F.array_contains("parent_iris", F.col("parent_iri")), F.lit(False))
        | F.coalesce(F.array_contains("parent_iris", F.col("_grand")), F.lit(False))
        | F.exists("label_patterns", lambda p: F.contains(one, p))
    )
    found = known.join(small(rules.select("field", "parent_iris", "label_patterns")), fits)
    target = F.col("field")
    for old, new in (renamed or {}).items():
        target = F.when(F.col("field") == old, new).otherwise(target)
    return found.select(target.alias("field"), "iri", "label", "alt_terms", "definition")


def _alternatives(alt_terms: Column) -> Column:
    return F.filter(F.coalesce(alt_terms, F.array().cast("array<string>")), lambda t: t.isNotNull() & t.rlike(r"\S"))


def preferred(label: Column, alt_terms: Column) -> Column:
    """The first alternative term, else the label."""
    return F.coalesce(F.get(_alternatives(alt_terms), F.lit(0)), label)


def all_terms(terms: DataFrame) -> DataFrame:
    """``field, iri, pos, term``: label and alternatives, of equal ones (but for case) the first."""
    every = F.concat(F.filter(F.array("label"), lambda t: t.rlike(r"\S")), _alternatives(F.col("alt_terms")))
    long = terms.select("field", "iri", "label", "alt_terms", F.posexplode(every).alias("pos", "term"))
    same = Window.partitionBy("field", "iri", F.lower(stripped(F.col("term")))).orderBy("pos")
    return long.withColumn("_n", F.row_number().over(same)).where("_n = 1").drop("_n", "label", "alt_terms")


def enumeration(terms: DataFrame) -> DataFrame:
    """``field, value``: preferred terms of each field, of those equal but for case the one
    of the first class by IRI."""
    chosen = terms.withColumn("value", preferred(F.col("label"), F.col("alt_terms"))).where(F.col("value").rlike(r"\S"))
    return chosen.groupBy("field", F.lower("value").alias("_l")).agg(F.min_by("value", F.struct("iri", "value")).alias("value")).drop("_l")


def synonyms(terms: DataFrame) -> DataFrame:
    """``field, term, canonical``: each term in lower case to its class's preferred term.

    A term of several classes goes to the last by IRI; a term equal to its own canonical
    form but for case is no synonym.
    """
    name = terms.select("field", "iri", preferred(F.col("label"), F.col("alt_terms")).alias("canonical")).distinct()
    pairs = all_terms(terms).join(name, ["field", "iri"]).where(F.lower("term") != F.lower("canonical"))
    return pairs.groupBy("field", F.lower("term").alias("term")).agg(F.max_by("canonical", F.struct("iri", "pos")).alias("canonical"))


def summary(values: DataFrame, first: int = 10) -> DataFrame:
    """``field, n, head, rest``: size, first values and remainder of each enumeration."""
    gathered = values.groupBy("field").agg(F.array_sort(F.collect_list("value")).alias("v"))  # an enumeration, shown to people
    return gathered.select(
        "field", F.size("v").cast("bigint").alias("n"), F.slice("v", 1, first).alias("head"),
        F.greatest(F.size("v") - first, F.lit(0)).cast("bigint").alias("rest"),
    )


def violations(values: DataFrame, allowed: DataFrame) -> DataFrame:
    """The rows of ``values`` (field, value, ...) that their field's enumeration does not allow.

    Fields without an enumeration allow everything; repeated values keep a row each.
    """
    ruled = values.join(small(allowed.select("field").distinct()), "field", "left_semi")
    return ruled.join(small(allowed.select("field", "value").distinct()), ["field", "value"], "left_anti")
