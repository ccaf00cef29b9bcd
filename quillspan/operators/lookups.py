"""Joins with dictionaries of terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspan.functions.text import stripped

#: Terms, and bytes of them, up to which a dictionary is broadcast; a larger one is joined by shuffle.
BROADCAST_TERMS = 100_000
BROADCAST_BYTES = 32_000_000


def width(df: DataFrame) -> Column:
    """About how many bytes a row of ``df`` takes."""
    def of(column: Column, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.octet_length(column)
        if isinstance(kind, T.ArrayType):
            if isinstance(kind.elementType, (T.StringType, T.ArrayType, T.StructType)):
                return F.aggregate(column, F.lit(0), lambda total, x: total + F.coalesce(of(x, kind.elementType), F.lit(0)))
            return F.size(column) * 8
        if isinstance(kind, T.StructType):
            return sum((F.coalesce(of(column.getField(f.name), f.dataType), F.lit(0)) for f in kind), F.lit(0))
        return F.lit(8)

    return sum((F.coalesce(of(F.col(f"`{f.name}`"), f.dataType), F.lit(0)) for f in df.schema), F.lit(0))


def small(df: DataFrame, limit: int = BROADCAST_TERMS, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``limit`` rows of ``most`` bytes together, else as it is.

    The check runs what ``df`` is made of: cut a costly one from its lineage before.
    """
    seen = df.limit(limit + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(width(df).cast("bigint")), F.lit(0)).alias("bytes")).first()
    return F.broadcast(df) if seen["n"] <= limit and seen["bytes"] <= most else df


def canonical(rows: DataFrame, value: str, terms: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``rows`` with ``value`` replaced by its canonical form; values without one stay untrimmed.

    ``terms`` has term, canonical and the columns ``by``, which must agree. Of several
    canonical forms of one term the smallest counts. Null values stay null.
    """
    known = terms.groupBy(*by, F.lower(stripped(F.col("term"))).alias("_term")).agg(F.min("canonical").alias("_to"))
    keyed = rows.withColumn("_term", F.lower(stripped(F.col(value))))
    joined = keyed.join(small(known), [*by, "_term"], "left").withColumn(value, F.coalesce("_to", value))
    return joined.select(*rows.columns)


def with_lookups(attributes: DataFrame, found: DataFrame, on: str) -> DataFrame:
    """Each attribute row with an array of its lookup results; empty where there are none.

    ``found`` has identifier, matched_term, status, ontology_definition, definition; an
    empty definition counts as none, and a missing status reads ``found``. The array of one
    attribute value holds its own lookups only.
    """
    definition: Column = F.coalesce(
        F.nullif(F.col("ontology_definition"), F.lit("")), F.nullif(F.col("definition"), F.lit(""))
    )
    entry = F.struct(
        "identifier", "matched_term", F.coalesce("status", F.lit("found")).alias("status"), definition.alias("definition")
    )
    gathered = found.groupBy(on).agg(F.array_sort(F.collect_list(entry)).alias("lookups"))
    return attributes.join(gathered, on, "left").withColumn(
        "lookups", F.coalesce("lookups", F.array().cast(gathered.schema["lookups"].dataType))
    )
