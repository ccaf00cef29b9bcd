"""Queries of the file sources: tables written in each format and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.plans import scoring
from quillspan.runtime import fresh_path, table
from quillspan.sources import files


def gold_file(spark: SparkSession, d: str) -> DataFrame:
    """Gold values of a JSON dataset that was written from the items."""
    path = fresh_path(spark, "gold")
    items = table(spark, d, "abstract_item").groupBy("abstract_id").agg(
        F.max("title").alias("title"), F.max("abstract").alias("abstract"), F.max("expected").alias("expected")
    )
    files.write_gold(items.withColumnRenamed("abstract_id", "id"), path)
    fields = files.gold_fields(files.read_gold(spark, path, lines=True))
    return fields.select(F.col("item_id").alias("abstract_id"), "attribute", F.posexplode("values").alias("pos", "value"))


def ontology_file(spark: SparkSession, d: str) -> DataFrame:
    """Live classes of RDF/XML files written from the classes; XML keeps no white space around an attribute."""
    path = fresh_path(spark, "ontology")
    classes = table(spark, d, "ontology_class").drop("loaded_at").distinct().where(r"iri rlike '\\S'")
    files.write_ontology(classes, path, files=8)
    read = files.read_ontology(spark, path)
    return read.select("iri", "label", F.array_join("alt_terms", " | ").alias("alt_terms"), "parent_iri")


def vocabulary_file(spark: SparkSession, d: str) -> DataFrame:
    """Terms of vocabulary texts that were written from the classes, by field and line."""
    path = fresh_path(spark, "vocabulary")
    every = F.concat(F.array("label"), F.coalesce("alt_terms", F.array().cast("array<string>")))
    terms = table(spark, d, "vocab_class").select(F.col("schema_field").alias("field"), F.explode(every).alias("term"))
    terms = terms.where(r"term rlike '\\S'").distinct()
    files.write_vocabulary(terms, path)
    fields = tuple(r["field"] for r in terms.select("field").distinct().collect())  # the fields of a schema
    return files.read_vocabulary(spark, path, fields)


QUERIES = {f.__name__: f for f in (gold_file, ontology_file, vocabulary_file)}
SQL = {
    "gold_file": scoring._BASE + "select abstract_id, attribute, pos, value from coerced",
    "ontology_file": r"""
with live as (select distinct iri, label, alt_terms, parent_iri from ontology_class where regexp_matches(iri, '\S') and not coalesce(deprecated, false)),
trimmed as (
  select iri, coalesce(regexp_replace(label, '^\s+|\s+$', '', 'g'), '') as label, regexp_replace(parent_iri, '^\s+|\s+$', '', 'g') as parent_iri,
    list_filter(list_transform(coalesce(alt_terms, []), lambda t: regexp_replace(t, '^\s+|\s+$', '', 'g')), lambda t: t <> '') as alts
  from live)
select iri, label, array_to_string(alts, ' | ') as alt_terms, parent_iri from trimmed""",
    "vocabulary_file": r"""
with t as (
  select distinct field, term from (
    select schema_field as field, label as term from vocab_class union all select schema_field, unnest(alt_terms) from vocab_class)
  where regexp_matches(term, '\S'))
select field, cast(row_number() over (partition by field order by encode(term)) as integer) as pos, term from t""",
}
