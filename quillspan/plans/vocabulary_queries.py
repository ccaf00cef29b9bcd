"""Queries of the ontology and the controlled vocabulary."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.domains import DOMAINS, domains_of
from quillspan.functions.text import short_id
from quillspan.operators import vocabulary
from quillspan.operators.lookups import with_lookups
from quillspan.operators.validation import allowed_of_vocabulary
from quillspan.runtime import table

#: Field, parent classes and label patterns of the demonstration rules; rules are data of the caller.
RULES = (
    ("outbreak", ("http://onto.example/obo/EPX_000000001",), ("outbreak", "epidemic", "transmission")),
    ("care", (), ("hospital", "ward", "clinic")),
    ("care_extra", (), ("oxygen", "triage")),
    ("herd", (), ("herd", "flock")),
)


def _terms(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(list(RULES), "field string, parent_iris array<string>, label_patterns array<string>")
    return vocabulary.field_terms(table(spark, d, "ontology_class"), rules, {"care_extra": "care"})


def ontology_map(spark: SparkSession, d: str) -> DataFrame:
    return _terms(spark, d).select("field", "iri", "label")


def ontology_enum(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.enumeration(_terms(spark, d))


def synonym_map(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.synonyms(_terms(spark, d))


def vocab_summary(spark: SparkSession, d: str) -> DataFrame:
    return vocabulary.summary(vocabulary.enumeration(_terms(spark, d)))


def _vocab(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "vocab_class").withColumn("field", F.col("schema_field"))


def term_list(spark: SparkSession, d: str) -> DataFrame:
    """All terms of the vocabulary with which extractions are joined, and how often each occurs."""
    terms = vocabulary.all_terms(_vocab(spark, d)).select("field", F.lower(F.trim("term")).alias("term"), "iri").distinct()
    rows = table(spark, d, "extraction").select("extraction_id", "attr_name", "value_list").distinct()
    used = rows.select(F.col("attr_name").alias("field"), F.explode("value_list").alias("v")).select("field", F.lower(F.trim("v")).alias("term"))
    counted = used.groupBy("field", "term").agg(F.count("*").alias("n"))
    return terms.join(counted, ["field", "term"], "left").na.fill({"n": 0})


def enum_violations(spark: SparkSession, d: str) -> DataFrame:
    """Extracted values that are no term of their field's vocabulary."""
    rows = table(spark, d, "extraction").select("extraction_id", "attr_name", "value_list").distinct()
    values = rows.select("extraction_id", F.col("attr_name").alias("field"), F.posexplode("value_list").alias("pos", "value")).where("value is not null")
    allowed = allowed_of_vocabulary(table(spark, d, "vocab_class"))
    return vocabulary.violations(values, allowed).select("extraction_id", "field", "pos", "value")


def short_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ontology_class").where(r"iri rlike '\\S'").select("iri").distinct().select("iri", short_id(F.col("iri")).alias("short_id"))


def parents(spark: SparkSession, d: str) -> DataFrame:
    """Parent and grandparent labels of live classes, by exact IRI."""
    live = vocabulary.live_classes(table(spark, d, "ontology_class")).select("iri", "label", "parent_iri")
    up = live.select(F.col("iri").alias("parent_iri"), F.col("label").alias("parent_label"), F.col("parent_iri").alias("grand_iri"))
    top = live.select(F.col("iri").alias("grand_iri"), F.col("label").alias("grand_label"))
    return live.join(up, "parent_iri", "left").join(top, "grand_iri", "left").select("iri", "parent_label", "grand_label")


def domains(spark: SparkSession, d: str) -> DataFrame:
    """Extractions by modelling domain of their attribute."""
    rows = table(spark, d, "extraction").select("extraction_id", "attr_name").distinct()
    return rows.select(F.explode(domains_of(F.col("attr_name"))).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"))


def lookup_outer(spark: SparkSession, d: str) -> DataFrame:
    """Each distinct extracted value with the vocabulary classes of that label."""
    rows = table(spark, d, "extraction").select("extraction_id", "value_list").distinct()
    values = rows.select(F.explode("value_list").alias("v")).where("v is not null").select(F.lower(F.trim("v")).alias("attribute")).distinct()
    found = table(spark, d, "vocab_class").select(
        F.lower(F.trim("label")).alias("attribute"), F.col("iri").alias("identifier"), F.col("label").alias("matched_term"),
        F.lit(None).cast("string").alias("status"), F.lit("").alias("ontology_definition"), "definition",
    )
    joined = with_lookups(values, found, "attribute")
    return joined.select("attribute", F.size("lookups").alias("n"), F.get("lookups", F.lit(0)).getField("definition").alias("definition"))


QUERIES = {
    f.__name__: f
    for f in (ontology_map, ontology_enum, synonym_map, vocab_summary, term_list, enum_violations, short_ids, parents, domains, lookup_outer)
}

_RULES = " union all ".join(
    f"select '{f}' as field, {list(p)!r}::varchar[] as parent_iris, {list(w)!r}::varchar[] as label_patterns" for f, p, w in RULES
)
_LIVE = r"""
with live as (
  select distinct iri, label, alt_terms, definition, parent_iri from ontology_class
  where regexp_matches(iri, '\S') and not coalesce(deprecated, false)),
"""
_TERMS = (
    _LIVE
    + f"""rule as ({_RULES}),
term as (
  select case when r.field = 'care_extra' then 'care' else r.field end as field, c.iri, c.label,
    list_filter(coalesce(c.alt_terms, []), lambda t: t is not null and regexp_matches(t, '\\S')) as alts
  from live c left join live p on c.parent_iri = p.iri
  join rule r on list_contains(r.parent_iris, c.parent_iri) or list_contains(r.parent_iris, p.parent_iri)
    or len(list_filter(r.label_patterns, lambda w: contains(lower(coalesce(c.label, '')), w))) > 0),
pref as (select *, coalesce(alts[1], label) as pref from term),
enum as (
  select field, arg_min(pref, struct_pack(i := iri, p := pref)) as value from pref where regexp_matches(pref, '\\S') group by field, lower(pref))
"""
)
SQL = {
    "ontology_map": _TERMS + "select field, iri, label from term",
    "ontology_enum": _TERMS + "select field, value from enum",
    "vocab_summary": _TERMS
    + """select field, cast(count(*) as bigint) as n, (list(value order by encode(value)))[1:10] as head, cast(greatest(count(*) - 10, 0) as bigint) as rest
from enum group by field""",
    "synonym_map": _TERMS
    + """, every as (
  select distinct field, iri, pref, unnest(list_concat(case when regexp_matches(label, '\\S') then [label] else [] end, alts)) as t from pref)
select field, lower(t) as term, arg_max(pref, iri) as canonical from every where lower(t) <> lower(pref) group by 1, 2""",
    "term_list": r"""
with t as (
  select distinct field, lower(trim(term)) as term, iri from (
    select schema_field as field, label as term, iri from vocab_class
    union all select schema_field, unnest(alt_terms), iri from vocab_class) where regexp_matches(term, '\S')),
u as (
  select field, lower(trim(v)) as term, count(*) as n from (
    select attr_name as field, unnest(value_list) as v from (select distinct extraction_id, attr_name, value_list from extraction))
  where v is not null group by 1, 2)
select t.field, t.term, t.iri, cast(coalesce(u.n, 0) as bigint) as n from t left join u using (field, term)""",
    "short_ids": r"""select distinct iri, string_split(string_split(iri, '/')[-1], '#')[-1] as short_id from ontology_class where regexp_matches(iri, '\S')""",
    "parents": _LIVE.rstrip().rstrip(",")
    + """
select c.iri, p.label as parent_label, g.label as grand_label
from live c left join live p on c.parent_iri = p.iri left join live g on p.parent_iri = g.iri""",
    "enum_violations": r"""
with v as (
  select distinct schema_field as field, label as value from vocab_class where regexp_matches(label, '\S')
  union select schema_field, t from vocab_class, unnest(alt_terms) as u(t) where regexp_matches(t, '\S')),
e as (select distinct extraction_id, attr_name as field, value_list from extraction),
m as (select extraction_id, field, cast(i - 1 as integer) as pos, value_list[i] as value from e, unnest(range(1, len(value_list) + 1)) as u(i))
select extraction_id, field, pos, value from m where value is not null and field in (select field from v)
  and not exists (select 1 from v where v.field = m.field and v.value = m.value)""",
    "lookup_outer": """
with a as (select distinct lower(trim(v)) as attribute from (select unnest(value_list) as v from extraction) where v is not null)
select attribute, cast(count(c.iri) as integer) as n, first(nullif(c.definition, '') order by c.iri) as definition
from a left join vocab_class c on lower(trim(c.label)) = a.attribute group by attribute""",
}
SQL["domains"] = (
    "with e as (select distinct extraction_id, attr_name from extraction), exact as (select attr_name, domain from (values "
    + ", ".join(f"('{a}', '{dom}')" for dom, (names, _) in DOMAINS.items() for a in names)
    + ") as m(attr_name, domain)), worded as (select distinct attr_name, domain from e, (values "
    + ", ".join(f"('{w}', '{dom}')" for dom, (_, words) in DOMAINS.items() for w in words)
    + """) as w(word, domain) where contains(lower(attr_name), word) and attr_name not in (select attr_name from exact)),
m as (select * from exact union select * from worded)
select coalesce(domain, 'other') as domain, cast(count(*) as bigint) as n from e left join m using (attr_name) group by 1"""
)
