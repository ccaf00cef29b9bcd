"""Registered queries of the ``llm`` operators and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.llm import canonical, encoding, leakage, pairs, quantiles, subjects, terms
from quillspan.runtime import table


FIELDS = ("request_duration_s", "eval_duration_s", "completion_tokens")
SHARES = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)


def _nine_digits(value: str) -> Column:
    """Nine significant digits, whatever the size of the value."""
    return F.format_string("%.8e", value).cast("double")


def _daily(spark: SparkSession, d: str) -> DataFrame:
    calls = table(spark, d, "llm_call").withColumn("day", F.to_date("called_at"))
    return quantiles.sketch(quantiles.once(calls, "call_id", ("model", "day"), FIELDS), ("model", "day"), FIELDS)


def p1_sketches(spark: SparkSession, d: str) -> DataFrame:
    """Bucket counts by model and day, the form in which days are combined."""
    return _daily(spark, d)


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles by model, from the combined sketches of all days."""
    found = quantiles.percentiles(_daily(spark, d), ("model",), SHARES)
    return found.withColumn("value", _nine_digits("value"))


def p1_response_percentiles(spark: SparkSession, d: str) -> DataFrame:
    responses = quantiles.once(table(spark, d, "llm_response"), "response_id", ("model",), FIELDS)
    found = quantiles.percentiles(quantiles.sketch(responses, ("model",), FIELDS), ("model",), SHARES)
    return found.withColumn("value", _nine_digits("value"))


def _matched(spark: SparkSession, d: str) -> DataFrame:
    values = canonical.members(table(spark, d, "extraction"), "extraction_id", "attr_name", "value_list")
    vocabulary = canonical.entry_terms(table(spark, d, "vocab_class"), "iri", "schema_field", "label", "alt_terms")
    return canonical.match(values, vocabulary)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return _matched(spark, d).select(F.col("key").alias("extraction_id"), "pos", F.col("entry").alias("iri"))


def p2_unmatched(spark: SparkSession, d: str) -> DataFrame:
    """Report of the values that name no class: occurrences by field and value."""
    missed = _matched(spark, d).where("entry = ''")
    return missed.groupBy("field", "value").agg(F.count("*").alias("occurrences"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return pairs.found(pairs.defects(table(spark, d, "llm_response"), table(spark, d, "abstract_item")))


def p5_labels(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with all defects above their cutoffs."""
    return pairs.defects(table(spark, d, "llm_response"), table(spark, d, "abstract_item"))


def p6_terms(spark: SparkSession, d: str) -> DataFrame:
    records = terms.all_records(table(spark, d, "extraction"), table(spark, d, "abstract_item"))
    return terms.marked(terms.term_counts(records, "record", "terms"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_terms(spark, d).where("mark <> 'useful'").select("term", "mark")


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return encoding.encode(table(spark, d, "documents"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked(table(spark, d, "documents"), table(spark, d, "eval_item"))


def _subjects(spark: SparkSession, d: str) -> DataFrame:
    return subjects.subjects_of(
        table(spark, d, "documents"), table(spark, d, "subject_area"), table(spark, d, "subject_label")
    )


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _subjects(spark, d).select("doc_id", "subject")


def p10_composition(spark: SparkSession, d: str) -> DataFrame:
    return subjects.composition(_subjects(spark, d), table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_sketches, p1_percentiles, p1_response_percentiles, p2_found, p2_unmatched, p5_found, p5_labels, p6_found, p6_terms, p8_ids, p9_found, p10_found, p10_composition)}

_TERMS = r"""
with gold_field as (
  select abstract_id, je.value as g
  from (select distinct abstract_id, expected from abstract_item) a, json_each(a.expected::json) je),
gold as (
  select abstract_id, json_extract_string(g, '$') as v from gold_field where json_type(g) = 'VARCHAR'
  union all
  select abstract_id, json_extract_string(m.value, '$') from gold_field, json_each(g) m
  where json_type(g) = 'ARRAY' and json_type(m.value) = 'VARCHAR'
  union all
  select abstract_id, json_extract_string(m.value, '$.value') from gold_field, json_each(g) m
  where json_type(g) = 'ARRAY' and json_type(m.value) = 'OBJECT'
  union all
  select abstract_id, json_extract_string(w.value, '$') from gold_field, json_each(g) m, json_each(m.value, '$.values') w
  where json_type(g) = 'ARRAY' and json_type(m.value) = 'OBJECT'
  union all
  select abstract_id, json_extract_string(g, '$.value') from gold_field where json_type(g) = 'OBJECT'
  union all
  select abstract_id, json_extract_string(w.value, '$') from gold_field, json_each(g, '$.values') w
  where json_type(g) = 'OBJECT'),
token as (
  select 'e' || extraction_id as record, unnest(value_list) as v
  from (select distinct extraction_id, value_list from extraction)
  union all
  select 'a' || abstract_id, v from gold),
term as (
  select record, lower(trim(v, ' ' || chr(9))) as term from token where trim(v, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
counted as (
  select term, cast(count(*) as bigint) as occurrences, cast(count(distinct record) as bigint) as records
  from term group by term),
marked as (
  select *, case when records = 1 then 'rare'
    when records > 0.01 * (select count(distinct record) from term) then 'common' else 'useful' end as mark
  from counted)
"""

_SKETCH = """
with call as (
  select {key}, model, {day} max(request_duration_s) as request_duration_s, max(eval_duration_s) as eval_duration_s,
    cast(max(completion_tokens) as double) as completion_tokens
  from {table} group by all),
long as (
  select *, case when x is null or isnan(x) or isinf(x) then null else cast(sign(x) as integer) end as sign from (
    select model, {day_name} 'request_duration_s' as field, request_duration_s as x from call
    union all select model, {day_name} 'eval_duration_s', eval_duration_s from call
    union all select model, {day_name} 'completion_tokens', completion_tokens from call)),
sketch as (
  select model, {day_name} field, sign, cast(case when sign = 0 then 0 when sign is not null
      then ceil(ln(abs(x)) / ln(1.01::double / 0.99::double)) end as integer) as bucket, cast(count(*) as bigint) as n
  from long group by all)
"""
_PERCENTILES = """,
bucketed as (select model, field, sign, bucket, sum(n) as n from sketch where sign is not null group by all),
placed as (
  select *, sum(n) over (partition by model, field order by sign * 10000000 + sign * bucket) as upto,
    sum(n) over (partition by model, field) as total from bucketed),
ranked as (select *, floor(1 + share * (total - 1)) as r from placed,
  (values (0.05::double), (0.25), (0.5), (0.75), (0.9), (0.95), (0.99)) as s(share))
select model, field, share, cast(printf('%.8e', sign * pow(1.01::double / 0.99::double, bucket) * (2 / (1 + 1.01::double / 0.99::double))) as double) as value,
  cast(total as bigint) as n
from ranked where upto - n < r and r <= upto
"""
_CALLS = _SKETCH.format(key="call_id", table="llm_call", day="cast(called_at as date) as day,", day_name="day,")
_RESPONSES = _SKETCH.format(key="response_id", table="llm_response", day="", day_name="")

SQL = {
    "p1_sketches": _CALLS + "select * from sketch",
    "p1_percentiles": _CALLS + _PERCENTILES,
    "p1_response_percentiles": _RESPONSES + _PERCENTILES,
    "p6_terms": _TERMS + "select * from marked",
    "p6_found": _TERMS + "select term, mark from marked where mark <> 'useful'",
}
