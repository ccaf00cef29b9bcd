"""Queries over the raw model answers: repair, parsing, validation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import answers
from quillspan.functions.text import ABSENT, field_name
from quillspan.operators.validation import allowed_of_vocabulary, light_errors
from quillspan.runtime import once, table

# The fields known to the strict parser.
KNOWN_FIELDS = (
    "model_type", "model_determinism", "pathogen_name", "pathogen_type", "disease_name", "host_species",
    "primary_population", "population_setting_type", "geographic_scope", "geographic_units", "study_dates_start",
    "study_dates_end", "historical_vs_hypothetical", "study_goal_category", "intervention_present", "intervention_types",
    "data_used", "data_source", "calibration_mentioned", "calibration_techniques", "key_outcome_measures",
    "code_available", "extraction_notes",
)
#: An answer has every field but the notes.
REQUIRED_FIELDS = KNOWN_FIELDS[:-1]


def _contents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "llm_response")
    return rows.groupBy("response_id").agg(F.max("content").alias("content"))


def _lenient(spark: SparkSession, d: str) -> DataFrame:
    return once(_contents(spark, d), "fields", answers.as_object(answers.repaired(F.col("content"))))


def _strict(spark: SparkSession, d: str) -> DataFrame:
    return once(_contents(spark, d), "fields", answers.as_object(answers.without_fence(F.col("content"))))


def parse_responses(spark: SparkSession, d: str) -> DataFrame:
    """Fields of the repaired answers: comma-joined value and reasoning."""
    fields = _lenient(spark, d).select("response_id", F.explode("fields").alias("field", "payload"))
    return fields.select(
        "response_id", "field", answers.joined_values(F.col("payload")).alias("value"),
        answers.payload_reasoning(F.col("payload")).alias("reasoning"),
    )


def parse_errors(spark: SparkSession, d: str) -> DataFrame:
    """How many answers each parser can read, and how many it cannot."""
    both = _lenient(spark, d).select("response_id", F.col("fields").isNotNull().alias("lenient")).join(
        _strict(spark, d).select("response_id", F.col("fields").isNotNull().alias("strict")), "response_id"
    )
    return both.groupBy("lenient", "strict").agg(F.count("*").alias("n"))


def parse_strict(spark: SparkSession, d: str) -> DataFrame:
    """Known fields of the strictly parsed answers and their clean values."""
    fields = _strict(spark, d).select("response_id", F.explode("fields").alias("name", "payload"))
    named = once(fields, "field", field_name(F.col("name"))).where(F.col("field").isin(*KNOWN_FIELDS))
    return named.select(
        "response_id", "field", F.posexplode(answers.clean_values(answers.payload_values(F.col("payload")))).alias("pos", "value")
    )


def validate_light(spark: SparkSession, d: str) -> DataFrame:
    """Schema errors of each readable answer against the fields of the vocabulary."""
    allowed = allowed_of_vocabulary(table(spark, d, "vocab_class"))
    return light_errors(_lenient(spark, d).where("fields is not null"), "response_id", "fields", allowed, KNOWN_FIELDS, REQUIRED_FIELDS)


def truncate_content(spark: SparkSession, d: str) -> DataFrame:
    return _contents(spark, d).select("response_id", F.substring("content", 1, 2000).alias("raw_response"), F.length("content").alias("n"))


QUERIES = {f.__name__: f for f in (parse_responses, parse_errors, parse_strict, validate_light, truncate_content)}

_OBJECT = r"""
with content as (select response_id, max(content) as content from llm_response group by 1),
body as (
  select response_id, regexp_replace(regexp_extract(content, '(?s)(\{.*\})', 1), ',\s*([}\]])', '\1', 'g') as lenient,
    regexp_replace(regexp_replace(content, '^\s+|\s+$', '', 'g'), '(?is)^```(?:json)?\s*(.*?)\s*```$', '\1') as strict
  from content),
object as (
  select response_id, case when json_valid(lenient) and json_type(lenient) = 'OBJECT' then lenient::json end as lenient,
    case when json_valid(strict) and json_type(strict) = 'OBJECT'
      and not regexp_matches(strict, ',\s*[}\]]') then strict::json end as strict from body)
"""
_KNOWN, _REQUIRED = ("[" + ", ".join(f"'{f}'" for f in fields) + "]" for fields in (KNOWN_FIELDS, REQUIRED_FIELDS))


def sql_field_name(x: str) -> str:
    for pattern in (r"^\*+", r"\*+$", "^_+", "_+$", r"^#+\s*"):
        x = f"regexp_replace({x}, '{pattern}', '')"
    return rf"translate(lower(regexp_replace({x}, '^\s+|\s+$', '', 'g')), ' -', '__')"


def sql_absent(x: str) -> str:
    known = " ".join(f"when '{a}' then '{b}'" for a, b in ABSENT.items())
    return f"case lower({x}) {known} else {x} end"


SQL = {
    "field_names": _OBJECT
    + f"select distinct je.key as name, {sql_field_name('je.key')} as plain from object, json_each(lenient) je where lenient is not null",
    "parse_strict": _OBJECT
    + rf""", payload as (
  select response_id, {sql_field_name('je.key')} as field,
    case when json_type(je.value) = 'OBJECT' then json_extract(je.value, '$.values') else je.value end as raw
  from object, json_each(strict) je where strict is not null),
listed as (
  select response_id, field, list_filter(list_transform(
      case when json_type(raw) = 'ARRAY' then list_transform(cast(raw as json[]), lambda v: json_extract_string(v, '$')) else [json_extract_string(raw, '$')] end,
      lambda v: regexp_replace(v, '^\s+|\s+$', '', 'g')), lambda v: v is not null and v <> '') as held
  from payload where list_contains({_KNOWN}, field) and raw is not null)
select response_id, field, cast(i - 1 as integer) as pos, {sql_absent('held[i]')} as value
from listed, unnest(range(1, len(held) + 1)) as u(i)""",
    "validate_light": _OBJECT
    + rf""", allowed as (
  select distinct schema_field as field, term as value from (
    select schema_field, label as term from vocab_class union all select schema_field, unnest(alt_terms) from vocab_class)
  where regexp_matches(term, '\S') and schema_field <> ''),
payload as (select response_id, je.key as field, je.value as p from object, json_each(lenient) je where lenient is not null),
known as (select * from payload where list_contains({_KNOWN}, field)),
inside as (select *, json_extract(p, '$.values') as v, json_extract(p, '$.reasoning') as r, json_keys(p) as keys from known where json_type(p) = 'OBJECT'),
held as (
  select response_id, field, unnest(list_transform(cast(v as json[]), lambda x: json_extract_string(x, '$'))) as value from inside where json_type(v) = 'ARRAY')
select response_id, 'missing' as error, f as field, '' as detail from object, unnest({_REQUIRED}) as u(f)
where lenient is not null and not list_contains(json_keys(lenient), f)
union all select response_id, 'unexpected', field, '' from payload where not list_contains({_KNOWN}, field)
union all select response_id, 'not_object', field, '' from known where json_type(p) <> 'OBJECT'
union all select response_id, 'missing_key', field, k from inside, (values ('values'), ('reasoning')) as w(k) where not list_contains(keys, k)
union all select response_id, 'values_not_list', field, '' from inside where coalesce(json_type(v), '') <> 'ARRAY'
union all select response_id, 'reasoning_not_text', field, '' from inside where json_type(r) not in ('VARCHAR', 'NULL')
union all select response_id, 'unsupported', field, value from held
where value is not null and field in (select field from allowed)
  and not exists (select 1 from allowed a where a.field = held.field and a.value = held.value)""",
    "parse_errors": _OBJECT
    + "select lenient is not null as lenient, strict is not null as strict, cast(count(*) as bigint) as n from object group by all",
    "parse_responses": _OBJECT
    + r"""select response_id, je.key as field,
  case when json_type(je.value) <> 'OBJECT' then json_extract_string(je.value, '$')
    else array_to_string(list_transform(cast(json_extract(je.value, '$.values') as json[]), lambda v: coalesce(json_extract_string(v, '$'), 'None')), ', ') end as value,
  case when json_type(je.value) = 'OBJECT' then regexp_replace(json_extract_string(je.value, '$.reasoning'), '^\s+|\s+$', '', 'g') end as reasoning
from object, json_each(lenient) je where lenient is not null""",
    "truncate_content": """select response_id, left(max(content), 2000) as raw_response, cast(length(max(content)) as integer) as n
from llm_response group by 1""",
}
