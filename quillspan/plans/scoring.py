"""Queries that score the extractions of the model responses against the gold standard."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions import answers
from quillspan.functions.dates import MONTHS, month_of
from quillspan.functions.text import ABSENT, absent, field_name, split_values, without_annotations
from quillspan.operators import matching, vocabulary
from quillspan.runtime import cut, once, table


def responses(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "llm_response").select("response_id", "abstract_id", "model").distinct()
    return rows.select(F.col("response_id").alias("item_id"), "abstract_id", F.coalesce("model", F.lit("")).alias("model"))


def gold_fields(spark: SparkSession, d: str) -> DataFrame:
    """``abstract_id, attribute, values`` of each gold field."""
    rows = table(spark, d, "abstract_item").select("abstract_id", "expected").distinct()
    fields = rows.select("abstract_id", F.explode(answers.as_object(F.col("expected"))).alias("attribute", "gold"))
    return once(fields, "values", answers.gold_values(F.col("gold"))).select("abstract_id", "attribute", "values")


def cells(spark: SparkSession, d: str, items: DataFrame | None = None) -> DataFrame:
    """``item_id, model, attribute, cell``: the extracted values of a field, comma-joined."""
    rows = table(spark, d, "extraction").where("value_list is not null").select("extraction_id", "response_id", "attr_name", "value_list")
    joined = rows.distinct().select(
        F.col("response_id").alias("item_id"), F.col("attr_name").alias("attribute"), F.array_join("value_list", ", ").alias("cell")
    )
    items = responses(spark, d) if items is None else items
    return joined.join(items.select("item_id", "model"), "item_id")


def synonyms(spark: SparkSession, d: str) -> DataFrame:
    """Terms of the disease vocabulary and their labels."""
    rows = table(spark, d, "vocab_class").where("schema_field = 'disease_name'").withColumn("field", F.lit("disease_name"))
    return vocabulary.all_terms(rows).join(rows.select("iri", F.lower("label").alias("canonical")), "iri").select("term", "canonical")


def long_forms(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Extracted long, gold long and the gold attributes, all by response."""
    known = cut(synonyms(spark, d))  # a vocabulary: written before its size is checked twice
    items = cut(responses(spark, d))
    gold = gold_fields(spark, d).join(items.select("item_id", "abstract_id"), "abstract_id")
    # read several times by outcomes and scores: written once instead of being made again
    return cut(matching.extracted_long(cells(spark, d, items), known)), cut(matching.gold_long(gold, known)), gold


def answered(spark: SparkSession, d: str) -> DataFrame:
    """``item_id, model`` of the responses that are scored, with or without any value.

    These are the answers that can be read as an object with fields, and those of which
    fields were parsed. Unreadable and empty answers are errors, which the source does not score.
    """
    rows = table(spark, d, "llm_response")
    # answers are read where they are: what moves are the numbers of those that can be
    readable = rows.where(F.size(answers.as_object(answers.repaired(F.col("content")))) > 0).select("response_id")
    parsed = table(spark, d, "extraction").select("response_id")
    known = readable.unionByName(parsed).withColumnRenamed("response_id", "item_id").distinct()
    return cut(responses(spark, d).join(known, "item_id", "left_semi").select("item_id", "model"))


def events(spark: SparkSession, d: str) -> DataFrame:
    extracted, gold, fields = long_forms(spark, d)
    return matching.outcomes(extracted, gold, fields, answered=answered(spark, d))


def _scores(spark: SparkSession, d: str, keys: tuple[str, ...]) -> DataFrame:
    extracted, gold, fields = long_forms(spark, d)
    seen = answered(spark, d)
    expected = gold.groupBy("item_id").agg(F.count("*").alias("total_expected"))
    totals = seen.join(expected, "item_id", "left").na.fill({"total_expected": 0})
    found = matching.scores(matching.outcomes(extracted, gold, fields, answered=seen), totals, keys)
    return found.select(*keys, "hits", "misses", "fps", "total_expected", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "f1")])


def score_models(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, ("model",))


def score_items(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d, ("item_id", "model"))


def hits_detail(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("outcome = 'hit'").drop("outcome")


def misses(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("outcome = 'miss'").select("item_id", "model", "attribute", "pos", "value")


def false_positives(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("outcome = 'false_positive'").select("item_id", "model", "attribute", "pos", "value")


def not_expected(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).where("outcome = 'not_expected'").select("item_id", "model", "attribute", "pos", "value")


def event_table(spark: SparkSession, d: str) -> DataFrame:
    return matching.event_table(events(spark, d))


def events_by_attribute(spark: SparkSession, d: str) -> DataFrame:
    counted = events(spark, d).groupBy("model", "attribute").agg(
        *[F.count_if(F.col("outcome") == o).alias(o) for o in ("hit", "miss", "false_positive", "not_expected")]
    )
    return counted.orderBy("model", "attribute")


def coerce_gold(spark: SparkSession, d: str) -> DataFrame:
    return gold_fields(spark, d).select("abstract_id", "attribute", F.posexplode("values").alias("pos", "value"))


def split_cells(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark, d).select("item_id", "attribute", F.posexplode(split_values(F.col("cell"))).alias("pos", "value"))


def normalize_terms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct extracted values with their synonym-unified and absent-unified forms."""
    from quillspan.operators.lookups import canonical

    raw = cells(spark, d).select(F.explode(split_values(F.col("cell"))).alias("raw")).where("raw <> ''").distinct()
    unified = canonical(raw.withColumn("value", F.col("raw")), "value", synonyms(spark, d))
    return unified.withColumn("absent", absent(F.col("value")))


def strip_annotations(spark: SparkSession, d: str) -> DataFrame:
    found = coerce_gold(spark, d).select("value").distinct()
    return found.select("value", without_annotations(F.col("value")).alias("stripped"))


def date_forms(spark: SparkSession, d: str) -> DataFrame:
    """Distinct study dates and order dates in words, and their month forms."""
    dates = cells(spark, d).where(F.col("attribute").isin(*matching.DATE_ATTRIBUTES)).select(F.col("cell").alias("text"))
    written = table(spark, d, "orders").select(
        F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "MMMM yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-M-d")).alias("text")
    )
    return dates.unionByName(written).distinct().select("text", month_of(F.col("text")).alias("month"))


def field_names(spark: SparkSession, d: str) -> DataFrame:
    """Distinct field names of the answers and their plain form."""
    objects = table(spark, d, "llm_response").select(F.explode(answers.as_object(answers.repaired(F.col("content")))).alias("name", "_"))
    return objects.select("name").distinct().select("name", field_name(F.col("name")).alias("plain"))


QUERIES = {
    f.__name__: f
    for f in (
        score_models, score_items, hits_detail, misses, false_positives, not_expected, event_table,
        events_by_attribute, coerce_gold, split_cells, normalize_terms, strip_annotations, date_forms, field_names,
    )
}


def sql_strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sql_loose(x: str) -> str:
    return f"translate({sql_strip(f'lower({x})')}, '-_', '  ')"


def sql_month(x: str) -> str:
    text = sql_strip("replace(" + sql_strip(f"lower({x})") + ", '**', '')")
    year = rf"regexp_extract({text}, '([0-9]{{4}})', 1)"
    month = reduce(lambda rest, m: f"case when contains({text}, '{m[0]}') then '{m[1]}' else {rest} end", reversed(MONTHS), "null")
    numeric = r"'^([0-9]{4})-([0-9]{1,2})(?:-[0-9]{1,2})?$'"
    return (
        f"case when {month} is not null and {year} <> '' then {year} || '-' || {month} "
        f"when regexp_matches({text}, {numeric}) then regexp_extract({text}, {numeric}, 1) || '-' || "
        f"lpad(regexp_extract({text}, {numeric}, 2), 2, '0') else {text} end"
    )


_ABSENT = "case lower({s}) " + " ".join(f"when '{a}' then '{b}'" for a, b in ABSENT.items()) + " else {x} end"


def sql_absent(x: str) -> str:
    return _ABSENT.format(s=sql_strip(x), x=x)


_BASE = rf"""
with response as (select distinct response_id as item_id, abstract_id, coalesce(model, '') as model from llm_response),
-- the answers that are scored: those that can be read as an object with fields, and those of which fields were parsed
repaired as (
  select response_id, try_cast(regexp_replace(regexp_extract(max(content), '(?s)(\{{.*\}})', 1), ',\s*([}}\]])', '\1', 'g') as json) as body
  from llm_response group by 1),
answered as (
  select item_id, model from response where item_id in (
    select response_id from repaired where json_type(body) = 'OBJECT' and len(json_keys(body)) > 0
    union select response_id from extraction)),
field as (
  select abstract_id, je.key as attribute, je.value as g
  from (select distinct abstract_id, expected from abstract_item) a, json_each(a.expected::json) je),
gold_value as (
  select abstract_id, attribute, 0 as i, 0 as j, json_extract_string(g, '$') as v from field where json_type(g) = 'VARCHAR'
  union all
  select abstract_id, attribute, cast(m.key as integer), 0, {sql_strip("json_extract_string(m.value, '$')")} from field, json_each(g) m
  where json_type(g) = 'ARRAY' and json_type(m.value) = 'VARCHAR' and {sql_strip("json_extract_string(m.value, '$')")} <> ''
  union all
  select abstract_id, attribute, cast(m.key as integer), 0, json_extract_string(m.value, '$.value') from field, json_each(g) m
  where json_type(g) = 'ARRAY' and json_type(m.value) = 'OBJECT' and {sql_strip("json_extract_string(m.value, '$.value')")} <> ''
  union all
  select abstract_id, attribute, cast(m.key as integer), cast(w.key as integer), json_extract_string(w.value, '$')
  from field, json_each(g) m, json_each(m.value, '$.values') w
  where json_type(g) = 'ARRAY' and json_type(m.value) = 'OBJECT' and {sql_strip("json_extract_string(w.value, '$')")} <> ''
  union all
  select abstract_id, attribute, 0, 0, json_extract_string(g, '$.value') from field
  where json_type(g) = 'OBJECT' and json_type(g, '$.values') is null and {sql_strip("json_extract_string(g, '$.value')")} <> ''
  union all
  select abstract_id, attribute, 0, cast(w.key as integer), json_extract_string(w.value, '$') from field, json_each(g, '$.values') w
  where json_type(g) = 'OBJECT' and json_extract_string(w.value, '$') <> ''),
coerced as (
  select abstract_id, attribute, cast(row_number() over (partition by abstract_id, attribute order by i, j) - 1 as integer) as pos, v as value
  from gold_value),
disease as (
  select lower({sql_strip('term')}) as term, min(canonical) as canonical from (
    select label as term, lower(label) as canonical from vocab_class where schema_field = 'disease_name'
    union all select unnest(alt_terms), lower(label) from vocab_class where schema_field = 'disease_name')
  where {sql_strip('term')} <> '' group by 1),
gold as (
  select r.item_id, c.attribute, c.pos, {sql_strip(r"regexp_replace(c.value, '\s*\((?:inferred|not mentioned)\)', '', 'g')")} as stripped
  from coerced c join response r using (abstract_id)),
gold_long as (
  select item_id, attribute, pos, stripped, coalesce(s.canonical, stripped) as value
  from gold left join disease s on s.term = lower({sql_strip('stripped')})),
cell as (
  select e.response_id as item_id, r.model, e.attr_name as attribute, array_to_string(e.value_list, ', ') as cell
  from (select distinct extraction_id, response_id, attr_name, value_list from extraction) e
  join response r on r.item_id = e.response_id where e.value_list is not null),
token as (
  select item_id, model, attribute, cast(i - 1 as integer) as pos, {sql_strip("string_split(cell, ',')[i]")} as value
  from cell, unnest(range(1, len(string_split(cell, ',')) + 1)) as u(i)),
extracted as (
  select item_id, model, attribute, pos, {sql_absent('coalesce(s.canonical, t.value)')} as value
  from token t left join disease s on s.term = lower({sql_strip('t.value')}) where t.value <> ''),
expected as (select e.* from extracted e where exists (select 1 from gold_long g where g.item_id = e.item_id and g.attribute = e.attribute)),
pair as (
  select e.item_id, e.model, e.attribute, e.pos, e.value, g.pos as gpos, g.value as gvalue,
    {sql_loose('e.value')} as a, {sql_loose('g.value')} as b
  from expected e join gold_long g on e.item_id = g.item_id and e.attribute = g.attribute),
hit as (
  select item_id, model, attribute, pos, value, arg_min(gvalue, gpos) as matched from pair
  where a = b or (length(a) >= 3 and length(b) >= 3 and (contains(a, b) or contains(b, a))) or {sql_month('value')} = {sql_month('gvalue')}
  group by all),
event as (
  select item_id, model, attribute, pos, 'hit' as outcome, value, matched, 'string' as method from hit
  union all
  select item_id, model, attribute, pos, 'false_positive', value, null, null from expected e
  where not exists (select 1 from hit h where h.item_id = e.item_id and h.attribute = e.attribute and h.pos = e.pos)
  union all
  select item_id, model, attribute, pos, 'not_expected', value, null, null from extracted e
  where not exists (select 1 from field f join response r using (abstract_id) where r.item_id = e.item_id and f.attribute = e.attribute)
  union all
  select g.item_id, x.model, g.attribute, g.pos, 'miss', g.stripped, null, null
  from gold_long g join answered x using (item_id)
  where not exists (select 1 from hit h where h.item_id = g.item_id and h.attribute = g.attribute and h.matched = g.value)),
per_item as (
  select x.item_id, x.model, coalesce(h.hits, 0) as hits, coalesce(h.misses, 0) as misses, coalesce(h.fps, 0) as fps, coalesce(t.n, 0) as total_expected
  from answered x
  left join (select item_id, count(*) filter (outcome = 'hit') as hits, count(*) filter (outcome = 'miss') as misses,
      count(*) filter (outcome = 'false_positive') as fps from event group by 1) h using (item_id)
  left join (select item_id, count(*) as n from gold group by 1) t using (item_id))
"""


def _score_sql(keys: str) -> str:
    return (
        _BASE
        + f""", summed as (
  select {keys}, cast(sum(hits) as bigint) as hits, cast(sum(misses) as bigint) as misses, cast(sum(fps) as bigint) as fps,
    cast(sum(total_expected) as bigint) as total_expected from per_item group by all),
rated as (
  select *, case when total_expected > 0 then hits / total_expected else 0.0 end as r, case when hits + fps > 0 then hits / (hits + fps) else 0.0 end as p
  from summed)
select {keys}, hits, misses, fps, total_expected, round(r, 6) as recall, round(p, 6) as precision,
  round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as f1 from rated"""
    )


SQL = {
    "score_models": _score_sql("model"),
    "score_items": _score_sql("item_id, model"),
    "hits_detail": _BASE + "select item_id, model, attribute, pos, value, matched, method from event where outcome = 'hit'",
    "misses": _BASE + "select item_id, model, attribute, pos, value from event where outcome = 'miss'",
    "false_positives": _BASE + "select item_id, model, attribute, pos, value from event where outcome = 'false_positive'",
    "not_expected": _BASE + "select item_id, model, attribute, pos, value from event where outcome = 'not_expected'",
    "event_table": _BASE
    + """select item_id, model, attribute, case outcome when 'hit' then 'Hit' when 'miss' then 'Miss' else 'False Positive' end as result,
  value, matched, method, pos from event where outcome <> 'not_expected'""",
    "events_by_attribute": _BASE
    + """select model, attribute, cast(count(*) filter (outcome = 'hit') as bigint) as hit, cast(count(*) filter (outcome = 'miss') as bigint) as miss,
  cast(count(*) filter (outcome = 'false_positive') as bigint) as false_positive,
  cast(count(*) filter (outcome = 'not_expected') as bigint) as not_expected from event group by all""",
    "coerce_gold": _BASE + "select abstract_id, attribute, pos, value from coerced",
    "split_cells": _BASE + "select item_id, attribute, pos, value from token",
    "normalize_terms": _BASE
    + f"""select raw, value, {sql_absent('value')} as absent from (
  select distinct t.value as raw, coalesce(s.canonical, t.value) as value
  from token t left join disease s on s.term = lower({sql_strip('t.value')}) where t.value <> '')""",
    "strip_annotations": _BASE
    + rf"""select distinct value, {sql_strip(r"regexp_replace(value, '\s*\((?:inferred|not mentioned)\)', '', 'g')")} as stripped from coerced""",
    "date_forms": _BASE
    + f"""select text, {sql_month('text')} as month from (
  select distinct cell as text from cell where attribute in ('study_dates_start', 'study_dates_end')
  union
  select distinct case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%B %Y') else strftime(o_orderdate, '%Y-%-m-%-d') end from orders)""",
}
