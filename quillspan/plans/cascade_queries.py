"""Queries of the full cascade, the reports and the prompts, over the model responses."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators import matching, similarity
from quillspan.operators.cascade import KEYS, cascade, judge_prompt
from quillspan.plans import reports, scoring
from quillspan.plans.prompts import extraction_prompt
from quillspan.runtime import cut, table

INSTRUCTIONS = "Extract the requested fields from the abstract as JSON.\nGive values and a short reasoning for each."


class NgramEncoder:
    """Hashed character trigrams as unit vectors: an encoder without a model."""

    def __init__(self, size: int = 128):
        self.size = size

    def encode(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.size))
        for i, text in enumerate(texts):
            c = np.array([ord(x) for x in f"  {text.lower()} "])
            out[i] = np.bincount((c[:-2] * 961 + c[1:-1] * 31 + c[2:]) % self.size, minlength=self.size)
        return (out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)).tolist()


class WordJudge:
    """A judge without a model: values match if they share half of their words."""

    def judge(self, prompt: str) -> str:
        _, _, first, second, _ = prompt.split("\n")
        value = set(json.loads(first.split(": ", 1)[1]).lower().split())
        expected = [set(e.lower().split()) for e in json.loads(second.split(": ", 1)[1])]
        shared = max((len(value & e) / max(1, len(value | e)) for e in expected), default=0)
        return "MATCH" if shared >= 0.5 else "NO_MATCH"


def _cascade(spark: SparkSession, d: str) -> DataFrame:
    extracted, gold, fields = scoring.long_forms(spark, d)
    texts = extracted.select("value").unionByName(gold.select("value"))
    vectors = cut(similarity.encoded(texts, "value", NgramEncoder)).select(
        F.col("value").alias("text"), F.lit("trigram").alias("encoder"), "vector"
    )
    pairs = similarity.candidate_pairs(extracted, gold, vectors).withColumn("score", F.round("score", 9))
    best = similarity.best_candidate(pairs, (*KEYS, "encoder"), "score", "gold_pos", "gold_value")
    decided = similarity.ensemble(similarity.decided(best).withColumn("place", F.lit(0)), KEYS, "place")
    return cascade(extracted, gold, fields, decided, WordJudge, answered=scoring.answered(spark, d))


def cascade_events(spark: SparkSession, d: str) -> DataFrame:
    """Events of the cascade with a model-free encoder and judge."""
    return _cascade(spark, d)


def cascade_methods(spark: SparkSession, d: str) -> DataFrame:
    """How many hits each tier made, by model."""
    hits = _cascade(spark, d).where("outcome = 'hit'")
    return hits.groupBy("model", "method").agg(F.count("*").alias("n"))


def report_text(spark: SparkSession, d: str) -> DataFrame:
    found = scoring.events(spark, d)
    return reports.report_lines(found, scoring.score_items(spark, d))


def report_html(spark: SparkSession, d: str) -> DataFrame:
    return reports.html_rows(matching.event_table(scoring.events(spark, d)))


def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    return reports.model_comparison(scoring.events(spark, d), scoring.responses(spark, d))


def model_answers(spark: SparkSession, d: str) -> DataFrame:
    """What each model answered on an abstract's attribute, as one line."""
    return reports.answer_lines(scoring.events(spark, d), scoring.responses(spark, d))


def report_summary(spark: SparkSession, d: str) -> DataFrame:
    """The overall table of a run: responses, counts and micro-averages by model."""
    return reports.summary(scoring.score_items(spark, d))


def extraction_prompts(spark: SparkSession, d: str) -> DataFrame:
    items = table(spark, d, "abstract_item").groupBy("abstract_id").agg(F.max("abstract").alias("abstract"))
    return items.select("abstract_id", extraction_prompt([INSTRUCTIONS], F.coalesce("abstract", F.lit(""))).alias("prompt"))


def judge_prompts(spark: SparkSession, d: str) -> DataFrame:
    """Expected values of each item's attribute as the judge is shown them."""
    gold = scoring.gold_fields(spark, d).where(F.size("values") > 0)
    listed = F.array_join(F.transform("values", lambda v: F.concat(F.lit('"'), v, F.lit('"'))), ", ")
    return gold.select("abstract_id", "attribute", listed.alias("expected"))


def judge_requests(spark: SparkSession, d: str) -> DataFrame:
    """The whole prompt for every extracted value that has gold values to be judged against."""
    extracted, gold, _ = scoring.long_forms(spark, d)
    expected = gold.groupBy("item_id", "attribute").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("_g"))  # one field's
    asked = extracted.join(expected, ["item_id", "attribute"])
    prompt = judge_prompt(F.col("attribute"), F.col("value"), F.transform("_g", lambda x: x.value))
    return asked.select("item_id", "model", "attribute", "pos", prompt.alias("prompt"))


QUERIES = {
    f.__name__: f
    for f in (cascade_events, cascade_methods, report_text, report_html, report_summary, model_comparison, model_answers, extraction_prompts, judge_prompts, judge_requests)
}
_CASCADE = (
    scoring._BASE
    + f""", texts as (select value as t from extracted union select value from gold_long),
padded as (select t, '  ' || lower(t) || ' ' as p from texts),
bucket as (
  select t, list_transform(range(1, length(p) - 1),
    lambda i: (ord(substr(p, i, 1)) * 961 + ord(substr(p, i + 1, 1)) * 31 + ord(substr(p, i + 2, 1))) % 128) as b from padded),
vec as (select t, list_transform(range(0, 128), lambda k: cast(len(list_filter(b, lambda x: x = k)) as double)) as v from bucket),
scored as (
  select e.item_id, e.model, e.attribute, e.pos, g.pos as gpos, g.value as gvalue,
    round(greatest(0, least(1, list_cosine_similarity(a.v, c.v))), 9) as s
  from expected e join gold_long g on e.item_id = g.item_id and e.attribute = g.attribute join vec a on a.t = e.value join vec c on c.t = g.value
  where e.attribute not in ('study_dates_start', 'study_dates_end')),
best as (
  select item_id, model, attribute, pos, arg_max(gvalue, struct_pack(s := s, p := -gpos)) as best, max(s) as s from scored group by all),
wanted as (select item_id, attribute, arg_min(value, pos) as first, list(value order by pos) as listed from gold_long group by all),
tier as (
  select e.*, b.s, w.first, w.listed, case when b.s >= 0.85 then b.best when b.s <= 0.5 and {scoring.sql_month('e.value')} = {scoring.sql_month('w.first')} then w.first end as named,
    case when b.s >= 0.85 then 'vector' else 'date_format' end as method
  from expected e join wanted w using (item_id, attribute) left join best b using (item_id, model, attribute, pos)),
worded as (
  select *, list_distinct(list_filter(regexp_split_to_array(lower(value), '\\s+'), lambda w: w <> '')) as words,
    list_transform(listed, lambda x: list_distinct(list_filter(regexp_split_to_array(lower(x), '\\s+'), lambda w: w <> ''))) as others
  from tier where named is null and (s is null or (s > 0.5 and s < 0.85))),
judged as (
  select item_id, model, attribute, pos, value, coalesce(list_filter(listed, lambda x: contains(lower(value), lower(x)) or contains(lower(x), lower(value)))[1], listed[1]) as named
  from worded where list_max(list_transform(others, lambda o: len(list_intersect(words, o)) / greatest(1, len(list_distinct(list_concat(words, o)))))) >= 0.5),
decided as (
  select item_id, model, attribute, pos, value, named as matched, method from tier where named is not null
  union all select item_id, model, attribute, pos, value, named, 'llm' from judged),
met as (
  select * from decided
  union all select item_id, model, attribute, pos, value, matched, 'string' from hit h
  where not exists (select 1 from decided x where x.item_id = h.item_id and x.attribute = h.attribute and x.pos = h.pos)),
outcome as (
  select item_id, model, attribute, pos, 'hit' as outcome, value, matched, method from met
  union all select item_id, model, attribute, pos, 'false_positive', value, null, null from expected e
  where not exists (select 1 from met h where h.item_id = e.item_id and h.attribute = e.attribute and h.pos = e.pos)
  union all select item_id, model, attribute, pos, outcome, value, matched, method from event where outcome = 'not_expected'
  union all select g.item_id, x.model, g.attribute, g.pos, 'miss', g.stripped, null, null from gold_long g join answered x using (item_id)
  where not exists (select 1 from met h where h.item_id = g.item_id and h.attribute = g.attribute and h.matched = g.value))
"""
)
SQL = {
    "cascade_events": _CASCADE + "select item_id, model, attribute, pos, outcome, value, matched, method from outcome",
    "cascade_methods": _CASCADE + "select model, method, cast(count(*) as bigint) as n from outcome where outcome = 'hit' group by all",
    "judge_requests": scoring._BASE
    + """, wanted as (select item_id, attribute, list(value order by pos) as listed from gold_long group by all)
select item_id, model, attribute, pos, concat_ws(chr(10), 'Two annotators read the same abstract. Do they name the same thing?',
  'Attribute: ' || attribute, 'First value: ' || cast(to_json(value) as varchar), 'Second values: ' || cast(to_json(listed) as varchar),
  'Answer with one word, MATCH if the first names any of the second''s, otherwise NO_MATCH.') as prompt
from extracted join wanted using (item_id, attribute)""",
    "report_text": scoring._BASE
    + """, rated as (
  select *, case when total_expected > 0 then hits / total_expected else 0.0 end as r, case when hits + fps > 0 then hits / (hits + fps) else 0.0 end as p
  from per_item),
head as (select *, round(r, 6) as recall, round(p, 6) as precision, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as f1 from rated)
select model, item_id, 0 as section, '' as place,
  printf('%s | %s: %d hits, %d misses, %d false positives of %d expected; recall %.2f%%, precision %.2f%%, F1 %.2f%%', cast(item_id as varchar), model,
    cast(hits as bigint), cast(misses as bigint), cast(fps as bigint), cast(total_expected as bigint), round(recall * 100, 2), round(precision * 100, 2), round(f1 * 100, 2)) as line
from head
union all
select model, item_id, case outcome when 'hit' then 1 when 'miss' then 2 else 3 end, attribute || '/' || lpad(cast(pos as varchar), 6, '0'),
  '  [' || attribute || '] ' || case outcome when 'hit' then value || ' = ' || matched || ' (' || method || ')' else value end
from event where outcome <> 'not_expected'""",
    "extraction_prompts": "select abstract_id, '"
    + INSTRUCTIONS.replace("'", "''")
    + "' || chr(10) || chr(10) || coalesce(max(abstract), '') as prompt from abstract_item group by 1",
    "judge_prompts": scoring._BASE
    + """select abstract_id, attribute, string_agg('"' || value || '"', ', ' order by pos) as expected from coerced group by all""",
    "report_html": scoring._BASE
    + """, shown as (
  select item_id, model, attribute, case outcome when 'hit' then 'Hit' when 'miss' then 'Miss' else 'False Positive' end as result, value, matched
  from event where outcome <> 'not_expected')
select model, item_id, attribute, result, '<tr>' || array_to_string(list_transform(
  [cast(item_id as varchar), attribute, result, value, coalesce(matched, '')],
  lambda x: '<td>' || replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') || '</td>'), '') || '</tr>' as html
from shown""",
    "model_comparison": scoring._BASE
    + """select r.abstract_id, e.attribute, cast(count(distinct e.model) as integer) as models,
  list(struct_pack(model := e.model, item_id := e.item_id, pos := e.pos, value := e.value, outcome := e.outcome)
    order by e.model, e.item_id, e.pos) as answers
from event e join response r using (item_id) where e.outcome <> 'miss' and r.abstract_id is not null group by all""",
    "model_answers": scoring._BASE
    + """select r.abstract_id, e.attribute, e.model, string_agg(e.value || ' [' || e.outcome || ']', '; ' order by e.item_id, e.pos) as answer
from event e join response r using (item_id) where e.outcome <> 'miss' and r.abstract_id is not null group by all""",
    "report_summary": scoring._score_sql("model").replace("select model, hits,", "select model, responses, hits,").replace(
        "summed as (\n  select model,", "summed as (\n  select model, cast(count(*) as bigint) as responses,"
    ),
}
