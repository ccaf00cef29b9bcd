"""Queries over the call log and the plain tables: rollups, listings, text forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.text import html_escaped, safe_name, seconds_text, shortened
from quillspan.operators.timing import rollup
from quillspan.runtime import table

DURATIONS = ("request_duration_s", "total_duration_s", "load_duration_s", "prompt_eval_duration_s", "eval_duration_s")
TOKENS = ("prompt_tokens", "completion_tokens", "reasoning_tokens")


def _calls(spark: SparkSession, d: str) -> DataFrame:
    """Calls with their durations and counts; durations below 0 or above 100,000 s and negative
    counts are sentinels or stray units and null."""
    rows = table(spark, d, "llm_call").select("call_id", "model", "abstract_id", "constrained", *DURATIONS, *TOKENS).distinct()
    good = [F.when(F.col(c).between(0, 100_000), F.col(c)).cast("decimal(18,6)").alias(c) for c in DURATIONS]
    return rows.select("call_id", "model", "abstract_id", "constrained", *good, *[F.when(F.col(c) >= 0, F.col(c)).alias(c) for c in TOKENS])


def timing_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Total, count and average of each duration and the token sums, by model."""
    return rollup(_calls(spark, d), ("model",), DURATIONS, TOKENS)


def drop_errors(spark: SparkSession, d: str) -> DataFrame:
    """Events that are no errors, by user."""
    rows = table(spark, d, "events").where("event_type <> 'error'")
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,6)")).cast("double").alias("total"))


def props_json(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events")
    return rows.select("event_id", F.from_json("props", "k int").getField("k").alias("k"))


def list_items(spark: SparkSession, d: str) -> DataFrame:
    """Id and shortened title of every item."""
    rows = table(spark, d, "abstract_item").select("abstract_id", "title").distinct()
    return rows.select("abstract_id", shortened(F.coalesce("title", F.lit("")), 60).alias("title"))


def filter_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Responses to the items of one run: the filter is pushed to the scan of the calls."""
    calls = table(spark, d, "llm_call").where("run_label = 'nightly-smoke' and not constrained")
    wanted = calls.select("abstract_id").distinct()
    rows = table(spark, d, "llm_response").select("response_id", "abstract_id").distinct()
    return rows.join(wanted, "abstract_id", "left_semi")


def limit_items(spark: SparkSession, d: str) -> DataFrame:
    """The twenty most called items; the limit is the report's."""
    calls = table(spark, d, "llm_call").where("abstract_id is not null").select("call_id", "abstract_id").distinct()
    return calls.groupBy("abstract_id").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "abstract_id").limit(20)


def sanitize_names(spark: SparkSession, d: str) -> DataFrame:
    """Folder names of models and runs."""
    names = table(spark, d, "llm_call").select(F.explode(F.array("model", "run_label", "abstract_id")).alias("name"))
    return names.where("name is not null").distinct().select("name", safe_name(F.concat(F.lit("org/"), "name")).alias("folder"))


def html_escape(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(html_escaped(F.col("text"))).alias("escaped_md5"))


def duration_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _calls(spark, d).select("call_id", F.round("request_duration_s", 1).cast("double").alias("s"))
    return rows.select("call_id", seconds_text(F.col("s")).alias("shown"))


def truncate_text(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.substring("text", 1, 80).alias("head"), F.length("text").alias("n"))


QUERIES = {
    f.__name__: f
    for f in (timing_rollup, drop_errors, props_json, list_items, filter_by_id, limit_items, sanitize_names, html_escape,
              duration_text, truncate_text)
}

_CALLS = (
    "with c as (select distinct call_id, model, abstract_id, constrained, "
    + ", ".join(f"cast(case when {c} between 0 and 100000 then {c} end as decimal(18, 6)) as {c}" for c in DURATIONS)
    + ", "
    + ", ".join(f"case when {c} >= 0 then {c} end as {c}" for c in TOKENS)
    + " from llm_call)\n"
)
SQL = {
    "timing_rollup": _CALLS
    + "select model, cast(count(*) as bigint) as calls, "
    + ", ".join(f"cast(sum({c}) as double) as {c}_total, cast(count({c}) as bigint) as {c}_n, cast(sum({c}) as double) / nullif(count({c}), 0) as {c}_avg" for c in DURATIONS)
    + ", "
    + ", ".join(f"cast(coalesce(sum({c}), 0) as bigint) as {c}" for c in TOKENS)
    + " from c group by model",
    "drop_errors": "select user_id, cast(count(*) as bigint) as n, cast(sum(cast(value as decimal(18, 6))) as double) as total from events where event_type <> 'error' group by 1",
    "props_json": "select event_id, cast(json_extract(props, '$.k') as integer) as k from events",
    "list_items": "select distinct abstract_id, left(coalesce(title, ''), 60) || '...' as title from abstract_item",
    "filter_by_id": """select distinct response_id, abstract_id from llm_response where abstract_id in (
  select abstract_id from llm_call where run_label = 'nightly-smoke' and not constrained)""",
    "limit_items": """select abstract_id, cast(count(distinct call_id) as bigint) as n from llm_call where abstract_id is not null
group by 1 order by n desc, abstract_id limit 20""",
    "sanitize_names": r"""select distinct name, coalesce(nullif(regexp_replace(regexp_replace(name, '[^A-Za-z0-9._-]+', '-', 'g'), '^[._-]+|[._-]+$', '', 'g'), ''), 'unknown-model') as folder
from (select unnest([model, run_label, abstract_id]) as name from llm_call) where name is not null""",
    "html_escape": """select doc_id, md5(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;')) as escaped_md5 from documents""",
    "duration_text": _CALLS + "select call_id, coalesce(printf('%.2fs', cast(round(request_duration_s, 1) as double)), 'n/a') as shown from c",
    "truncate_text": "select doc_id, left(text, 80) as head, cast(length(text) as integer) as n from documents",
}
