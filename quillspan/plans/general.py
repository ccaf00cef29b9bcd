"""Queries of the general operators: hierarchies, faulty records, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.operators.hierarchy import descendants, hierarchy
from quillspan.operators.packed import split_packed
from quillspan.operators.records import RESPONSE_EXPORT, faulty, parse_records, sound
from quillspan.runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy(table(spark, d, "ontology_class"), with_path=False, with_cycles=False)
    return tree.select(F.col("node").alias("iri"), F.col("root").alias("root_iri"), F.col("depth").alias("node_depth"))


def p3_paths(spark: SparkSession, d: str) -> DataFrame:
    tree = hierarchy(table(spark, d, "ontology_class"))
    return tree.select(
        F.col("node").alias("iri"), F.col("root").alias("root_iri"), F.col("depth").alias("node_depth"), "status", "path"
    )


def p3_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(hierarchy(table(spark, d, "ontology_class"), with_cycles=False, with_walk=True))


def _records(spark: SparkSession, d: str) -> DataFrame:
    return parse_records(table(spark, d, "raw_record"), "record_id", "raw_line", RESPONSE_EXPORT)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return faulty(_records(spark, d), "record_id").select("record_id", "fault")


def p4_loaded(spark: SparkSession, d: str) -> DataFrame:
    return sound(_records(spark, d))


def p4_faults(spark: SparkSession, d: str) -> DataFrame:
    return faulty(_records(spark, d), "record_id")


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    items = split_packed(table(spark, d, "packed_field"), "packed_id", "packed_value")
    return items.where("n_items >= 2").select("packed_id", "pos", "item")


def p7_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value, single ones included."""
    return split_packed(table(spark, d, "packed_field"), "packed_id", "packed_value")


QUERIES = {
    f.__name__: f
    for f in (p3_found, p3_paths, p3_descendants, p4_found, p4_loaded, p4_faults, p7_found, p7_values)
}

_TREE = r"""
with recursive named as (
  select distinct iri, parent_iri,
    nullif(regexp_replace(regexp_extract(regexp_replace(iri, '^[\s<]+|[\s>]+$', '', 'g'), '([^/#]*)$', 1), '^(.*[A-Za-z])[:_]([0-9]+)$', '\1\2'), '') as k,
    nullif(regexp_replace(regexp_extract(regexp_replace(parent_iri, '^[\s<]+|[\s>]+$', '', 'g'), '([^/#]*)$', 1), '^(.*[A-Za-z])[:_]([0-9]+)$', '\1\2'), '') as up
  from ontology_class),
node as (select iri, k, min(up) as up from named where k is not null group by iri, k),
target as (select k, min(iri) as t from node group by k),
edge as (select n.iri, t.t as parent from node n left join target t on n.up = t.k),
tree(iri, root_iri, node_depth) as (
  select iri, iri, 0 from edge where parent is null
  union all
  select e.iri, tree.root_iri, tree.node_depth + 1 from edge e join tree on e.parent = tree.iri)
"""

_RECORDS = r"""
with rec as (select distinct record_id, raw_line as raw, ',' || raw_line as line from raw_record),
cut as (
  select *, coalesce(regexp_full_match(line, '(?s)(?:,(?:"(?:[^"]|"")*"|[^",]*))*'), true) as formed,
    regexp_extract_all(line, '(?s),("(?:[^"]|"")*"|[^",]*)', 1) as pieces from rec),
fields as (
  select record_id, raw, formed, formed and raw is not null and len(pieces) = 7 as complete,
    list_transform(pieces, lambda x: case when x[1] = '"' then replace(x[2:-2], '""', '"') else x end) as f from cut),
ruled as (
  select *, case when not complete then []::varchar[] else list_filter([
    case when not (regexp_full_match(f[1], '[0-9]+') and coalesce(try_cast(f[1] as bigint), 0) > 0) then 'response_id' end,
    case when not regexp_full_match(f[2], 'AB[0-9]{9}') then 'abstract_id' end,
    case when not regexp_matches(f[3], '\S') then 'model' end,
    case when lower(f[4]) not in ('true', 'false') then 'done' end,
    case when f[5] <> '' and not (regexp_full_match(f[5], '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
      and coalesce(try_cast(f[5] as double), -1) >= 0 and not isinf(coalesce(try_cast(f[5] as double), -1))) then 'request_duration_s' end,
    case when f[6] <> '' and not (regexp_full_match(f[6], '[0-9]+') and try_cast(f[6] as bigint) is not null) then 'completion_tokens' end,
    case when f[7] <> '' and not (json_valid(f[7]) and coalesce(json_type(try_cast(f[7] as json)), '') = 'OBJECT'
      and not regexp_matches(f[7], ',\s*[}\]]')) then 'content' end], lambda x: x is not null) end as bad_fields
  from fields),
judged as (
  select *, case when not formed then 'quoting' when not complete then 'columns' when len(bad_fields) > 0 then 'value' end as fault from ruled)
"""

SQL = {
    "p4_found": _RECORDS + "select record_id, fault from judged where fault is not null",
    "p4_faults": _RECORDS + "select record_id, fault, bad_fields, raw from judged where fault is not null",
    "p4_loaded": _RECORDS
    + """select record_id, cast(f[1] as bigint) as response_id, f[2] as abstract_id, f[3] as model, lower(f[4]) = 'true' as done,
  cast(nullif(f[5], '') as double) as request_duration_s, cast(nullif(f[6], '') as bigint) as completion_tokens, f[7] as content
from judged where fault is null""",
    "p3_found": _TREE
    + """
select e.iri, coalesce(t.root_iri, '') as root_iri, cast(coalesce(t.node_depth, -1) as integer) as node_depth
from edge e left join tree t on e.iri = t.iri
""",
    "p3_descendants": _TREE
    + """,
-- every other class met upwards, at its first distance; a walk that meets a class again has come round a cycle
above(ancestor, node, distance, met) as (
  select parent, iri, 1, [iri, parent] from edge where parent is not null and parent <> iri
  union all
  select e.parent, a.node, a.distance + 1, list_append(a.met, e.parent) from above a join edge e on a.ancestor = e.iri
  where e.parent is not null and not list_contains(a.met, e.parent))
select ancestor, node, cast(distance as integer) as distance from above
""",
    "p3_paths": _TREE
    + """,
path(iri, p) as (
  select iri, [iri] from edge where parent is null
  union all
  select e.iri, list_append(path.p, e.iri) from edge e join path on e.parent = path.iri),
-- classes off the trees: those that come back to themselves are on a cycle
off as (select e.iri, e.parent from edge e where e.iri not in (select iri from tree)),
walk(origin, here, n) as (
  select iri, parent, 1 from off
  union all
  select w.origin, o.parent, w.n + 1 from walk w join off o on w.here = o.iri where w.here <> w.origin and w.n < (select count(*) from off)),
cyclic as (select distinct origin from walk where here = origin)
select e.iri, coalesce(t.root_iri, '') as root_iri, cast(coalesce(t.node_depth, -1) as integer) as node_depth,
  case when t.iri is not null then 'tree' when e.iri in (select origin from cyclic) then 'cycle' else 'below' end as status, p.p as path
from edge e left join tree t on e.iri = t.iri left join path p on e.iri = p.iri
""",
}
