"""Queries of the vector tier over the embedding table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspan.functions.vectors import cosine
from quillspan.operators import similarity
from quillspan.runtime import table

HIGH, LOW = 0.35, 0.25
THRESHOLDS = (0.0, 0.05, 0.1, 0.2, 0.3)
KEYS = ("vec_id", "encoder")
#: Name and how many of the first members are used.
ENCODERS = (("full64", None), ("half32", 32))


def _best(spark: SparkSession, d: str) -> DataFrame:
    """Best other vector of the whole table for every vector whose id is divisible by 20, by two encoders."""
    best = similarity.nearest(table(spark, d, "embeddings"), "vec_id", "embedding", ENCODERS, asked=F.col("vec_id") % 20 == 0)
    return best.withColumn("best_match", F.col("best_match").cast("string"))


def cosine_best(spark: SparkSession, d: str) -> DataFrame:
    return _best(spark, d).select("vec_id", "encoder", "best_match", F.round("score", 6).alias("score"))


def _decided(spark: SparkSession, d: str) -> DataFrame:
    return similarity.decided(_best(spark, d), HIGH, LOW)


def tiered_decision(spark: SparkSession, d: str) -> DataFrame:
    return _decided(spark, d).select("vec_id", "encoder", "decision", "best_match", F.round("score", 6).alias("score"))


def vector_match_single(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.single_threshold(_best(spark, d), HIGH)
    return found.select("vec_id", "encoder", "is_match", "best_match", F.round("score", 6).alias("score"))


def vector_ensemble(spark: SparkSession, d: str) -> DataFrame:
    found = similarity.ensemble(_decided(spark, d), ("vec_id",), "place")
    return found.select("vec_id", "decision", "best_match", F.round("score", 6).alias("score"), "encoder")


def vector_rank(spark: SparkSession, d: str) -> DataFrame:
    return similarity.ranked(_decided(spark, d), ("vec_id",), "place")


def vector_stats(spark: SparkSession, d: str) -> DataFrame:
    return similarity.tier_counts(_decided(spark, d).withColumn("rescued", F.lit(False)), ("encoder",))


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of vectors whose ids are neighbours up to a distance of twenty."""
    rows = table(spark, d, "embeddings").select("vec_id", "label", "embedding")
    near = rows.withColumn("b", F.explode(F.sequence(F.col("vec_id") + 1, F.col("vec_id") + 20)))
    other = rows.select(F.col("vec_id").alias("b"), F.col("label").alias("other"), F.col("embedding").alias("e"))
    return near.join(other, "b").select(
        "vec_id", "b", (F.col("label") == F.col("other")).alias("expected"),
        F.round(cosine(F.col("embedding"), F.col("e"), clamp=False), 9).alias("score"),
    )


def threshold_sweep(spark: SparkSession, d: str) -> DataFrame:
    swept = similarity.sweep(_pairs(spark, d), "score", "expected", THRESHOLDS)
    return swept.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "accuracy")])


def best_threshold(spark: SparkSession, d: str) -> DataFrame:
    best = similarity.best_threshold(similarity.sweep(_pairs(spark, d), "score", "expected", THRESHOLDS))
    return best.select("threshold", F.round("f1", 6).alias("f1"))


def pair_verdicts(spark: SparkSession, d: str) -> DataFrame:
    verdict = F.coalesce(F.col("score") >= 0.1, F.lit(False))
    return _pairs(spark, d).select("vec_id", "b", "expected", verdict.alias("predicted"))


QUERIES = {
    f.__name__: f
    for f in (cosine_best, tiered_decision, vector_match_single, vector_ensemble, vector_rank, vector_stats,
              threshold_sweep, best_threshold, pair_verdicts)
}

_BEST = f"""
with pair as (
  select a.vec_id, b.vec_id as gold_id, a.embedding::double[] as x, b.embedding::double[] as y
  from embeddings a join embeddings b on a.vec_id <> b.vec_id where a.vec_id % 20 = 0),
scored as (
  select vec_id, gold_id, 'full64' as encoder, 0 as place, round(greatest(0, least(1, list_cosine_similarity(x, y))), 9) as s from pair
  union all
  select vec_id, gold_id, 'half32', 1, round(greatest(0, least(1, list_cosine_similarity(x[1:32], y[1:32]))), 9) from pair),
best as (
  select vec_id, encoder, place, max(struct_pack(s := s, p := -gold_id)) as b from scored group by all),
chosen as (select vec_id, encoder, place, cast(-b.p as varchar) as best_match, b.s as score from best),
decided as (
  select vec_id, encoder, place, case when score >= {HIGH} then 'MATCH' when score <= {LOW} then 'NO_MATCH' else 'AMBIGUOUS' end as decision,
    case when score > {LOW} then best_match end as best_match, score from chosen)
"""
_PAIRS = """
with pair as (
  select a.vec_id, b.vec_id as b, a.label = b.label as expected,
    round(list_cosine_similarity(a.embedding::double[], b.embedding::double[]), 9) as score
  from embeddings a join embeddings b on b.vec_id between a.vec_id + 1 and a.vec_id + 20),
counted as (
  select t as threshold, count(*) filter (score >= t and expected) as tp, count(*) filter (score >= t and not expected) as fp,
    count(*) filter (score < t and expected) as fn, count(*) filter (score < t and not expected) as tn
  from pair, (values (0.0::double), (0.05), (0.1), (0.2), (0.3)) as v(t) group by all),
rated as (
  select *, case when tp + fp > 0 then tp / (tp + fp) else 0.0 end as p, case when tp + fn > 0 then tp / (tp + fn) else 0.0 end as r from counted),
swept as (
  select threshold, cast(tp as bigint) as tp, cast(fp as bigint) as fp, cast(fn as bigint) as fn, cast(tn as bigint) as tn,
    round(p, 6) as precision, round(r, 6) as recall, round(case when p + r > 0 then 2 * p * r / (p + r) else 0.0 end, 6) as f1,
    round((tp + tn) / (tp + fp + fn + tn), 6) as accuracy from rated)
"""
SQL = {
    "cosine_best": _BEST + "select vec_id, encoder, best_match, round(score, 6) as score from chosen",
    "tiered_decision": _BEST + "select vec_id, encoder, decision, best_match, round(score, 6) as score from decided",
    "vector_match_single": _BEST
    + f"select vec_id, encoder, score >= {HIGH} as is_match, case when score >= {HIGH} then best_match end as best_match, round(score, 6) as score from chosen",
    "vector_ensemble": _BEST
    + """select vec_id, case when max(decision = 'MATCH') then 'MATCH' when max(decision = 'AMBIGUOUS') then 'AMBIGUOUS' else 'NO_MATCH' end as decision,
  arg_max(best_match, k) filter (best_match is not null) as best_match, round(arg_max(score, k), 6) as score, arg_max(encoder, k) as encoder
from (select *, struct_pack(d := case decision when 'MATCH' then 2 when 'AMBIGUOUS' then 1 else 0 end, s := score, o := -place) as k from decided)
group by vec_id""",
    "vector_rank": _BEST
    + """select vec_id, list(encoder order by score desc, encoder) as ranking,
  string_agg(encoder || ':' || decision || ':' || printf('%.3f', score) || coalesce(':' || best_match, ''), '; ' order by score desc,
    case decision when 'MATCH' then 0 when 'AMBIGUOUS' then 1 else 2 end, encoder) as text
from decided group by vec_id""",
    "vector_stats": _BEST
    + """select encoder, cast(count(*) filter (decision = 'MATCH') as bigint) as auto_match, cast(count(*) filter (decision = 'NO_MATCH') as bigint) as auto_reject,
  cast(count(*) filter (decision = 'AMBIGUOUS') as bigint) as ambiguous, cast(0 as bigint) as unavailable from decided group by encoder""",
    "threshold_sweep": _PAIRS + "select * from swept",
    "best_threshold": _PAIRS + "select threshold, f1 from swept order by f1 desc, threshold limit 1",
    "pair_verdicts": _PAIRS + "select vec_id, b, expected, score >= 0.1 as predicted from pair",
}
