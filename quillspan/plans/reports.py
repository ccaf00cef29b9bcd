"""Reports as datasets of lines and rows, and the writers of a run's results.

A report is built by expressions, one row a line with its place, so its size never meets
the driver; it is written partitioned by model.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.functions.text import html_escaped, safe_name
from quillspan.operators.matching import ratio


def report_lines(events: DataFrame, scores: DataFrame) -> DataFrame:
    """``model, item_id, section, place, line``: the text report of each item and model.

    A heading with the scores (section 0), then hits, misses and false positives by
    attribute. Sort by the first four columns to read it.
    """
    head = scores.select(
        "model", "item_id", F.lit(0).alias("section"), F.lit("").alias("place"),
        F.format_string(
            "%s | %s: %d hits, %d misses, %d false positives of %d expected; recall %.2f%%, precision %.2f%%, F1 %.2f%%",
            F.col("item_id").cast("string"), "model", "hits", "misses", "fps", "total_expected",
            *[F.round(F.col(c) * 100, 2) for c in ("recall", "precision", "f1")],
        ).alias("line"),
    )
    section = F.when(F.col("outcome") == "hit", 1).when(F.col("outcome") == "miss", 2).otherwise(3)
    shown = F.when(F.col("outcome") == "hit", F.concat_ws("", "value", F.lit(" = "), "matched", F.lit(" ("), "method", F.lit(")"))).otherwise(F.col("value"))
    body = events.where("outcome <> 'not_expected'").select(
        "model", "item_id", section.alias("section"), F.format_string("%s/%06d", "attribute", "pos").alias("place"),
        F.concat_ws("", F.lit("  ["), "attribute", F.lit("] "), shown).alias("line"),
    )
    return head.unionByName(body)


def html_rows(events: DataFrame) -> DataFrame:
    """``model, item_id, attribute, result, html``: the rows of the event table, escaped."""
    cells = [F.concat(F.lit("<td>"), html_escaped(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit("</td>")) for c in ("item_id", "attribute", "result", "value", "matched")]
    return events.select("model", "item_id", "attribute", "result", F.concat(F.lit("<tr>"), *cells, F.lit("</tr>")).alias("html"))


def model_comparison(events: DataFrame, responses: DataFrame) -> DataFrame:
    """``abstract_id, attribute, models, answers``: what all models answered on one abstract, side by side.

    ``responses`` has the ``abstract_id`` of each ``item_id``; responses without an abstract
    have nothing to be compared with. ``models`` counts the models that answered, ``answers``
    has the values of each with their outcomes, by model, response and position.
    """
    entry = F.struct("model", "item_id", "pos", "value", "outcome")
    of = responses.where(F.col("abstract_id").isNotNull()).select("item_id", "abstract_id")
    said = events.where("outcome <> 'miss'").join(of, "item_id").groupBy("abstract_id", "attribute").agg(
        F.array_sort(F.collect_list(entry)).alias("answers")
    )
    return said.select("abstract_id", "attribute", F.size(F.array_distinct("answers.model")).alias("models"), "answers")


def answer_lines(events: DataFrame, responses: DataFrame) -> DataFrame:
    """``abstract_id, attribute, model, answer``: the values of one model with their outcomes, in a line."""
    of = responses.where(F.col("abstract_id").isNotNull()).select("item_id", "abstract_id")
    shown = F.struct("item_id", "pos", F.concat("value", F.lit(" ["), "outcome", F.lit("]")).alias("text"))
    said = events.where("outcome <> 'miss'").join(of, "item_id").groupBy("abstract_id", "attribute", "model").agg(
        F.array_sort(F.collect_list(shown)).alias("a")  # one model on one attribute of an abstract
    )
    return said.select("abstract_id", "attribute", "model", F.array_join("a.text", "; ").alias("answer"))


def summary(scores: DataFrame) -> DataFrame:
    """``model, responses``, counts, recall, precision and f1 over all responses of each model."""
    counts = ("hits", "misses", "fps", "total_expected")
    summed = scores.groupBy("model").agg(F.count("*").alias("responses"), *[F.sum(c).alias(c) for c in counts])
    recall, precision = ratio(F.col("hits"), F.col("total_expected")), ratio(F.col("hits"), F.col("hits") + F.col("fps"))
    f1 = ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    rated = summed.withColumn("r", recall).withColumn("p", precision)
    return rated.select(
        "model", "responses", *counts, F.round("r", 6).alias("recall"), F.round("p", 6).alias("precision"), F.round(f1, 6).alias("f1")
    )


def write_run(events: DataFrame, scores: DataFrame, folder: str) -> None:
    """Events as JSON and the report as text, partitioned by a safe form of the model's name."""
    named = lambda df: df.withColumn("run", safe_name(F.col("model")))
    named(events).write.mode("overwrite").partitionBy("run").json(f"{folder}/events")
    named(scores).write.mode("overwrite").partitionBy("run").json(f"{folder}/scores")
    lines = named(report_lines(events, scores)).repartition("run", "item_id").sortWithinPartitions("run", "item_id", "section", "place")
    lines.select("run", "line").write.mode("overwrite").partitionBy("run").text(f"{folder}/report")


def write_responses(responses: DataFrame, folder: str, length: int = 2000) -> None:
    """Each answer with its first characters, by model and item."""
    out = responses.withColumn("run", safe_name(F.col("model"))).withColumn("raw_response", F.substring("content", 1, length))
    out.drop("content").write.mode("overwrite").partitionBy("run").json(folder)
