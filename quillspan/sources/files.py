"""Readers of gold datasets, ontologies, vocabulary texts and prompt sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspan.functions import answers
from quillspan.functions.text import html_escaped, stripped

GOLD = "abstracts array<struct<id: string, title: string, abstract: string, expected: string>>"
CLASS = (
    "`_rdf:about` string, `owl:deprecated` array<string>, `rdfs:label` array<string>, "
    "`rdfs:subClassOf` array<struct<`_rdf:resource`: string>>, `obo:IAO_0000118` array<string>, `obo:IAO_0000115` array<string>"
)


def read_gold(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """``pos, id, title, abstract, expected`` of a JSON dataset, ``expected`` as JSON text, in file order.

    A dataset is one object a file, which one task reads, or with ``lines`` one a line, as
    ``write_gold`` leaves it, which is read in splits.
    """
    rows = spark.read.schema(GOLD).option("multiLine", str(not lines).lower()).json(path)
    return rows.select(F.posexplode("abstracts").alias("pos", "a")).select("pos", "a.*")


def write_gold(items: DataFrame, path: str) -> None:
    """``id, title, abstract, expected`` as a dataset of one object a line; ``expected`` is JSON text."""
    # line breaks in JSON text stand between its signs only
    flat = F.regexp_replace(F.coalesce("expected", F.lit("null")), r"[\r\n]+", " ")
    head = F.regexp_replace(F.to_json(F.struct("id", "title", "abstract"), {"ignoreNullFields": "false"}), r"\}$", "")
    items.select(F.concat(F.lit('{"abstracts": ['), head, F.lit(', "expected": '), flat, F.lit("}]}"))).write.text(path)


def gold_fields(items: DataFrame) -> DataFrame:
    """``item_id, attribute, values`` of the rows of ``read_gold``."""
    fields = items.select(F.col("id").alias("item_id"), F.explode(answers.as_object(F.col("expected"))).alias("attribute", "gold"))
    return fields.select("item_id", "attribute", answers.gold_values(F.col("gold")).alias("values"))


def read_ontology(spark: SparkSession, path: str) -> DataFrame:
    """``iri, label, alt_terms, definition, parent_iri`` of the live classes of an RDF/XML file.

    Classes without an IRI and deprecated ones are left out. The first label and the first
    definition that are not blank count, all alternative terms in order, and the first
    superclass only: one that is a restriction leaves ``parent_iri`` empty.
    """
    rows = spark.read.format("xml").option("rowTag", "owl:Class").schema(CLASS).load(path)

    def texts(name: str):
        held = F.coalesce(F.col(f"`{name}`"), F.array().cast("array<string>"))
        return F.filter(F.transform(held, stripped), lambda t: t.isNotNull() & (t != ""))

    parent = F.get("`rdfs:subClassOf`", F.lit(0)).getField("_rdf:resource")
    found = rows.select(
        F.col("`_rdf:about`").alias("iri"), F.coalesce(F.get(texts("rdfs:label"), F.lit(0)), F.lit("")).alias("label"),
        texts("obo:IAO_0000118").alias("alt_terms"), F.get(texts("obo:IAO_0000115"), F.lit(0)).alias("definition"),
        F.when(F.size("`rdfs:subClassOf`") > 0, F.coalesce(parent, F.lit(""))).alias("parent_iri"),
        F.coalesce(F.lower(F.get("`owl:deprecated`", F.lit(0))) == "true", F.lit(False)).alias("deprecated"),
    )
    return found.where((F.col("iri") != "") & ~F.col("deprecated")).drop("deprecated")


def write_ontology(classes: DataFrame, path: str, files: int = 1) -> None:
    """``iri, label, alt_terms, definition, parent_iri, deprecated`` as RDF/XML in a number of files, a class a line."""
    def element(name: str, value: Column) -> Column:
        return F.concat(F.lit(f"<{name}>"), html_escaped(value), F.lit(f"</{name}>"))

    named = F.concat(F.lit('<owl:Class rdf:about="'), html_escaped(F.col("iri")), F.lit('">'))
    parent = F.concat(F.lit('<rdfs:subClassOf rdf:resource="'), html_escaped(F.col("parent_iri")), F.lit('"/>'))
    alternatives = F.transform(F.coalesce("alt_terms", F.array().cast("array<string>")), lambda t: element("obo:IAO_0000118", t))
    parts = [named, element("owl:deprecated", F.col("deprecated").cast("string")), element("rdfs:label", F.col("label")), parent,
             F.array_join(alternatives, ""), element("obo:IAO_0000115", F.col("definition")), F.lit("</owl:Class>")]
    line = F.regexp_replace(F.concat_ws("", *parts), r"[\r\n]", "&#10;")  # nulls are left out
    body = classes.select(F.pmod(F.xxhash64("iri"), F.lit(max(1, files))).cast("int").alias("file"), F.lit(1).alias("at"), line.alias("line"))
    root = F.array(F.struct(F.lit(0).alias("at"), F.lit("<rdf:RDF>").alias("line")), F.struct(F.lit(2).alias("at"), F.lit("</rdf:RDF>").alias("line")))
    rows = body.unionByName(body.select("file").distinct().select("file", F.inline(root)))
    rows.repartition("file").sortWithinPartitions("file", "at").select("file", "line").write.partitionBy("file").text(path)


def write_vocabulary(terms: DataFrame, path: str) -> None:
    """``field, term`` as vocabulary texts, a file a field: its header, then its terms in order."""
    head = terms.select("field").distinct().select("field", F.lit(0).alias("at"), F.lit("").alias("term"), F.concat("field", F.lit(":")).alias("line"))
    body = terms.select("field", F.lit(1).alias("at"), "term", F.concat(F.lit('  - "'), "term", F.lit('"')).alias("line"))
    # a vocabulary is read by people: one field is one file
    rows = head.unionByName(body).repartition("field").sortWithinPartitions("field", "at", "term")
    rows.select(F.col("field").alias("of"), "line").write.partitionBy("of").text(path)


def read_vocabulary(spark: SparkSession, path: str, controlled: tuple[str, ...]) -> DataFrame:
    """``field, pos, term`` of vocabulary texts: ``field:`` headers with ``- "term"`` lines below.

    A header of another field ends the section; bullets that begin with ``#`` are comments.
    """
    text = spark.read.text(path, wholetext=True).withColumn("file", F.col("_metadata.file_path"))
    lines = text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("pos", "line"))
    header = F.nullif(F.regexp_extract("line", r"^\s*([A-Za-z0-9_]+)\s*:\s*$", 1), F.lit(""))
    upto = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    within = lines.withColumn("field", F.last(header, ignorenulls=True).over(upto))
    quoted = F.regexp_extract("line", r'^\s*-\s*"(.+)"\s*$', 1)
    plain = stripped(F.regexp_extract("line", r"^\s*-\s*(.+?)\s*$", 1))
    term = F.when(quoted != "", quoted).when((plain != "") & ~plain.startswith("#"), plain)
    return within.where(F.col("field").isin(*controlled)).select("field", "pos", term.alias("term")).where("term is not null")


def read_sections(spark: SparkSession, folder: str, names: list[str]) -> list[str]:
    """Prompt sections in the order of their names, right-stripped; missing ones are left out."""
    rows = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    held = {r["name"]: r["value"].rstrip() for r in rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("name"), "value").where(F.col("name").isin(names)).collect()}
    return [held[n] for n in names if held.get(n)]
