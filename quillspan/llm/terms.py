"""Frequency of every distinct term, in occurrences and in records.

Rows are partitioned by the hash of their record and ordered by it, so the tokens of a task
come record by record. A task keeps for each term its occurrences, its records and the last
record that had it: a token counts as a new record only if the last one differs, so no set
of records is ever held. The tokens of an Arrow batch are brought to their counters
together. Counters are added up by a shuffle on the term, one row a term and task: a term
that a third of all records hold is as light as any other.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspan.runtime import cut

#: Terms that a task holds counters of before it hands them on.
HELD = 1_000_000


def plain_terms(values: Column) -> Column:
    """Members trimmed of spaces and tabs, in lower case; nulls and blanks are no terms."""
    trimmed = F.transform(values, lambda x: F.lower(F.regexp_replace(x, r"^[ \t]+|[ \t]+$", "")))
    return F.filter(trimmed, lambda x: x.isNotNull() & x.rlike(r"(?U)\S"))


def gold_values(expected: Column) -> Column:
    """All gold values of a JSON object of fields, in any of its five encodings.

    A field is a text, a list of texts, a list of objects with ``value`` or ``values``, or
    an object with ``values`` or ``value``. Unreadable JSON gives an empty array.
    """
    texts = "array<string>"
    fields = F.map_values(F.from_json(expected, "map<string,string>"))

    def as_list(x: Column) -> Column:
        return F.from_json(x, texts)

    def of_object(x: Column) -> Column:
        values = F.get_json_object(x, "$.values")
        value = F.get_json_object(x, "$.value")
        return (
            F.when(values.rlike(r"^\s*\["), as_list(values))
            .when(values.isNotNull(), F.array(values))
            .when(value.isNotNull(), F.array(value))
            .otherwise(F.array().cast(texts))
        )

    def of_member(x: Column) -> Column:
        return F.when(x.rlike(r"^\s*\{"), of_object(x)).otherwise(F.array(x))

    def of_field(x: Column) -> Column:
        return (
            F.when(x.rlike(r"^\s*\["), F.flatten(F.transform(as_list(x), of_member)))
            .when(x.rlike(r"^\s*\{"), of_object(x))
            .otherwise(F.array(x))
        )

    none = F.array().cast(texts)
    per_field = F.transform(F.coalesce(fields, none), lambda x: F.coalesce(of_field(x), none))
    return F.flatten(per_field)


class Counters:
    """Last-seen counters: of each term its occurrences, its records, and the last record that had it.

    The null term stands for all of them.
    """

    def __init__(self) -> None:
        self.held: dict[str | None, list[int]] = {}

    def add(self, lists: pa.Array, record: np.ndarray) -> None:
        """The terms of rows in the order of their records."""
        flat, owner = pc.list_flatten(lists), record[np.asarray(pc.list_parent_indices(lists))]
        valid = np.asarray(pc.is_valid(flat))
        flat, owner = flat.filter(pa.array(valid)), owner[valid]
        if len(flat) == 0:
            return
        coded = pc.dictionary_encode(flat)
        code = np.asarray(coded.indices)
        order = np.argsort(code, kind="stable")  # by term; within it still by record
        self._merge(coded.dictionary.to_pylist(), code[order], owner[order])
        self._merge([None], np.zeros(len(owner), int), owner)

    def _merge(self, terms: list, code: np.ndarray, record: np.ndarray) -> None:
        first = np.flatnonzero(np.diff(code, prepend=-1))
        new = np.ones(len(code), bool)
        new[1:] = (code[1:] != code[:-1]) | (record[1:] != record[:-1])
        last = np.append(first[1:], len(code)) - 1
        found = zip(code[first], np.diff(np.append(first, len(code))), np.add.reduceat(new, first, dtype=int), record[first], record[last])
        for c, occurrences, records, begin, end in found:
            own = self.held.setdefault(terms[c], [0, 0, -1])
            own[0] += int(occurrences)
            own[1] += int(records) - (own[2] == begin)
            own[2] = int(end)

    def leave(self, record: int) -> Iterator[pa.RecordBatch]:
        """The counters so far; those of the given record, which may go on, stay as seen."""
        kept = [(t, x) for t, x in self.held.items() if x[0]]
        yield pa.RecordBatch.from_arrays(
            [pa.array([t for t, _ in kept], pa.string()), pa.array([x[0] for _, x in kept], pa.int64()), pa.array([x[1] for _, x in kept], pa.int64())],
            names=["term", "occurrences", "records"],
        )
        self.held = {t: [0, 0, record] for t, x in self.held.items() if x[2] == record}


def term_counts(records: DataFrame, key: str, terms: str) -> DataFrame:
    """``term, occurrences, records`` over rows of one record each, and a null term's row.

    The row of the null term has in ``records`` the number of records with at least one
    term, and in ``occurrences`` the number of all terms. Rows that come more than once,
    unchanged, count once; different rows of one ``key`` are one record together; each row
    of null key is a record of its own. Null lists, null members and empty tables count
    nothing. Terms are compared as they are: normalize them first. Other columns are ignored.
    """
    rows = records.select(F.col(key).alias("_key"), F.col(terms).alias("_terms"))
    lone = rows.withColumn("_lone", F.when(F.col("_key").isNull(), F.monotonically_increasing_id()))
    one = lone.repartition("_key", "_lone").distinct().sortWithinPartitions("_key", "_lone")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, number, last_key = Counters(), 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = batch.column(0)
            same = np.zeros(batch.num_rows, bool)
            same[0] = last_key is not None and keys[0].as_py() == last_key
            same[1:] = np.asarray(pc.fill_null(pc.equal(keys.slice(1), keys.slice(0, batch.num_rows - 1)), False))
            record = number + np.cumsum(~same)
            number, last_key = int(record[-1]), keys[batch.num_rows - 1].as_py()
            counters.add(batch.column(1), record)
            if len(counters.held) > HELD:
                yield from counters.leave(number)
        yield from counters.leave(-1)

    partial = one.select("_key", "_terms").mapInArrow(run, "term string, occurrences bigint, records bigint")
    return partial.groupBy("term").agg(
        F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records")
    )


def marked(counts: DataFrame, common_share: float = 0.01, rare_records: int = 1) -> DataFrame:
    """``term, occurrences, records, mark``: each term with its mark.

    ``rare`` marks terms of at most ``rare_records`` records, ``common`` those in more than
    ``common_share`` of all records, ``useful`` the others; a term that is both (in a tiny
    collection) reads ``rare``.
    """
    counts = cut(counts)
    total = counts.where(F.col("term").isNull()).agg(F.coalesce(F.max("records"), F.lit(0))).first()[0]
    mark = (
        F.when(F.col("records") <= rare_records, "rare")
        .when(F.col("records") > common_share * total, "common")
        .otherwise("useful")
    )
    return counts.where(F.col("term").isNotNull()).withColumn("mark", mark)


def all_records(extraction: DataFrame, abstract_item: DataFrame) -> DataFrame:
    """``record, terms``: the extracted lists and the gold values, one row a record."""
    extracted = extraction.select(
        F.concat(F.lit("e"), F.col("extraction_id").cast("string")).alias("record"),
        plain_terms(F.col("value_list")).alias("terms"),
    )
    gold = abstract_item.select(
        F.concat(F.lit("a"), F.col("abstract_id")).alias("record"),
        plain_terms(gold_values(F.col("expected"))).alias("terms"),
    )
    return extracted.unionByName(gold)
