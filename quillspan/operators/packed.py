"""Several values packed in one field: one row per value, with its position.

The work is done on the UTF-8 buffer of an Arrow batch at once: masks over all bytes of
the batch say which stand inside quotes (parity of the running quote count), inside round
brackets (running depth), in a number, and which are separators. Offsets of the child
values follow from the separator mask, and the child array is flattened with the ordinal
of its parent. The only shuffle is the one that counts a redelivered row once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspan.runtime import delivered_once

SPACE = np.isin(np.arange(256), list(b" \t\r\n\v\f"))
DIGIT = np.isin(np.arange(256), list(b"0123456789"))
LOWER = np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyz"))
ALWAYS = np.isin(np.arange(256), list(b";|\n\r\t"))
EDGE = SPACE | np.isin(np.arange(256), list(b",;|/[]"))
# List marks of more than one byte that separate wherever they stand.
MARKS = ("•", "‣", "▪", "；", "，", "、")
# Words and signs that join the last value to the list after a comma.
JOINING = r"^(?:and|&)\s+"
# The signs of roman numbers, greatest first.
ROMAN = ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def label_of(kind: str, n: int) -> str:
    """The n-th label of a numbering: ``12``, ``l`` (then ``aa`` after ``z``) or ``xii``."""
    out = ""
    if kind == "number":
        return str(n)
    if kind == "letter":
        while n:
            n, place = divmod(n - 1, 26)
            out = chr(97 + place) + out
        return out
    for value, sign in ROMAN:
        out += sign * (n // value)
        n %= value
    return out


def split_batch(values: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Parent ordinal, position and text of every value in a batch of packed strings.

    A value ends at a comma, semicolon, bar, tab, line break, list mark or spaced slash
    outside quotes, round brackets and numbers, at the brackets of a written list and at
    consecutive numbering. Quotes count only where they enclose; in a row whose quotes or
    brackets do not pair they are ordinary characters.
    """
    values = values.cast(pa.large_string())
    if len(values) == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.large_string())
    values = pc.fill_null(values, "")
    _, offsets, data = values.buffers()
    offset = np.frombuffer(offsets, np.int64)[values.offset : values.offset + len(values) + 1]
    buf = np.frombuffer(data, np.uint8)[offset[0] : offset[-1]] if offset[-1] > offset[0] else np.empty(0, np.uint8)
    offset = offset - offset[0]
    size = len(buf)
    if size == 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), pa.array([], pa.large_string())
    first, last = offset[:-1], offset[1:]
    row = np.repeat(np.arange(len(values)), last - first)
    begin, end = first[row], last[row]
    at = np.arange(size)
    before = np.where(at > begin, np.roll(buf, 1), 10)
    after = np.where(at + 1 < end, np.roll(buf, -1), 10)

    def running(mask: np.ndarray) -> np.ndarray:
        """How many of the mask stand in the row up to each byte."""
        total = np.cumsum(mask)
        return total - (total[begin] - mask[begin])

    def without(mask: np.ndarray, bad: np.ndarray) -> np.ndarray:
        """The mask, cleared in every row that has a bad byte."""
        spoilt = np.zeros(len(values), bool)
        spoilt[row[bad]] = True
        return mask & ~spoilt[row]

    slash_run = at - np.maximum.accumulate(np.where((buf != 92) | (at == begin), at, -1))
    slash_run = np.where((at == begin) & (buf == 92), 1, slash_run)
    escaped = (at > begin) & (np.roll(slash_run, 1) % 2 == 1) & (before == 92)

    double = (buf == 34) & ~escaped
    count = running(double)
    opening = double & (count % 2 == 1)
    final = at == end - 1
    double = without(double, (final & (count % 2 == 1)) | (opening & ~EDGE[before] & (before != 34) & (before != 39)))
    count = running(double)
    in_double = (count % 2 == 1) | double

    single = (buf == 39) & ~escaped & ~in_double
    opens = single & EDGE[before] & ~EDGE[after]
    closes = single & EDGE[after] & ~EDGE[before]
    level = running(opens) - running(closes)
    wrong = (level < 0) | (level > 1) | (final & (level != 0))
    opens, closes = without(opens, wrong), without(closes, wrong)
    in_single = (running(opens) - running(closes) > 0) | closes
    inside = in_double | in_single

    marker_from, marker_to = _numbering(buf, row, first, begin, before, after, at, inside)
    marker = np.zeros(size + 1, np.int64)
    np.add.at(marker, marker_from, 1)
    np.add.at(marker, marker_to + 1, -1)
    marker = np.cumsum(marker)[:size] > 0

    up, down = (buf == 40) & ~inside & ~marker, (buf == 41) & ~inside & ~marker
    level = running(up) - running(down)
    wrong = (level < 0) | (final & (level != 0))
    up, down = without(up, wrong), without(down, wrong)
    free = ~inside & (running(up) - running(down) <= 0)

    comma = (buf == 44) & ~(DIGIT[before] & DIGIT[after])
    spaced = (buf == 47) & SPACE[before] & SPACE[after] & (at > begin) & (at + 1 < end)
    cut = free & (ALWAYS[buf] | comma | spaced)
    for mark in MARKS:
        code = mark.encode()
        hit = free & (at + len(code) <= end)
        for k, byte in enumerate(code):
            hit &= np.roll(buf, -k) == byte
        for k in range(len(code)):
            cut[np.flatnonzero(hit) + k] = True
    solid = np.maximum.accumulate(np.where(buf != 32, at, -1))
    prior = np.where(at > begin, np.roll(solid, 1), -1)
    line_start = (prior < begin) | (buf[np.maximum(prior, 0)] == 10)
    cut |= free & line_start & ((buf == 45) | (buf == 42)) & (after == 32) & (at + 1 < end)
    cut |= marker
    inner = ~SPACE[buf]
    seen = running(inner)
    whole = np.zeros(len(values), np.int64)
    np.add.at(whole, row, inner)
    listed = np.zeros((len(values), 2), bool)
    listed[row[(buf == 91) & inner & (seen == 1)], 0] = True
    closing = (buf == 93) & inner & (seen == whole[row]) & free
    listed[row[closing], 1] = True
    listed = listed.all(axis=1)
    cut |= listed[row] & (closing | ((buf == 91) & (seen == 1) & inner))

    starts = np.zeros(size, bool)
    starts[first[first < last]] = True
    following = np.flatnonzero(cut) + 1
    starts[following[following < size]] = True
    starts = np.flatnonzero(starts)
    kept = np.concatenate([[0], np.cumsum(~cut)])
    child = pa.LargeStringArray.from_buffers(
        len(starts), pa.py_buffer(np.append(kept[starts], kept[-1]).astype(np.int64)), pa.py_buffer(buf[~cut])
    )
    parent, comma_before = row[starts], (before[starts] == 44) & (starts > begin[starts])
    text = _unquoted(pc.utf8_trim_whitespace(child))
    full = np.asarray(pc.greater(pc.utf8_length(text), 0))
    parent, comma_before, text = parent[full], comma_before[full], text.filter(pa.array(full))
    if len(parent) == 0:
        return parent, np.empty(0, np.int64), text
    group = np.concatenate([[True], parent[1:] != parent[:-1]])
    head = np.maximum.accumulate(np.where(group, np.arange(len(parent)), 0))
    position = np.arange(len(parent)) - head
    joined = np.concatenate([group[1:], [True]]) & comma_before & (position > 0)
    if joined.any():
        bare = _unquoted(pc.replace_substring_regex(text, JOINING, ""))
        text = pc.if_else(pa.array(joined), bare, text)
    return parent, position, text


def _numbering(buf, row, first, begin, before, after, at, inside) -> tuple[np.ndarray, np.ndarray]:
    """First and last byte of each mark of a numbering that opens its row and counts up by one.

    Forms: ``1.``, ``1)``, ``(1)``, ``a)``, ``(a)``, ``i)``, ``(i)``, each before a blank.
    """
    none = np.empty(0, np.int64)
    last = np.flatnonzero(((buf == 41) | (buf == 46)) & ~inside & SPACE[after] & (at > begin))
    if len(last) == 0:
        return none, none
    # a label is the whole run of digits and small letters before the mark
    digit, sign = DIGIT[buf], DIGIT[buf] | LOWER[buf]
    broken = np.maximum.accumulate(np.where(sign, -1, at))
    start = np.maximum(broken[last - 1] + 1, begin[last])
    length = last - start
    digits = np.concatenate([[0], np.cumsum(digit)])
    numeric = digits[last] - digits[start] == length
    bracket = (start > begin[last]) & (buf[np.maximum(start - 1, 0)] == 40) & (buf[last] == 41)
    start = start - bracket
    lead = np.where(start > begin[last], before[start], 10)
    good = (length > 0) & EDGE[lead] & (numeric | (buf[last] == 41))
    start, last, length, bracket, numeric = (x[good] for x in (start, last, length, bracket, numeric))
    if len(last) == 0:
        return none, none
    words = [bytes(buf[e - n : e]).decode() for e, n in zip(last, length)]
    solid = np.maximum.accumulate(np.where(~SPACE[buf], at, -1))
    opens = (np.where(start > 0, solid[np.maximum(start - 1, 0)], -1) < begin[start])
    keep, style, due, current = np.zeros(len(last), bool), None, 0, -1
    # One step per numbering mark, not per byte or row.
    for i, word in enumerate(words):
        if row[start[i]] != current:
            current, style = row[start[i]], None
            kind = "number" if word == "1" else "letter" if word == "a" else "roman" if word == "i" else None
            if opens[i] and kind:
                style, due = (kind, bool(bracket[i]), int(buf[last[i]])), 1
        if style is None or (bool(bracket[i]), int(buf[last[i]])) != style[1:]:
            continue
        if word == label_of(style[0], due) or (style[0] == "number" and word.lstrip("0") == str(due)):
            keep[i], due = True, due + 1
    return start[keep], last[keep]


def _unquoted(text: pa.Array) -> pa.Array:
    """Without enclosing quotes; doubled or escaped quotes inside them made single."""
    out = text
    for quote in ('"', "'"):
        held = pc.and_(
            pc.and_(pc.starts_with(text, quote), pc.ends_with(text, quote)), pc.greater(pc.binary_length(text), 1)
        )
        inner = pc.utf8_slice_codeunits(text, 1, -1)
        inner = pc.replace_substring(pc.replace_substring(inner, "\\" + quote, quote), quote * 2, quote)
        out = pc.if_else(held, pc.utf8_trim_whitespace(inner), out)
    return out


def split_packed(rows: DataFrame, key: str, value: str) -> DataFrame:
    """``key, pos, item, n_items``: one row per value of each packed field.

    ``pos`` counts from 0 over the values that are not blank, ``n_items`` is their number.
    Fields that are null, empty or hold nothing but separators have no row; repeated
    values within a field keep a row each. Rows delivered more than once, unchanged, count
    once; different texts under one key keep their rows, and so do rows of null key. An
    empty table gives an empty result; other columns are ignored.
    """
    one = delivered_once(rows.select(F.col(key).alias("_key"), F.col(value).alias("_value")), "_key")
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parent, position, text = split_batch(batch.column(1))
            counts = np.bincount(parent, minlength=batch.num_rows) if len(parent) else np.zeros(batch.num_rows, int)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(parent)),
                    pa.array(position.astype(np.int32)),
                    text.cast(pa.string()),
                    pa.array(counts[parent].astype(np.int32)),
                ],
                names=["_key", "pos", "item", "n_items"],
            )

    return one.mapInArrow(run, f"_key {kind}, pos int, item string, n_items int").withColumnRenamed("_key", key)
