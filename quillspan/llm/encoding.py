"""Corpus to token ids by a public byte-level BPE vocabulary.

Texts are cut by the vocabulary's pattern; each distinct piece is merged once a task and
remembered. Merging keeps the ranks of all adjacent pairs in a segment tree whose root
names the leftmost pair of lowest rank, so a piece of n bytes takes O(n log n) steps,
however long it is. One narrow pass over the texts: no shuffle. The vocabulary is sent to
the executors once; its size is that of the file, whatever the corpus.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
NEVER = 1 << 40
REMEMBERED = 500_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to id, from lines of base64 bytes and id; the id is also the merge rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PairTree:
    """Minimum of (rank, place) over the places of a row of adjacent pairs."""

    def __init__(self, ranks: list[int]):
        self.size = 1 << max(0, len(ranks) - 1).bit_length()
        leaves = ranks + [NEVER] * (self.size - len(ranks))
        self.best = [NEVER] * self.size + leaves
        self.place = [0] * self.size + list(range(self.size))
        for node in range(self.size - 1, 0, -1):
            self._pull(node)

    def _pull(self, node: int) -> None:
        left = 2 * node
        child = left if self.best[left] <= self.best[left + 1] else left + 1
        self.best[node], self.place[node] = self.best[child], self.place[child]

    def set(self, place: int, rank: int) -> None:
        node = place + self.size
        self.best[node] = rank
        while node > 1:
            node //= 2
            self._pull(node)

    def root(self) -> tuple[int, int]:
        return self.best[1], self.place[1]


def merge(piece: bytes, ranks: dict[bytes, int]) -> tuple[int, ...]:
    """Ids of one piece: the leftmost pair of lowest rank merges until none can."""
    n = len(piece)
    if n == 1:
        return (ranks[piece],)
    tokens = [piece[i : i + 1] for i in range(n)]
    following, previous = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = PairTree([ranks.get(piece[i : i + 2], NEVER) for i in range(n - 1)])
    while True:
        rank, i = tree.root()
        if rank == NEVER:
            break
        j = following[i]
        tokens[i] += tokens[j]
        after = following[j]
        following[i] = after
        if j < n - 1:
            tree.set(j, NEVER)
        if after < n:
            previous[after] = i
            tree.set(i, ranks.get(tokens[i] + tokens[after], NEVER))
        else:
            tree.set(i, NEVER)
        before = previous[i]
        if before >= 0:
            tree.set(before, ranks.get(tokens[before] + tokens[i], NEVER))
    out, i = [], 0
    while i < n:
        out.append(ranks[tokens[i]])
        i = following[i]
    return tuple(out)


class Encoder:
    """Text to ids, remembering the pieces seen; the memory is emptied when it is full."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN, remembered: int = REMEMBERED):
        self.ranks, self.pattern, self.remembered = ranks, regex.compile(pattern), remembered
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        pieces, known = self.pattern.findall(text), self.known
        try:
            return list(chain.from_iterable([known[p] for p in pieces]))
        except KeyError:
            if len(known) > self.remembered:
                known.clear()
            for p in pieces:
                if p not in known:
                    known[p] = merge(p.encode("utf-8", "surrogatepass"), self.ranks)
            return list(chain.from_iterable([known[p] for p in pieces]))


def encode(
    documents: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    vocabulary: str = DEFAULT_VOCABULARY,
    pattern: str = PATTERN,
) -> DataFrame:
    """``key, ids``: the token ids of each row's text, taken as it is, without special tokens.

    Null and empty texts have an empty list, blank ones the ids of their blanks; the text
    of a special token is ordinary text. One row out per row in: keys may be null or
    repeated. An empty table gives an empty result; other columns are ignored.
    """
    spark = documents.sparkSession
    sent = spark.sparkContext.broadcast(read_ranks(vocabulary))
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(sent.value, pattern)
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                lists = [np.asarray(encoder(t), np.int32) for t in part.column(1).to_pylist()]
                offsets = np.zeros(len(lists) + 1, np.int32)
                np.cumsum([len(x) for x in lists], out=offsets[1:])
                values = np.concatenate(lists) if lists else np.empty(0, np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=["_key", "ids"])

    rows = documents.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, f"_key {kind}, ids array<int>").withColumnRenamed("_key", key)


def lengths(encoded: DataFrame, key: str = "doc_id") -> DataFrame:
    """``key, n_ids`` for each encoded row."""
    return encoded.select(key, F.size("ids").alias("n_ids"))
