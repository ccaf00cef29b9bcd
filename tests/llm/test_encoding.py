import os
import random

import pytest

from quillspan.llm import encoding as e

pytestmark = pytest.mark.skipif(not os.path.exists(e.DEFAULT_VOCABULARY), reason="no tokenizer files")
TEXTS = [
    "Hello world, it's 2024!", "", None, " ", "\n\n\n  x", "<|endoftext|>", "a" * 3000, "é😷🦠 naïve 数据", "\t" * 50 + "z", "don't DON'T 'S", "x\r\ny",
    "".join(random.Random(1).choice("abcdefgh ") for _ in range(2000)),
]


def test_same_ids_as_the_public_libraries(spark):
    tiktoken = pytest.importorskip("tiktoken")
    other = tiktoken.Encoding("own", pat_str=e.PATTERN, mergeable_ranks=e.read_ranks(e.DEFAULT_VOCABULARY), special_tokens={})
    rows = spark.createDataFrame([(i, x, [1]) for i, x in enumerate(TEXTS)], "doc_id long, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in e.encode(rows).collect()}
    assert got == {i: other.encode_ordinary(x or "") for i, x in enumerate(TEXTS)}
    assert {r.doc_id: r.n_ids for r in e.lengths(e.encode(rows)).collect()}[1] == 0


def test_merge_against_plain_loop():
    ranks = e.read_ranks(e.DEFAULT_VOCABULARY)
    rng = random.Random(3)
    for _ in range(200):
        piece = bytes(rng.choice(b"aabbcde 01\xc3\xa9") for _ in range(rng.randint(1, 30)))
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            pairs = [(ranks[parts[i] + parts[i + 1]], i) for i in range(len(parts) - 1) if parts[i] + parts[i + 1] in ranks]
            if not pairs:
                break
            _, i = min(pairs)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert e.merge(piece, ranks) == tuple(ranks[p] for p in parts)


def test_memory_is_bounded_without_effect():
    ranks = e.read_ranks(e.DEFAULT_VOCABULARY)
    small, large = e.Encoder(ranks, remembered=2), e.Encoder(ranks)
    for text in TEXTS:
        assert small(text) == large(text)


def test_empty(spark):
    assert e.encode(spark.createDataFrame([], "doc_id long, text string")).collect() == []
