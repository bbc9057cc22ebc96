from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from casetable.llm import packing as P
from casetable.llm.queries import vocabulary
from odd import odd_table

RANKS, JSON = "byte_bpe_50k.tiktoken", "byte_bpe_50k.json"
TEXTS = [
    "a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|> x", "<|endoftext", "|>  \n\n tail ", "naïve 日本語 🙂", "", None,
    "plain words 12345's", "don't  stop <|endoftext|>",
]


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(str(vocabulary(JSON)))


def pieces(rows):
    """The ids of each document from its pieces, and the fill of each sequence; every rule of the layout is asserted."""
    parts, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        parts[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, len(ids)))
    for held in sequences.values():
        at = 0
        for offset, n in sorted(held):
            assert offset == at and n > 0
            at += n
        assert at <= 1024
    return parts, sequences


def test_added_tokens_are_one_id(spark, tokenizer):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    parts, _ = pieces(P.pack_documents(df, vocabulary(RANKS), P.added_tokens(vocabulary(JSON))).collect())
    for i, text in enumerate(TEXTS):
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        got = [x for _, ids, _ in sorted(parts[i]) for x in ids]
        assert got == want and {n for _, _, n in parts[i]} == {len(want)}


@pytest.mark.parametrize("tokens", [0, 255, 256, 1022, 1023, 1024, 2047, 2048, 5000])
def test_lengths_around_a_window(spark, tokenizer, tokens):
    text = " a" * tokens
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    rows = P.pack_documents(df, vocabulary(RANKS)).collect()
    parts, sequences = pieces(rows)
    assert [x for _, ids, _ in sorted(parts[1]) for x in ids] == tokenizer.encode(text, add_special_tokens=False).ids + [0]
    assert len(sequences) == -(-(tokens + 1) // 1024)


def test_odd_rows(spark, tokenizer):
    df = odd_table(spark, clash=("ids", "start", "offset", "sequence_id"))
    rows = P.pack_documents(df, vocabulary(RANKS), P.added_tokens(vocabulary(JSON))).collect()
    parts, _ = pieces(rows)
    assert set(parts) == {r.doc_id for r in df.collect()}
    one = [x for x in parts[1000]]
    assert one == [(0, [0], 1)] and parts[1001] == one
    texts = [r.text for r in df.collect() if r.doc_id == 5]  # three rows of one id, two of them equal
    assert sum(len(ids) for _, ids, _ in parts[5]) == sum(len(tokenizer.encode(x, add_special_tokens=False).ids) + 1 for x in texts)
    assert P.pack_documents(odd_table(spark, []), vocabulary(RANKS)).count() == 0
