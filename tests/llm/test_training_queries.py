from __future__ import annotations

import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest

from casetable.llm.queries import CHECKS, QUERIES, vocabulary

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_agrees_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "conversations"):
        con.execute(f"create view {t} as from '{SF}/{t}.parquet'")
    want = con.sql(CHECKS[name])
    got = QUERIES[name](spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def test_packed_pieces_are_the_ids_of_the_tokenizer(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(vocabulary("byte_bpe_50k.json")))
    want = {}
    for r in pq.read_table(f"{SF}/documents.parquet").to_pylist():
        want[r["doc_id"]] = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0]
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op8_packing"](spark, SF).collect():
        ids = want[r.doc_id][r.start:r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes()) and r.doc_tokens == len(want[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(want)
    for parts, sizes in ((pieces, {d: len(w) for d, w in want.items()}), (sequences, {})):
        for key, spans in parts.items():
            at = 0
            for start, length in sorted(spans):
                assert start == at and length > 0
                at += length
            assert at == sizes.get(key, at) and (parts is pieces or at <= 1024)
    total = sum(map(len, want.values()))
    assert total / (len(sequences) * 1024) > 0.98
