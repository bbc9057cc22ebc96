from __future__ import annotations

import hashlib
import itertools
import re
import zlib

import pytest
from pyspark.sql import functions as F

from casetable.llm import exact_dedup as D, hilbert_shards as H

SF = "/root/testdata/sf0.001"


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def expected(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append(i)
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        ids = [x for x in g if x is not None]
        out.append((i, min(ids) if ids else None, len(g), hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out, key=repr)


TEXTS = [
    (1, "a b"), (2, "a\t\n b"), (3, None), (4, ""), (5, "  "), (6, " "), (7, "x" * 1000), (8, "x" * 999), (9, "x" * 1000),
    (10, "ab" * 500), (11, "é" * 33), (12, "é" * 33), (13, "\U0001f600" * 70), (14, "a b"), (14, "a b"), (None, "a b"),
    (15, "y" * 640), (16, "y" * 640 + "z"), (17, "ab" * 320 + "y" * 360),
]


@pytest.mark.parametrize("chars", [1, 7, 64, 32_768])
def test_names_tell_texts_apart(spark, chars):
    df = spark.createDataFrame([(i, t, "extra", 9) for i, t in TEXTS], "doc_id bigint, text string, key string, name int")
    got = D.exact_dedup(df, block_chars=chars).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(TEXTS)
    for sha in {r.text_sha256 for r in got}:
        kept = [r for r in got if r.text_sha256 == sha and r.kept]
        assert len(kept) == 1 and kept[0].doc_id == kept[0].keep_id


def test_a_weak_key_is_widened(spark):
    def weak(block, part):
        return F.pmod(D.block_key(block, part), F.lit(3)) if part < 2 else D.block_key(block, part)

    df = spark.createDataFrame(TEXTS, "doc_id bigint, text string")
    got = D.exact_dedup(df, block_chars=8, key=weak).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=repr) == expected(TEXTS)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    assert D.exact_dedup(df).count() == 0
    assert H.shard_documents(df).count() == 0


@pytest.mark.parametrize("n,bits", [(2, 1), (2, 3), (3, 2), (3, 3), (4, 2)])
def test_the_curve_visits_neighbours(spark, n, bits):
    cells = list(itertools.product(range(1 << bits), repeat=n))
    names = [f"x{i}" for i in range(n)]
    df = spark.createDataFrame(cells, ", ".join(f"{c} int" for c in names))
    rows = df.withColumn("h", H.hilbert_index([F.col(c) for c in names], bits)).orderBy("h").collect()
    assert [r.h for r in rows] == list(range(len(cells)))
    for a, b in zip(rows, rows[1:]):
        assert sum(abs(a[c] - b[c]) for c in names) == 1


def test_cells_keep_the_order(spark):
    df = spark.createDataFrame([(x,) for x in [None, -5, 0, 1, 2, 3, 4, 5, 6, 7, 8, 1000, 2**40, 2**62]], "v bigint")
    got = [r[0] for r in df.select(H.magnitude_cell(F.col("v"))).collect()]
    assert got[:2] == [0, 0] and got[1:] == sorted(got[1:]) and got[-1] == 63
    words = spark.createDataFrame([(w,) for w in ["b", None, "a", "c", "a", "d"]], "w string")
    got = {r.w: r.c for r in H.value_cells(words, "w", "c", 1).collect()}
    assert got == {None: 0, "a": 0, "b": 0, "c": 1, "d": 1}


def check_shards(rows, docs, shards):
    assert sorted(r.doc_id for r in rows) == sorted(d for d, _ in docs)
    text = dict(docs)
    by = {}
    for r in rows:
        raw = (text[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 16, zlib.crc32(raw))
        assert r.law == "rows" and r.grown_shard is None
        by.setdefault(r.shard, []).append(r)
    sizes = [len(by.get(s, [])) for s in range(shards)]
    assert set(by) <= set(range(shards)) and max(sizes) - min(sizes) <= 1
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    flat = [r for s in sorted(by) for r in sorted(by[s], key=lambda r: r.slot)]
    assert [r.hilbert for r in flat] == sorted(r.hilbert for r in flat)


def test_shards_of_the_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    placed = H.shard_documents(docs)
    check_shards(placed.collect(), [(r.doc_id, r.text) for r in docs.collect()], 40)
    # two dimensions at once: a filter on a language and a length keeps few shards
    ranges = H.shard_ranges(placed, ["dim_lang", "dim_n_chars"])
    hit = ranges.where("min_dim_lang <= 'es' and max_dim_lang >= 'es' and max_dim_n_chars >= 8000")
    assert hit.count() <= 20


def test_shards_with_nulls_and_few_rows(spark):
    df = spark.createDataFrame(
        [(1, None, None, None, None, 1), (2, "é", "de", "s", 5, 2), (3, "é", "de", "s", 5, 3)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, shard int",
    )
    check_shards(H.shard_documents(df).collect(), [(1, None), (2, "é"), (3, "é")], 40)


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    H.write_shards(H.shard_documents(docs, shards=3), docs, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert back.count() == docs.count() and back.select("shard").distinct().count() == 3


@pytest.mark.parametrize("build", [D.exact_dedup, H.shard_documents])
def test_no_python_in_the_plan(spark, build):
    plan = build(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
