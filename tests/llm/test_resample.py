from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from casetable.llm import resample
from odd import odd_rows, odd_table, plain

COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.mark.parametrize("block", [1, 3, 8, 64])
def test_checksums_equal_zlib(block):
    rng = random.Random(block)
    parts = [rng.randbytes(n) for n in [0, 1, 2, 7, 8, 9, 63, 64, 65, 127, 128, 129, 1000, 40_000, 0] + [rng.randrange(200) for _ in range(200)]]
    raw, ends = np.frombuffer(b"".join(parts), np.uint8), np.cumsum([0] + [len(p) for p in parts])
    table = resample.PositionTable(block)
    assert table.crc32(raw, ends[:-1], ends[1:]).tolist() == [zlib.crc32(p) for p in parts]
    start, stop = np.array([0, 5, 5, 100]), np.array([3000, 70, 5, 2000])  # overlapping spans
    assert table.crc32(raw, start, stop).tolist() == [zlib.crc32(raw[a:b].tobytes()) for a, b in zip(start, stop)]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def buckets(text, sizes, n):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % n for k in sizes for i in range(len(w) - k + 1)]


@pytest.mark.parametrize("sizes", [(1, 1), (1, 3), (2, 2)])
def test_features_of_whole_texts(sizes):
    texts = [r[1] for r in odd_rows()]
    got = [[] for _ in texts]
    at = 0
    for n_words, of, bucket in resample.Features(*sizes, 977).read(pa.array(texts, pa.string())):
        for i, b in zip(of.tolist(), bucket.tolist()):
            got[at + i].append(b)
        assert n_words.tolist() == [len(words(t)) for t in texts[at:at + len(n_words)]]
        at += len(n_words)
    assert at == len(texts)
    assert [Counter(g) for g in got] == [Counter(buckets(t, range(sizes[0], sizes[1] + 1), 977)) for t in texts]


def brute(rows, target, n=50, least=8, percent=30, sizes=(1,)):
    s, t = (Counter(b for x in texts for b in buckets(x, sizes, n)) for texts in ([r[1] for r in rows], target))
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + n) / ((s[b] + 1) * (all_t + n)))) for b in range(n)]
    out = []
    for r in rows:
        b = buckets(r[1], sizes, n)
        weight = sum(gain[x] for x in b) // len(b) if b else 0
        h = int(hashlib.sha256(f"2024:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([r[0], len(b), weight, score, None, len(words(r[1]))])
    able = sorted((x for x in out if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for rank, x in enumerate(able[:len(able) * percent // 100], 1):
        x[4] = rank
    return sorted((tuple(x[:5]) for x in out), key=repr)


@pytest.mark.parametrize("sizes", [(1, 1), (1, 2)])
def test_equals_brute_force_with_clashing_columns(spark, sizes):
    target = ["the green fox", None, "", "naïve dogs over over"]
    df = odd_table(spark, clash=("bucket", "n", "weight", "place", "low", "out"))
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = resample.resample(df, goal, min_n=sizes[0], max_n=sizes[1], buckets=50, min_words=8, percent=30).collect()
    want = brute(odd_rows(), target, sizes=range(sizes[0], sizes[1] + 1))
    assert plain(got, *COLUMNS) == want and any(r[4] for r in want)


def test_empty_tables(spark):
    goal = spark.createDataFrame([("some text",)], "text string")
    assert resample.resample(odd_table(spark, []), goal).collect() == []
    got = resample.resample(odd_table(spark), goal.limit(0), buckets=50, min_words=8, percent=30).collect()
    assert plain(got, *COLUMNS) == brute(odd_rows(), [])
