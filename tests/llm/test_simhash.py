from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter

import pytest
import xxhash
from pyspark.sql import functions as F

from casetable.llm import simhash
from odd import odd_rows, odd_table, plain

COLUMNS = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "near_id")


def spark_hash(*parts: str) -> int:
    seed = 42
    for p in parts:
        seed = xxhash.xxh64(p.encode(), seed=seed).intdigest()
    return seed


def words(text: str) -> set[str]:
    return set(re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())) - {""}


class Brute:
    def __init__(self, texts):
        self.n = len(texts)
        self.held = Counter(self.bucket(w) for t in texts for w in words(t))

    @staticmethod
    def bucket(word):
        x = spark_hash("bucket", word)
        return (x - (1 << 64) * (x >> 63)) % simhash.BUCKETS

    def fingerprint(self, text) -> str:
        votes, total = [0] * 128, 0
        for w in words(text):
            held = self.held.get(self.bucket(w))
            weight = self.n.bit_length() if held is None else max(0, math.floor(math.log2(self.n / held))) + 1
            bits = spark_hash(w) | spark_hash("second", w) << 64
            total += weight
            for i in range(128):
                votes[i] += weight * (1 if bits >> i & 1 else -1)
        out = sum(1 << i for i in range(128) if votes[i] > 0)
        return f"{out & (1 << 64) - 1:016x}{out >> 64:016x}"


def differ(a: str, b: str) -> int:
    return (int(a, 16) ^ int(b, 16)).bit_count()


def expected(rows, radius):
    texts = [(r[0], r[1] or "") for r in rows]
    brute = Brute([t for _, t in texts])
    once = sorted(set(texts), key=lambda x: (x[0] is None, x[0] or 0))
    print_of = {t: brute.fingerprint(t) for _, t in once}
    group = {x: {x} for x in once}
    for i, a in enumerate(once):
        for b in once[:i]:
            if differ(print_of[a[1]], print_of[b[1]]) <= radius and group[a] is not group[b]:
                both = group[a] | group[b]
                for x in both:
                    group[x] = both
    near = {x: min(g, key=lambda x: (x[0] is None, x[0] or 0))[0] for x, g in group.items()}
    return once, print_of, near, brute


def test_equals_brute_force(spark):
    rows = [r for r in odd_rows() if r[0] is not None and not (r[0] == 5 and r[1].startswith("another"))]  # ids tell texts apart here
    got = simhash.fingerprint_documents(odd_table(spark, rows, ("f1", "k1", "place", "term", "weight", "near_id")), radius=9).collect()
    once, print_of, near, brute = expected(rows, 9)
    falling = once[::-1]
    want = []
    for r in rows:
        me = (r[0], r[1] or "")
        after = falling[(falling.index(me) + 1) % len(falling)][1]
        n = len(me[1])
        edited = me[1][:n - n // 2] + after[:n // 2]
        f, e = print_of[me[1]], brute.fingerprint(edited)
        want.append((r[0], n, hashlib.sha256(edited.encode()).hexdigest(), f, e, 1 - differ(f, e) / 128, 1 - differ(f, print_of[after]) / 128, near[me]))
    assert plain(got, *COLUMNS) == sorted(want, key=repr)


def test_null_and_repeated_ids_are_whole(spark):
    got = simhash.fingerprint_documents(odd_table(spark)).collect()
    assert sorted((repr(r.doc_id) for r in got)) == sorted(repr(r[0]) for r in odd_rows())
    empty = {r.fingerprint for r in got if r.n_chars == 0}
    assert empty == {"0" * 32}


def test_empty_table_and_single_document(spark):
    assert simhash.fingerprint_documents(odd_table(spark, [])).collect() == []
    (row,) = simhash.fingerprint_documents(odd_table(spark, [(7, "abcd efgh", "en", "s", 1)])).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcd abcd").hexdigest() and row.near_next == 1.0 and row.near_id == 7


@pytest.mark.parametrize("radius, blocks", [(0, None), (1, None), (3, None), (3, 5), (6, 8)])
def test_search_finds_every_pair_once(spark, radius, blocks):
    rng = random.Random(radius)
    seeds = [rng.getrandbits(128) for _ in range(12)]
    prints = {s ^ sum({1 << rng.randrange(128) for _ in range(rng.randrange(6))}) for s in seeds for _ in range(15)} | {0, (1 << 128) - 1, 1 << 63, 1 << 127}

    def halves(x):
        return tuple(h - (1 << 64) * (h >> 63) for h in (x & (1 << 64) - 1, x >> 64))

    df = spark.createDataFrame([halves(p) for p in prints], "f1 long, f2 long")
    got = [((r.a1, r.a2), (r.b1, r.b2), r.distance) for r in simhash.within_radius(df, radius, blocks).collect()]
    want = {(a, b) for x in prints for y in prints if (a := halves(x)) < (b := halves(y)) and (x ^ y).bit_count() <= radius}
    assert len(got) == len(set(got)) and {(a, b) for a, b, _ in got} == want


def test_no_python_in_the_plan(spark):
    df = simhash.fingerprint_documents(odd_table(spark))
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_words_stay_in_the_task_of_their_text(spark):
    texts, order = simhash.document_order(odd_table(spark))
    rows = simhash.edited_texts(texts, order).select("k1", "k2", F.posexplode(F.array("text", "edited")).alias("edit", "text"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = simhash.fingerprints(rows, ["k1", "k2", "edit"], simhash.term_weights(texts))
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    aggregated = plan[:plan.index("Generate explode")]
    assert "Exchange hashpartitioning" not in aggregated
