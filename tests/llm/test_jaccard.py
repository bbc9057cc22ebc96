from __future__ import annotations

import random
import re

import pytest

from casetable.llm import jaccard_join as J
from casetable.llm.components import components
from casetable.llm.words import shingle_hashes, text_slices, word_hashes

SF = "/root/testdata/sf0.001"


def word_list(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingle_set(text):
    w = word_list(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def expected(rows):
    """Rows of (n_shingles, component_id), all pairs compared."""
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    holders = {}
    for i, s in enumerate(sets):
        for x in s:
            holders.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in holders[x] if j < i}
        for j in near:
            if 100 * len(s & sets[j]) >= 80 * len(s | sets[j]):
                parent[root(i)] = root(j)
    ids = {}
    for i, (d, _) in enumerate(rows):
        if sets[i] and d is not None:
            ids[root(i)] = min(ids.get(root(i), d), d)
    return sorted(
        ((d, len(s), ids.get(root(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets))), key=repr
    )


def result(df, **kw):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.jaccard_join(df, **kw).collect()), key=repr)


@pytest.mark.parametrize("chunk", [J.CHUNK, 3])
def test_the_documents(spark, chunk):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert result(docs, chunk=chunk) == expected([(r.doc_id, r.text) for r in docs.collect()])


def families(seed):
    """Near copies around the threshold, shared passages, short and odd texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    passage = [rng.choice(vocabulary) for _ in range(40)]
    for _ in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 5, 6, 9, 30, 60, 120]))]
        if rng.random() < 0.4:
            base += passage
        for _ in range(rng.choice([1, 2, 4, 8])):
            copy = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
                at = rng.randrange(len(copy))
                copy[at:at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
            texts.append(" ".join(copy))
    texts += [None, "", " \t\n", "one", "ONE", "one two", "É é", "é É", "a\x0bb\x0cc d e f", "a b c d e f"] * 2
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)] + [(3, "one two"), (None, "one two"), (None, "of its own words here now")]


@pytest.mark.parametrize("seed,chunk", [(1, J.CHUNK), (2, 4)])
def test_families_of_near_copies(spark, seed, chunk):
    rows = families(seed)
    df = spark.createDataFrame([(d, t, "x", 1) for d, t in rows], "doc_id bigint, text string, shingle string, n int")
    assert result(df, chunk=chunk) == expected(rows)


def test_empty_table(spark):
    assert result(spark.createDataFrame([], "doc_id bigint, text string")) == []


@pytest.mark.parametrize("seed", range(5))
def test_search_equals_all_pairs(seed):
    rng = random.Random(seed)
    sets = []
    for _ in range(60):
        if sets and rng.random() < 0.6:
            s = set(rng.choice(sets))
            for _ in range(rng.randrange(6)):
                s.discard(rng.choice(sorted(s))) if len(s) > 1 and rng.random() < 0.5 else s.add(rng.randrange(90))
        else:
            s = set(rng.sample(range(90), rng.randrange(1, 40)))
        sets.append(s)
    sets.sort(key=len)

    def joined(links):
        parent = list(range(len(sets)))

        def root(i):
            while parent[i] != i:
                i = parent[i]
            return i

        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(i) for i in range(len(sets))]

    near = [(i, j) for i in range(len(sets)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    found = list(J.search_links(range(len(sets)), [sorted(s) for s in sets], None))
    assert set(map(tuple, map(sorted, found))) <= set(map(tuple, map(sorted, near)))
    assert joined(found) == joined(near)
    half = 30
    across = list(J.search_links(range(len(sets)), [sorted(s) for s in sets], half))
    assert all(a >= half > b for a, b in across)
    inside = [p for p in near if (p[0] >= half) == (p[1] >= half)]
    assert joined(across + inside) == joined(near)


def test_merge_skip():
    rng = random.Random(7)
    for times in (1, 2, 3, 5):
        lists = [sorted(rng.sample(range(40), rng.randrange(0, 20))) for _ in range(6)]
        want = {v: c for v in range(40) if (c := sum(v in x for x in lists)) >= times}
        assert dict(J.merge_skip(lists, [0] * 6, times)) == want


def test_hashes_follow_words():
    import pyarrow as pa

    texts = ["a b", "A  b\n", None, "", "ab", "é x", " a b c d e f", "a b c d e f g"]
    words, first = word_hashes(pa.array(texts))
    seen = {}
    for i, t in enumerate(texts):
        hashes = words[first[i]:first[i + 1]].tolist()
        assert len(hashes) == len(word_list(t))
        for w, h in zip(word_list(t), hashes):
            assert seen.setdefault(w, h) == h
    assert len(set(seen.values())) == len(seen)
    sizes = [len(s) for part in text_slices(pa.array(texts), 4) for s in shingle_hashes(part, 5)]
    assert sizes == [len(shingle_set(t)) for t in texts]


def test_components_of_a_long_chain(spark):
    rows = [(i * 7919 % 301, (i + 1) * 7919 % 301) for i in range(300)] + [(1000, 1001), (1001, 1002), (5000, 5000), (None, 3)]
    got = dict(components(spark.createDataFrame(rows, "a bigint, b bigint")).collect())
    assert {got[i] for i in range(301)} == {0} and got[1002] == 1000 and 5000 not in got
