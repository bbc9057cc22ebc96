from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from casetable.llm import ordinal
from casetable.llm.queries import QUERIES, table, vocabulary

SF = "/root/testdata/sf0.001"
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="module")
def kept(spark):
    """The documents before the first stage and after each of the first three."""
    docs = [table(spark, SF, "documents")]
    for _, stage in P.STAGES[:-1]:
        docs.append(P.stored(stage(spark, docs[-1], SF), "stage"))
    return docs


def words(text):
    lower = (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123))))
    return [w for w in re.split(rb"[\x20\x09-\x0D]+", lower) if w]


def shingles(text):
    w = words(text)
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def near_ids(rows):
    """The smallest id of each group of similar texts; texts without words are groups of their own."""
    group = {i: i for i, _ in rows}
    sets = [(i, shingles(t)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((group[i], group[j]))
                group = {k: low if g == high else g for k, g in group.items()}
    return {i for i, g in group.items() if i == g}


def space(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_grades_are_those_of_the_fitted_weights(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    got = {r.doc_id: r for r in QUERIES["op4_ordinal_quality"](spark, SF).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert set(got) == set(texts)
    weights, thresholds = ordinal.fit_grades(docs, ordinal.grades_of_labels(labels))
    assert list(thresholds) == sorted(thresholds)
    for i, text in texts.items():
        score = weights[ordinal.features(text)].sum()
        tails = 1 / (1 + np.exp(thresholds - score))
        assert got[i].expected_grade == pytest.approx(tails.sum(), abs=1e-5)
        assert got[i].tail_prob == pytest.approx(tails[-1], abs=1e-5) and got[i].selected == (got[i].tail_prob >= 0.5)


def test_grades_hold_on_texts_not_fitted_on(spark):
    docs, labels = (table(spark, "/root/testdata/sf0.01", n) for n in ("documents", "labels"))
    graded = ordinal.grades_of_labels(labels)
    told = graded.where("doc_id % 3 <> 0")
    weights, thresholds = ordinal.fit_grades(docs, told)
    rest = docs.join(graded.where("doc_id % 3 = 0"), "doc_id").select("text", "grade").collect()
    good = [(weights[ordinal.features(r.text)].sum() >= thresholds[-1]) == (r.grade == 2) for r in rest]
    common = Counter(r.grade == 2 for r in rest).most_common(1)[0][1] / len(rest)
    assert len(good) > 50 and sum(good) / len(good) >= max(0.8, common)


def test_stages_agree_with_brute_force(spark, kept):
    docs, good, exact, near = [[(r.doc_id, r.text) for r in d.select("doc_id", "text").collect()] for d in kept]
    assert all(d.columns == kept[0].columns for d in kept)
    graded = {r.doc_id for r in QUERIES["op4_ordinal_quality"](spark, SF).where("selected").collect()}
    assert sorted(i for i, _ in good) == sorted(i for i, _ in docs if i in graded) and good
    first = {}
    for i, t in sorted(good):
        first.setdefault(space(t), i)
    assert sorted(i for i, _ in exact) == sorted(first.values())
    assert sorted(i for i, _ in near) == sorted(near_ids(exact))


def test_the_last_stage_packs_what_is_left(spark, kept):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(vocabulary("byte_bpe_50k.json")))
    want = {r.doc_id: len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in kept[-1].collect()}
    held, used = defaultdict(int), defaultdict(int)
    for r in P.packing(spark, kept[-1], SF).collect():
        held[r.doc_id] += r.length
        used[r.sequence_id] += r.length
    assert dict(held) == want and max(used.values()) <= 1024
    assert {r.doc_id for r in P.run(spark, SF).select("doc_id").distinct().collect()} == set(want)


def test_stages_with_nulls_and_repeated_rows(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    rows = [(1, text), (1, text), (2, text.replace(" ", "\t ")), (3, text.upper()), (4, None), (5, ""), (None, text), (6, "é " * 3000), (7, "alone")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], COLUMNS)
    assert P.quality(spark, docs, SF).columns == docs.columns
    exact = P.exact(spark, docs, SF)
    assert sorted(r.doc_id for r in exact.collect()) == [1, 3, 4, 6, 7]
    near = P.near(spark, exact, SF)
    assert sorted(r.doc_id for r in near.collect()) == [1, 4, 6, 7]
    assert {r.doc_id for r in P.packing(spark, near, SF).collect()} == {1, 4, 6, 7}


def test_stages_of_an_empty_table(spark):
    docs = spark.createDataFrame([], COLUMNS)
    for _, stage in P.STAGES:
        assert stage(spark, docs, SF).count() == 0


def test_rows_that_share_an_id_are_told_apart(spark):
    base = [f"w{i}" for i in range(60)]
    one, two, three = (" ".join(base[:n] + [f"end{n}"]) for n in (57, 58, 59))  # near copies of each other
    rows = [(0, one), (1, two), (1, "some other text"), (None, three), (None, "yet another text"), (2, None), (2, None), (3, one)]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], COLUMNS)
    got = sorted(((r.doc_id, r.text) for r in P.near(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(0, one), (1, "some other text"), (None, "yet another text"), (2, None), (2, None)], key=repr)


def test_equal_texts_of_one_id_leave_one_row(spark):
    rows = [(1, "a b"), (1, "a  b"), (1, "a b"), (1, "other"), (None, "a\tb"), (None, "c d"), (None, "c  d"), (2, None), (2, "")]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], COLUMNS)
    got = sorted(((r.doc_id, space(r.text)) for r in P.exact(spark, docs, SF).collect()), key=repr)
    assert got == sorted([(1, "a b"), (1, "other"), (None, "c d"), (2, "")], key=repr)
