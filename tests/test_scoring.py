"""Scores, sets and run comparison."""

from __future__ import annotations

import json
import random
import statistics

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from casetable import vocab as V
from casetable.functions import score_sets as S
from casetable.operators import compare as C, joins as J, nested as N, scoring as SC
from casetable.plans import comparison as PCmp, scoring as PS

TAGS = [f"t{i}" for i in range(8)]


def plain_q3(scores):
    held = [s for s in scores if s > 0]
    if not held:
        return set()
    cut = held[0] if len(held) == 1 else statistics.quantiles(held, n=4, method="inclusive")[2]
    return {t for t, s in zip(TAGS, scores) if s > 0 and s >= cut}


def plain_set_score(a, b):
    small, large = sorted((a, b), key=len)
    if not large:
        return 1.0
    return max(0.0, len(small & large) / len(small) - 0.1 * len(large - small)) if small else 0.0


row = st.lists(st.integers(-5, 100), min_size=8, max_size=8)


@settings(max_examples=6, deadline=None)
@given(st.lists(st.tuples(row, row), min_size=30, max_size=60))
def test_sets_equal_plain_rules(spark, data):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(data)], "i int, scores1 array<long>, scores2 array<long>")
    for r in C.with_q3_sets(df, TAGS).collect():
        a, b = plain_q3(r.scores1), plain_q3(r.scores2)
        assert (set(r.set1), set(r.set2)) == (a, b)
        assert r.set_score == plain_set_score(a, b)


def test_first_of_equals_wins(spark):
    df = spark.createDataFrame([([5, 9, 9],), ([0, 0, 0],)], "s array<long>")
    got = [tuple(r[0]) for r in df.select(S.first_highest(F.col("s"), ["a", "b", "c"])).collect()]
    assert got == [(9, "b"), (0, "a")]


def reply(index, scores, primary=None, **more):
    body = {"solution_index": index, "algorithm_scores": scores, **more}
    return {**body, "primary_algorithm": primary} if primary else body


def test_golden_recheck_choice(spark):
    """Stored rows of one problem: candidate scores, and the choice made from them."""
    # fixed values: solution, broad score, candidate scores, choice
    stored = [
        (4, 95, {"BINARY_SEARCH": 95, "SORTING": 90, "TWO_POINTERS": 0}, ("BINARY_SEARCH", 95)),
        (5, 90, {"BINARY_SEARCH": 95, "SORTING": 85}, ("BINARY_SEARCH", 95)),
        (3, 95, {"BINARY_SEARCH": 0, "SORTING": 90, "TWO_POINTERS": 85}, ("SORTING", 90)),
        (9, 90, {"SORTING": 90, "TWO_POINTERS": 95}, ("TWO_POINTERS", 95)),
        (7, 85, {"BINARY_SEARCH": 90, "SORTING": 95}, ("SORTING", 95)),
    ]
    requests = spark.createDataFrame([("c", n, "1475_D", "Cleaning the Phone") for n, *_ in stored], "chunk_id string, solution_index long, id string, title string")
    items = [reply(n, {"GREEDY": str(s), "DP": 10}, greedy_recheck={"candidate_scores": c, "recheck_decision": "KEEP_ORIGINAL"}) for n, s, c, _ in stored]
    replies = spark.createDataFrame([("c", "```json\n" + json.dumps({"solutions": items}) + "\n```")], "chunk_id string, reply string")
    rows, status = J.align_reply(requests, SC.parse_items(replies))
    assert [tuple(r) for r in status.collect()] == [("c", 5, 5, True)]
    got = SC.recheck_rows(rows)
    assert got.columns == V.recheck_columns()
    found = {r.solution_index: (r.recheck_best_candidate, r.recheck_best_score, r.source_broad_score) for r in got.collect()}
    assert found == {n: (*best, s) for n, s, _, best in stored}


def test_recheck_rules(spark):
    """Qualifies by primary tag or score; only its own candidates count; nothing told means 0."""
    broad = {"A": ["x", "y"], "B": ["y"]}
    items = [
        reply(1, {"A": 59, "B": 60}, "A", b_recheck={"candidate_scores": {"x": 99, "y": "7.9"}}),
        reply(2, {"A": 59}, "Z"), reply("bad", {"A": 100}), reply(9, {"A": 100}),
    ]
    requests = spark.createDataFrame([("c", 1, "p"), ("c", 2, "p")], "chunk_id string, solution_index long, id string")
    replies = spark.createDataFrame([("c", json.dumps({"solutions": items}))], "chunk_id string, reply string")
    rows, status = J.align_reply(requests, SC.parse_items(replies, broad))
    assert status.first().ok
    got = SC.recheck_rows(rows, ["A", "B", "x", "y"], broad).orderBy("source_broad_tag").collect()
    assert [(r.source_broad_tag, r.source_broad_score, r.x, r.y, r.recheck_best_candidate, r.recheck_best_score, r.recheck_decision) for r in got] == [
        ("A", 59, None, None, "x", 0, "KEEP_ORIGINAL"), ("B", 60, None, "7.9", "y", 7, "KEEP_ORIGINAL")]


def test_requests_to_rows_plan(spark):
    data = [(7, "p7", "1", "print(1)\n", " ", "#include"), (8, "p8", "x", "a", "b", None)]
    problems = spark.createDataFrame(data, "id long, title string, selected_submission_index string, solution_1 string, solution_2 string, solution_3 string")
    done = spark.createDataFrame([("8_solution_1",)], "problem_solution_key string")
    asked, texts = PS.plan_requests(problems, done, 2, F.col("title"), F.col("code"))
    assert {(r.id, r.solution_index, r.chunk_id) for r in asked.collect()} == {(7, 1, "7:0"), (7, 3, "7:0"), (8, 2, "8:0")}
    assert {r.chunk_id: (r.item_count, r.request) for r in texts.collect()} == {"7:0": (2, "p7\nprint(1)\n#include"), "8:0": (1, "p8\nb")}
    replies = [("7:0", json.dumps({"solutions": [reply(1, {"DP": 85.7}, "DP"), reply(3, {"DP": True})]})), ("8:0", json.dumps(reply(2, {"MATH": None, "DP": "60"})))]
    out = PS.read_replies(asked, spark.createDataFrame(replies, "chunk_id string, reply string"))
    assert {tuple(r) for r in out["status"].collect()} == {("7:0", 2, 2, True), ("8:0", 1, 1, True)}
    scores = N.score_pivot(out["scores"], V.SCORE_TAGS).collect()
    got = {r.problem_solution_key: (r.DP, r.primary_algorithm, r.primary_score, r.solution_language, r.is_selected_solution, r.confidence) for r in scores}
    assert got == {
        "7_solution_1": (85, "DP", 85, "Python", True, "LOW"), "7_solution_3": (1, "UNKNOWN", 0, "C++", False, "LOW"),
        "8_solution_2": (60, "UNKNOWN", 0, "UNKNOWN", False, "LOW"),
    }
    assert {(r.problem_solution_key, r.source_broad_tag) for r in out["recheck"].collect()} == {("7_solution_1", "DP"), ("8_solution_2", "DP")}
    out["rows"].unpersist()


def test_short_reply_keeps_its_rows_but_is_not_ok(spark):
    requests = spark.createDataFrame([("c", 1, "p"), ("c", 2, "p"), ("d", 1, "q")], "chunk_id string, solution_index long, id string")
    replies = spark.createDataFrame([("c", json.dumps({"solutions": [reply("2", {})]})), ("d", "{bad")], "chunk_id string, reply string")
    rows, status = J.align_reply(requests, SC.parse_items(replies))
    assert [r.solution_index for r in rows.collect()] == [2]
    assert {tuple(r) for r in status.collect()} == {("c", 2, 1, False), ("d", 1, 0, False)}


def test_reasons_of_replies_without_a_value(spark):
    df = spark.createDataFrame([(1, "[1]", 1), (2, "x", 1), (3, "[]", 0), (4, "[1]", 2)], "i int, r string, n int")
    assert [r.reason for r in N.parse_reply(df, "r", "array<string>", "n").orderBy("i").collect()] == [None, "UNREADABLE", "EMPTY", "LENGTH"]


def test_golden_metric_table(spark):
    """The stored comparison of 656 pairs: 560 equal primaries; 314 full, 325 partial, 17 no set matches."""
    n = 656
    data = [(f"k{i}", "A", "A" if i < 560 else "B", 1.0 if i < 314 else 0.5 if i < 639 else 0.0) for i in range(n)]
    df = spark.createDataFrame(data, "key string, primary1 string, primary2 string, set_score double")
    got = {r.metric: (r.primary_only, r.q3_set) for r in C.metric_table(df).collect()}
    assert got["full match, count"] == (560, 314) and got["no match, count"] == (96, 17) and got["partial match, count"] == (None, 325)
    assert [round(got["full match, share"][i] * 100, 1) for i in (0, 1)] == [85.4, 47.9]
    assert [round(got["no match, share"][i] * 100, 1) for i in (0, 1)] == [14.6, 2.6]
    assert round(got["partial match, share"][1] * 100, 1) == 49.5 and round(got["mean score"][0], 3) == 0.854


def test_empty_comparison_is_null(spark):
    none = spark.createDataFrame([], "key string, primary1 string, primary2 string")
    assert tuple(C.agreement_rate(none).first()) == (0, 0, None)


def test_change_ties_keep_first_key(spark):
    data = [("k3", "A", "B"), ("k1", "C", "D"), ("k2", "A", "B"), ("k4", "E", "F"), ("k5", "C", "D"), ("k6", "x", "x")]
    df = spark.createDataFrame(data, "key string, primary1 string, primary2 string")
    assert [tuple(r) for r in C.change_pairs(df, 2).collect()] == [("C", "D", 2), ("A", "B", 2)]


def test_compare_runs_plan(spark):
    rnd, tags = random.Random(5), V.SCORE_TAGS[:10]

    def run(shift):
        scores = [(f"p_{i}", tags[(i + shift) % 3], "HIGH", [rnd.randint(0, 100) for _ in tags], V.NO_COMPARISON_MARKER if i % 2 else None) for i in range(40 + shift)]
        return spark.createDataFrame(scores, "problem_solution_key string, primary_algorithm string, confidence string, scores array<long>, compared_with_other_solutions string")

    def recheck(decision):
        return spark.createDataFrame([("p_1", "DP", decision, "BFS")], "problem_solution_key string, source_broad_tag string, recheck_decision string, recheck_best_candidate string")

    tables, pairs = PCmp.compare_runs(run(0), run(1), recheck("KEEP_ORIGINAL"), recheck("REVIEW_NEEDED"), tags)
    try:
        assert {r.side: r.n for r in tables["coverage"].collect()} == {"both": 40, "only_2": 1}
        assert tuple(tables["agreement"].first()) == (40, 0, 0.0)
        assert [(r.marked, r.share) for r in tables["boilerplate"].collect()] == [(20, 0.5)] * 2
        assert tables["recheck_shift"].first().escalated == 1 and tables["rows"].count() == 40
        assert {n: t.count() > 0 for n, t in tables.items()} == dict.fromkeys(tables, True)
    finally:
        pairs.unpersist()


def good_item(index=1, tags=("A", "B", "C", "x"), broad=("A",)):
    """An item that keeps every rule."""
    held = {f: "told" for f in SC.TEXT_FIELDS}
    return {
        "solution_index": index, "algorithm_scores": {t: 50 for t in tags}, "primary_algorithm": "A", "secondary_algorithms": ["B"],
        "is_composite": True, "composite_algorithm": ["A", "B"], "top_3_algorithms": [{"tag": t, "score": 100} for t in "ABC"],
        "confidence": "LOW", **held,
        **{SC.recheck_field(b): {"candidate_scores": {"x": 0}, "recheck_decision": "KEEP_ORIGINAL", "recheck_reason": ""} for b in broad},
    }


def broken(spark, *replies):
    df = spark.createDataFrame([(str(i), r if isinstance(r, str) else json.dumps(r)) for i, r in enumerate(replies)], "chunk_id string, reply string")
    status = spark.createDataFrame([("0", True), ("1", False)], "chunk_id string, ok boolean")
    got = {r.rule: r.violations for r in SC.contract_check(df, status, ["A", "B", "C", "x"], {"A": ["x"]}).collect()}
    assert got.pop("reply_length") == 1
    return {rule: n for rule, n in got.items() if n}


def test_a_reply_that_keeps_the_contract(spark):
    assert broken(spark, {"solutions": [good_item(), good_item(2)]}, {"solutions": []}) == {}


def test_each_rule_of_the_contract(spark):
    def changed(**fields):
        item = good_item()
        for name, value in fields.items():
            if value is None:
                del item[name]
            else:
                item[name] = value
        return {"solutions": [item]}

    scores = {"A": 1, "B": 2, "C": 3, "x": 4}
    block = good_item()["a_recheck"]
    cases = {
        "field_missing": changed(confidence=None), "field_type": changed(solution_index="1"), "score_missing": changed(algorithm_scores={"A": 1, "B": 1, "C": 1}),
        "score_type": changed(algorithm_scores={**scores, "A": "1"}), "score_whole": changed(algorithm_scores={**scores, "A": 1.5}),
        "score_range": changed(algorithm_scores={**scores, "A": 101}), "tag_vocabulary": changed(secondary_algorithms=["Z"]),
        "top_three_size": changed(top_3_algorithms=[{"tag": "A", "score": 1}] * 2), "top_three_tag": changed(top_3_algorithms=[{"tag": t, "score": 1} for t in "ABZ"]),
        "top_three_score": changed(top_3_algorithms=[{"tag": "A"}, {"tag": "B", "score": 1}, {"tag": "C", "score": 1}]),
        "confidence_list": changed(confidence="SURE"), "combination_size": changed(composite_algorithm=["A", "B", "C"]),
        "decision_list": changed(a_recheck={**block, "recheck_decision": "MAYBE"}), "candidate_missing": changed(a_recheck={**block, "candidate_scores": {}}),
        "candidate_type": changed(a_recheck={**block, "candidate_scores": {"x": "5"}}), "candidate_whole": changed(a_recheck={**block, "candidate_scores": {"x": 5.5}}),
        "candidate_range": changed(a_recheck={**block, "candidate_scores": {"x": -1}}),
        "reason_missing": changed(a_recheck={k: v for k, v in block.items() if k != "recheck_reason"}),
    }
    found = broken(spark, *cases.values())
    assert found == {rule: 1 for rule in cases}
    assert broken(spark, "{cut", "[1]", "5", '{"solutions": 7}') == {"unreadable": 4}
    assert broken(spark, changed(algorithm_scores={**scores, "Q": 1})) == {"tag_vocabulary": 1}
    assert broken(spark, {"solutions": [1, None, good_item()]}) == {}  # items that are no objects count by length only
