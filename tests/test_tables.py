"""Table operators: layouts, keys, joins, judging."""

from __future__ import annotations

from collections import Counter

import pytest
from pyspark.sql import functions as F

from casetable import vocab as V
from casetable.operators import columns as C, joins as J, judge as G, keys as K, nested as N, order as O
from casetable.operators import profile as P, requests as Q, review as R
from casetable.plans import corpus as PC


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_vocabulary_sizes():
    assert len(V.SCORE_TAGS) == len(set(V.SCORE_TAGS)) == 120
    assert len(V.recheck_tags()) == 28 and len(V.recheck_columns()) == 39
    assert len(V.FLAG_TAGS) == 26 and len(V.score_columns()) == 156


def test_layout_steps(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert C.front_columns(df, ["c", "x", "a"]).columns == ["c", "a", "b"]
    assert C.insert_after(df, "a", {"c": F.lit(9), "d": F.lit(8)}).columns == ["a", "c", "d", "b"]
    assert C.drop_prefix(df.withColumnRenamed("b", "Unnamed: 1"), "Unnamed:").columns == ["a", "c"]
    assert C.ensure_columns(df, {"a": "int", "z": "string"}).columns == ["a", "b", "c", "z"]


def test_corpus_split_edges(spark):
    cells = [
        (1, '{"inputs": ["a", "b", "c"], "outputs": ["x", "y"]}', '["s1", "s2"]'),
        (2, "broken{", "no list"), (3, None, None), (4, "{'inputs': ['a'], 'outputs': ['b']}", "['s']"),
    ]
    df = spark.createDataFrame(cells, "id long, input_output string, solutions string")
    problems, cases, sols = N.split_corpus(df)
    assert rows(problems.select("id", "count_cases", "count_solutions"), "id") == [(1, 3, 2), (2, 0, 0), (3, 0, 0), (4, 1, 1)]
    assert rows(cases.select("problem_id", "testcase_order", "input", "output"), "problem_id", "testcase_order") == [
        (1, 1, "a", "x"), (1, 2, "b", "y"), (4, 1, "a", "b")]
    assert rows(sols.select("problem_id", "solution_order", "solution"), "problem_id", "solution_order") == [
        (1, 1, "s1"), (1, 2, "s2"), (4, 1, "s")]
    without = N.split_corpus(df.drop("solutions"))
    assert rows(without[0].select("count_solutions").distinct()) == [(0,)] and without[2].count() == 0
    assert rows(N.count_io(df).select("id", "count_same"), "id") == [(1, False), (2, True), (3, True), (4, True)]


def test_ids_and_slices(spark):
    df = spark.range(1000).select(F.pmod(F.hash("id"), F.lit(7)).alias("g"), "id")
    numbered = K.assign_ids(df, ["g", "id"], "row_no")
    want = [r.id for r in df.orderBy("g", "id").collect()]
    assert [r.id for r in numbered.orderBy("row_no").collect()] == want
    assert rows(numbered.agg(F.min("row_no"), F.max("row_no"), F.count_distinct("row_no"))) == [(1, 1000, 1000)]
    assert K.slice_range(numbered, 990, 2000).count() == 11 and K.slice_range(numbered, 0).count() == 1000
    assert [r.row_no for r in K.preview(numbered, 3).collect()] == [1, 2, 3]
    sample = lambda seed: {r.id for r in K.sample_after(numbered, 900, 30, seed, "id").collect()}
    late = {r.id for r in numbered.where("row_no > 900").collect()}
    assert sample(1) == sample(1) and len(sample(1)) == 30 and sample(1) <= late and sample(1) != sample(2)
    assert K.sample_after(numbered, 5000, 30, 1, "id").count() == 0  # no switch by size


def test_dedup_keeps_lowest_order_and_groups_nulls(spark):
    data = [(1, 2, True), (1, 1, True), (1, None, True), (1, 3, False), (None, 5, True), (None, 4, True), (2, None, True)]
    df = spark.createDataFrame(data, "problem_id int, solution_order int, f boolean")
    got = O.dedup_first(df, ["problem_id", "f"], "solution_order")
    assert sorted(rows(got), key=str) == sorted([(1, 1, True), (1, 3, False), (None, 4, True), (2, None, True)], key=str)


def test_sort_numeric(spark):
    df = spark.createDataFrame([("10",), ("9.0",), ("x",), (None,), ("2",)], "id string")
    assert [r.id for r in O.sort_numeric(df, ["id"]).collect()][:3] == ["2", "9.0", "10"]


def test_flag_shards_plan(spark):
    a = spark.createDataFrame([("10", "2", True, False), ("2.0", "1", False, False)], "problem_id string, solution_order string, x boolean, y boolean")
    b = spark.createDataFrame([("10", "1", True, False), ("bad", "1", True, True)], a.schema)
    assert rows(PC.merge_flag_shards([a, b], ["x", "y"])) == [(2, 1, "", ""), (10, 1, "True", ""), (None, 1, "True", "True")]


def test_overlay_null_rules(spark):
    base = spark.createDataFrame([(1, "a", 1), (2, "b", 2), (3, None, 3)], "k int, s string, n int")
    over = spark.createDataFrame([(1, None, 9), (3, "z", None), (7, "q", 7)], "k int, s string, n int").withColumn("extra", F.lit(1))
    assert rows(J.overlay(base, over, ["k"]), "k") == [(1, "a", 9), (2, "b", 2), (3, "z", 3)]
    twice = over.unionByName(over)
    with pytest.raises(Exception, match="not unique"):
        J.overlay(base, twice, ["k"]).collect()
    ordered = over.withColumn("r", F.lit(1)).unionByName(over.where("k = 1").withColumns({"n": F.lit(5), "r": F.lit(2)}))
    assert rows(J.overlay_replace(base, ordered, ["k"], ["s", "n"], "r"), "k") == [(1, None, 5), (2, "b", 2), (3, "z", None)]


def test_public_cases_plan(spark):
    cases = spark.createDataFrame(
        [("1", "1", "a", "x", None), ("1.0", "3", "b", "y", None), ("bad", "1", "c", "z", None), ("2", "1", "d", "w", None)],
        "problem_id string, testcase_order string, input string, output string, validation boolean")
    over = spark.createDataFrame([("1.0", "3", "B", None, 1)], "problem_id string, testcase_order string, input string, output string, r int")
    got = PC.public_cases(cases, over, spark.createDataFrame([("1",), (None,)], "id string"), "r")
    assert got.columns == ["problem_id", "testcase_order", "input_text", "expected_output", "is_hidden", "is_deleted"]
    assert rows(got, "testcase_order") == [(1, 1, "a", "x", False, None), (1, 3, "B", None, True, None)]


def test_pending_counts_rows_not_chunks(spark):
    work = spark.createDataFrame([(1,), (2,), (3,), (4,)], "k int")
    done = spark.createDataFrame([(1, "true"), (2, None), (3, "ERROR")], "k int, s string")
    assert rows(J.pending(work, done, ["k"]), "k") == [(4,)]
    assert rows(J.pending(work, done, ["k"], "s"), "k") == [(2,), (4,)]
    assert rows(J.pending(work, done, ["k"], "s", True), "k") == [(2,), (3,), (4,)]


def test_first_filled_follows_the_base_shard(spark):
    good = "['t']"
    data = [
        (1, 0, good, "a", "b"), (1, 1, good, "z", "z"),          # base is filled
        (2, 0, good, None, ""), (2, 1, good, "p", None), (2, 2, good, "c", "d"),  # first later filled one
        (3, 0, good, "a", None), (3, 1, good, "c", "d"),         # partly filled base: rejected
        (4, 0, "[", None, None), (4, 1, good, "c", "d"),         # broken base: rejected
        (5, 0, good, None, None), (5, 1, good, None, "x"),       # nothing filled
        (6, 1, good, "c", "d"),                                  # not in the base
    ]
    kept, rejects = J.first_filled(spark.createDataFrame(data, "id int, rank int, tags string, u string, v string"), "id", ["u", "v"], ["tags"])
    assert rows(kept.select("id", "rank", "u"), "id") == [(1, 0, "a"), (2, 2, "c")]
    assert rows(rejects, "id") == [(3, "partial"), (4, "broken"), (5, "all_empty")]
    assert rows(P.merge_counts(kept, rejects), "reason") == [("all_empty", 1), ("broken", 1), ("kept", 2), ("partial", 1)]


RESULTS = "problem_id int, solution_order int, testcase_order int, validation boolean"


def test_judging(spark):
    data = [(1, 1, 1, True), (1, 1, 2, False), (1, 1, 3, True), (1, 2, 1, True), (1, 2, 2, True), (1, 3, 1, True), (1, 3, 2, True), (1, 3, 3, True),
            (2, 1, 1, None), (2, 2, 1, True)]
    r = spark.createDataFrame(data, RESULTS)
    cases = r.select("problem_id", "testcase_order").distinct()
    sols = r.select("problem_id", "solution_order").distinct().where("not (problem_id = 2 and solution_order = 2)").withColumn("solution", F.lit("c"))
    assert rows(G.all_pass(r, cases), "problem_id", "solution_order") == [(1, 3, 3), (2, 2, 1)]
    assert rows(G.all_pass(r, require_complete=False), "problem_id", "solution_order") == [(1, 2, 2), (1, 3, 3), (2, 2, 1)]
    with pytest.raises(ValueError):
        G.all_pass(r)
    assert rows(G.first_passing(r, sols, cases)) == [(1, 3, "c")]
    assert rows(G.first_passing(r, sols, require_complete=False)) == [(1, 2, "c")]
    assert rows(G.until_first_failure(r).groupBy("problem_id", "solution_order").count(), "problem_id", "solution_order") == [
        (1, 1, 2), (1, 2, 2), (1, 3, 3), (2, 1, 1), (2, 2, 1)]


def test_verdict_order_and_trim(spark):
    data = [("a", "a\n", False, False), ("a", "\tb", False, False), ("a", "a", True, False), ("a", "a", True, True), (None, "", False, False)]
    df = spark.createDataFrame(data, "expected_output string, actual_output string, error boolean, timed_out boolean")
    assert [r.result for r in G.verdicts(df).collect()] == ["MATCH", "MISMATCH", "ERROR", "TIMEOUT", "MATCH"]


def test_zero_groups_skip_null_keys(spark):
    df = spark.createDataFrame([(1, 0), (1, 0), (2, 1), (2, 0), (None, 0)], "problem_id int, count int")
    assert rows(G.zero_groups(df)) == [(1,)] and rows(G.zero_group_totals(df)) == [(2, 1)]


def test_error_input_is_an_error(spark):
    df = spark.createDataFrame([(1, "#ERROR", "5"), (1, "a", "#ERROR"), (1, "a", None)], "problem_id int, input string, output string")
    assert rows(G.error_counts(df)) == [(1, 3, 1, 2)]


def test_describe_and_histogram(spark):
    import statistics

    data = [3, 1, 1, 7, 22, 9, 40, 40]
    df = spark.createDataFrame([(x,) for x in data + [None]], "c int")
    q = statistics.quantiles(data, n=4, method="inclusive")
    assert rows(P.describe(df, "c")) == [(sum(data) / len(data), 1, *q, 40)]
    assert rows(P.describe(df.where("c = 7"), "c")) == [(7, 7, 7, 7, 7, 7)]
    assert rows(P.describe(df.where("c > 99"), "c")) == [(None,) * 6]
    assert rows(P.histogram(df, "c", 10), "bin_no") == [(0, 1, 11, 5), (2, 21, 31, 1), (3, 31, 41, 2)]
    assert rows(P.histogram(df.where("c = 40"), "c", 10)) == [(0, 40, 50, 2)]


def test_renumber_fills_failed_types_only(spark):
    items = spark.createDataFrame([(1, "base", i, f"b{i}") for i in range(5)] + [(1, "edge", 0, "e0"), (9, "base", 0, "?")], "problem_id int, type string, item_no int, input string")
    problems = spark.createDataFrame([(1,), (2,)], "problem_id int")
    got = rows(O.renumber_typed(items, [("base", 3), ("edge", 2)], problems).select("problem_id", "testcase_order", "input"), "problem_id", "testcase_order")
    assert got == [(1, 1, "b0"), (1, 2, "b1"), (1, 3, "b2"), (1, 4, "e0")] + [(2, i, "#ERROR") for i in range(1, 6)]


def test_grid_keeps_first_solutions_only(spark):
    sols = spark.createDataFrame([(1, i, "c") for i in range(1, 9)] + [(2, 1, "c")], "problem_id int, solution_order int, solution string")
    cases = spark.createDataFrame([(1, 1), (1, 2), (3, 1)], "problem_id int, testcase_order int")
    assert J.execution_grid(sols, cases, 5).count() == 10
    assert J.execution_grid(sols, cases).count() == 16  # all of them unless asked otherwise


def test_unpivot_takes_every_numbered_column(spark):
    wide = spark.range(1).select("id", *[F.lit(f"c{i}").alias(f"solution_{i}") for i in range(1, 23)], F.lit("x").alias("solution_note"))
    got = rows(N.unpivot_solutions(wide, ["id"]).select("solution_index", "code"), "solution_index")
    assert got == [(i, f"c{i}") for i in range(1, 23)]


def test_flag_vector_without_usable_order(spark):
    df = spark.createDataFrame([(1, '[{"a": true}, {"solution_order": 3, "b": 1}, {"solution_order": "x", "b": 1}]')], "k int, r string")
    assert rows(N.flag_vector(df, "k", "r", ["a", "b"], "field", "n")) == [(1, 3, 1, False, True)]
    assert [r.n for r in N.flag_vector(df, "k", "r", ["a", "b"], order_name="n").orderBy("n").collect()] == [1, 2, 3]


def test_scatter(spark):
    data = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (3, 0), (4, 0)], "batch_id int, item_no int")
    replies = spark.createDataFrame([(1, "[true, 1]"), (2, "[true, true]"), (3, "oops")], "batch_id int, reply string")
    got = J.scatter_vector(data, replies).orderBy("batch_id", "item_no").collect()
    assert [r.range_validation for r in got] == ["true", "false", "ERROR", "ERROR", "ERROR"]


def test_sample_k_and_review(spark):
    df = spark.range(50)
    items = spark.createDataFrame([(x,) for x in "abcdef"] + [("a",), (None,)], "item string")
    picked = [r.picked for r in Q.sample_k(df, items, 3, 1, "id", "item").collect()]
    assert all(len(set(p)) == 3 for p in picked) and len({tuple(p) for p in picked}) > 10
    again = {r.id: r.picked for r in Q.sample_k(df.repartition(7), items, 3, 1, "id", "item").collect()}
    assert again == {r.id: r.picked for r in Q.sample_k(df, items, 3, 1, "id", "item").collect()}
    assert all(sorted(r.picked) == list("abcdef") for r in Q.sample_k(df, items, 9, 1, "id", "item").collect())  # all there are
    assert {tuple(r.picked) for r in Q.sample_k(df, items.limit(0), 3, 1, "id", "item").collect()} == {()}
    keyless = spark.createDataFrame([(None, 1), (4, 2), (4, 3)], "id long, x int")
    got = {r.x: r.picked for r in Q.sample_k(keyless, items, 2, 1, "id", "item").collect()}
    assert got[1] == [] and got[2] == got[3] and len(got[2]) == 2
    counts = Counter(x for r in Q.sample_k(spark.range(6000), items, 3, 1, "id", "item").collect() for x in r.picked)
    assert all(2700 < n < 3300 for n in counts.values())  # every item is as likely
    cases = spark.createDataFrame([(1, i, "true" if i % 2 else None) for i in range(60)], "problem_id long, testcase_order int, range_validation string")
    problems = spark.createDataFrame([(1, "q")], "id long, question string")
    text, counts, shown = R.review_split(problems, cases, "1.0", k=15)
    assert text.count() == 1 and rows(counts, "state") == [("ERROR", 30), ("TRUE", 30)] and shown.count() == 30


def test_winners_by_every_kind_of_order(spark):
    data = [(1, 5, "2024-01-02", "2024-01-02 00:00:01", "a"), (1, -3, "2024-01-01", "2024-01-03 00:00:01", "b"), (1, None, None, None, "c"),
            (None, 2, "2020-01-01", "2020-01-01 00:00:00", "d"), (None, 2, "2020-01-01", "2020-01-01 00:00:00", "d"), (2, None, None, None, "e"),
            (3, 2**63 - 1, "2020-01-01", "2020-01-01 00:00:00", "f"), (3, -(2**63), "2020-01-02", "2020-01-01 00:00:01", "g")]
    df = spark.createDataFrame(data, "k int, n long, d string, ts string, v string").withColumns({"d": F.col("d").cast("date"), "ts": F.col("ts").cast("timestamp")})

    def won(order, last=False):
        return {r.k: r.v for r in J.first_rows(df, ["k"], order, last).collect()}

    assert won("n") == {1: "b", None: "d", 2: "e", 3: "g"} and won("n", True) == {1: "a", None: "d", 2: "e", 3: "f"}
    assert won("d") == {1: "b", None: "d", 2: "e", 3: "f"} and won("ts", True) == {1: "b", None: "d", 2: "e", 3: "g"}
    assert J.first_rows(df, ["k"], "n").count() == 4
    tied = spark.createDataFrame([(1, 1, str(i)) for i in range(50)], "k int, n int, v string")
    assert J.first_rows(tied, ["k"], "n").count() == 1
    with pytest.raises(TypeError):
        J.first_rows(df, ["k"], "v")


def test_last_row_of_a_repeated_run_key_counts(spark):
    a = spark.createDataFrame([("x", 1, "old"), ("x", 2, "new"), ("y", 1, "a")], "key string, row int, p string")
    b = spark.createDataFrame([("x", 5, "b5"), ("x", 9, "b9"), ("z", 1, "c")], "key string, row int, p string")
    assert rows(J.pair_runs(a, b, ["key"], "row")) == [("x", "new", "b9")]


def test_an_index_given_twice_counts_once(spark):
    requests = spark.createDataFrame([("c", 1), ("c", 2)], "chunk_id string, solution_index long")
    items = spark.createDataFrame([("c", 0, "1", "first"), ("c", 1, "1", "again"), ("c", 2, "x", "?")], "chunk_id string, item_no int, solution_index string, t string")
    got, status = J.align_reply(requests, items)
    assert rows(got.select("solution_index", "t")) == [(1, "first")] and rows(status) == [("c", 2, 1, False)]


def test_dedup_report_counts_null_keys(spark):
    df = spark.createDataFrame([(1,), (1,), (None,), (None,), (2,)], "k int")
    assert rows(P.dedup_report(df, ["k"])) == [(5, 3, 2)] and rows(P.dedup_report(df.limit(0), ["k"])) == [(0, 0, 0)]
