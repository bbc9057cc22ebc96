"""Hot groups, balanced blocks, plans without a cross product or a Python step."""

from __future__ import annotations

import inspect
import re

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from casetable.drills import all_queries
from casetable.drills.base import Tables
from casetable.operators import joins, judge, keys as K, order as O
from casetable.session import input_bytes, ranged, settle, shared_dir
from casetable.sources.tables import read_corpus

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows has one key, and among them a third one order value."""
    hot = F.col("id") % 3 == 0
    return spark.range(30_000, numPartitions=6).select(
        F.when(hot, 0).otherwise(F.col("id") % 997).alias("g"),
        F.when(hot & (F.col("id") % 9 == 0), 5).otherwise(F.pmod(F.hash("id"), F.lit(400))).alias("ts"),
        "id", (F.col("id") % 4 != 0).alias("ok"),
    )


@pytest.mark.parametrize("width", [None, 500])
def test_running_equals_a_plain_window(skewed, width):
    order = ["id"] if width else ["ts", "id"]
    got = O.running(skewed, ["g"], order, {"good": F.col("ok").cast("bigint")}, width=width)
    w = W.partitionBy("g").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    want = skewed.withColumns({"position": F.count(F.lit(1)).over(w), "good": F.sum(F.col("ok").cast("bigint")).over(w)})
    assert got.columns == want.columns
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_running_without_group_and_with_null_groups(spark):
    df = spark.createDataFrame([(None, 2), (None, 1), (1, 1), (2, None)], "g int, o int")
    got = {(r.g, r.o): r.position for r in O.running(df, ["g"], ["o"]).collect()}
    assert got == {(None, 1): 1, (None, 2): 2, (1, 1): 1, (2, None): 1}
    assert sorted(r.position for r in O.running(df, [], ["o", "g"]).collect()) == [1, 2, 3, 4]
    assert O.running(df.where("o > 9"), ["g"], ["o"]).count() == 0


def test_blocks_split_the_hot_group(spark, skewed):
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # tiny test partitions would be merged again
    try:
        sizes = [r["count"] for r in O.range_blocks(skewed, ["g", "ts", "id"]).groupBy("g", "_block").count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert max(sizes) < 0.3 * 30_000  # one group holds more than a third


@pytest.fixture
def tiny_limits(spark):
    """Run-time limits small enough for a test table to count as large and skewed."""
    limits = {
        "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.shuffle.partitions": "8",
    }
    old = {k: spark.conf.get(k, None) for k in limits}
    for k, v in limits.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _hot_results(spark):
    hot = F.col("id") % 3 == 0
    return spark.range(60_000, numPartitions=6).select(
        F.when(hot, 0).otherwise(F.col("id") % 499 + 1).alias("problem_id"), F.lit(1).alias("solution_order"),
        F.col("id").alias("testcase_order"), (F.col("id") != 59_001).alias("validation"),
    )


def _final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_solution_is_split_at_run_time(spark, tiny_limits):
    got = judge.until_first_failure(_hot_results(spark))
    assert "skew=true" in _final_plan(got)
    assert got.where("problem_id = 0").count() == 59_001 // 3 + 1


def test_hot_overlay_key_is_split_at_run_time(spark, tiny_limits):
    base = _hot_results(spark).withColumn("t", F.lit("old"))
    over = base.select("problem_id").distinct().withColumn("t", F.lit("new"))
    got = joins.overlay(base, over, ["problem_id"])
    assert "skew=true" in _final_plan(got)
    assert got.where("t = 'new'").count() == 60_000


def test_carried_rows_do_not_grow_with_the_table(skewed):
    plan = O.running(skewed, ["g"], ["ts", "id"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


def test_ids_are_dense_for_tied_keys(skewed):
    got = K.assign_ids(skewed, ["ts"], "row_no")
    assert tuple(got.agg(F.min("row_no"), F.max("row_no"), F.count_distinct("row_no")).first()) == (1, 30_000, 30_000)


def test_chunks_never_exceed_their_size(skewed):
    chunks = O.chunk_rows(skewed, ["g"], ["ts", "id"], 7).groupBy("g", "chunk_no").count()
    assert chunks.agg(F.max("count")).first()[0] == 7


def test_settled_rows_use_the_named_folder(spark):
    before = shared_dir(spark)
    assert settle(spark.range(5)).count() == 5 and shared_dir(spark) == before


FORBIDDEN = ["CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"]
LIVE = [n for n in all_queries() if n.startswith("I")]


@pytest.mark.parametrize("name", [n for n in sorted(all_queries()) if n not in LIVE])
def test_plan_has_no_product_and_no_python(spark, name):
    plan = all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not [word for word in FORBIDDEN if word in plan]


def test_top_k_per_group_is_cut_before_the_shuffle(spark):
    for name in ("F29_merge_examples", "G7_renumber_typed", "J1_review_cases"):
        assert "WindowGroupLimit" in all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString(), name


def test_filters_and_columns_reach_the_scan(spark):
    corpus = read_corpus(spark, f"{SF}/documents.parquet", ["doc_id", "lang", "source", "n_chars", "absent"])
    plan = corpus.where("lang = 'en' and n_chars > 1000")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(lang,en)" in plan and "GreaterThan(n_chars,1000)" in plan
    assert re.search(r"ReadSchema: struct<doc_id:bigint,lang:string,source:string,n_chars:bigint>", plan)
    plan = all_queries()["F5_all_pass"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "l_extendedprice" not in plan and "l_shipdate" not in plan


@pytest.mark.parametrize("name", ["G2_dedup_first", "E4_overlay_update", "E5_overlay_replace", "E9_first_filled_rows", "E7_pair_runs"])
def test_winners_are_found_by_hashing(spark, name):
    """Rows are never sorted to aggregate them, however wide they are."""
    plan = all_queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "HashAggregate" in plan


def test_copies_of_one_row_meet_in_parts(spark, tiny_limits):
    """A third of all rows is one row; its copies are dealt over tasks, and one is left."""
    rows = _hot_results(spark).select(
        "problem_id", F.when(F.col("problem_id") == 0, 7).otherwise(F.col("testcase_order")).cast("bigint").alias("n"), F.lit("x" * 50).alias("t")
    )
    got = joins.first_rows(rows, ["problem_id"], "n")
    assert got.count() == 500 and got.where("problem_id = 0").first().n == 7


def test_the_grid_of_a_hot_problem_is_dealt_over_tasks(spark):
    """One problem holds a third of both tables: 300 solutions and 400 cases of 900 and 1200."""

    def table(n, order):
        hot = F.col("id") % 3 == 0
        return spark.range(n).select(F.when(hot, 0).otherwise(F.col("id") % 40 + 1).alias("problem_id"), F.col("id").alias(order))

    sols, cases = table(900, "solution_order"), table(1200, "testcase_order")
    want = sols.join(cases, "problem_id").orderBy("problem_id", "solution_order", "testcase_order").collect()
    got = joins.execution_grid(sols, cases, block=50)
    assert got.orderBy("problem_id", "solution_order", "testcase_order").collect() == want and len(want) > 120_000
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    try:
        parts = joins.execution_grid(sols, cases, block=50).where("problem_id = 0").groupBy(F.spark_partition_id()).count().collect()
    finally:
        for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(parts) > 8 and max(r["count"] for r in parts) < 120_000 / 3
    assert joins.execution_grid(sols.limit(0), cases).count() == 0


@pytest.mark.parametrize("mega", [1, 4])
def test_blocks_follow_the_size_of_the_input(spark, tmp_path, mega):
    """The largest block holds a bounded number of bytes at either size."""
    spark.range(mega * 100_000).select("id", F.md5(F.col("id").cast("string")).alias("t")).write.parquet(f"{tmp_path}/t")
    df = spark.read.parquet(f"{tmp_path}/t")
    size = input_bytes(df)
    block = 400_000
    old = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        ranges = ranged(df, "id", block_bytes=block)
        counts = [r["count"] for r in ranges.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
    assert size > mega * 2_000_000 and len(counts) >= size // block
    assert max(counts) * size / (mega * 100_000) < 2 * block
    assert K.assign_ids(df, ["t"], "n").agg(F.max("n")).first()[0] == mega * 100_000


def test_a_report_of_removed_rows_reads_its_table_once(spark):
    plan = all_queries()["F30_dedup_report"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1


def test_a_histogram_reads_its_table_once(spark):
    plan = all_queries()["F4_histogram_lines"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan  # the values are counted by then


def test_cells_are_parsed_once(spark):
    plan = all_queries()["D3_explode_cases"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("from_json") == 2  # the JSON reading and the literal reading behind it


def test_no_driver_side_rows_in_the_library():
    from casetable.operators import cleaning, columns, compare, joins, judge, nested, requests, review, scoring

    for module in (cleaning, columns, compare, joins, judge, nested, requests, review, scoring):
        assert not re.search(r"\.(collect|toPandas|toLocalIterator|localCheckpoint)\(", inspect.getsource(module)), module.__name__


def test_unknown_table_is_refused(spark):
    with pytest.raises(AttributeError):
        Tables(spark, SF).nothing
