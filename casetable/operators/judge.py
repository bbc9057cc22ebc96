"""Verdicts over stored execution results. Groups are aggregated, never walked."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable.functions.text import blank_if_null, strip_text, tri_state
from casetable.operators.joins import join_spread

SOLUTION = ["problem_id", "solution_order"]


def all_pass(
    results: DataFrame, cases: DataFrame | None = None, require_complete: bool = True
) -> DataFrame:
    """Solutions with no failed and no unknown case; complete ones only, by default."""
    good = F.min(F.coalesce(F.col("validation"), F.lit(False)).cast("int"))
    judged = results.groupBy(*SOLUTION).agg(good.alias("_good"), F.count(F.lit(1)).alias("case_count"))
    passing = judged.where(F.col("_good") == 1).drop("_good")
    if not require_complete:
        return passing
    if cases is None:
        raise ValueError("require_complete needs the case table")
    total = cases.groupBy("problem_id").agg(F.count(F.lit(1)).alias("_total"))
    return join_spread(passing, total, ["problem_id"]).where(F.col("case_count") == F.col("_total")).drop("_total")


def first_passing(
    results: DataFrame, sols: DataFrame, cases: DataFrame | None = None, require_complete: bool = True
) -> DataFrame:
    """The lowest passing solution of each problem that is in the solution table, with its code."""
    passing = all_pass(results, cases, require_complete).select(*SOLUTION)
    # keys only up to the choice; the code texts are shuffled once, by the last join
    known = sols.select(*SOLUTION).join(passing, SOLUTION)
    firsts = known.groupBy("problem_id").agg(F.min("solution_order").alias("solution_order"))
    return sols.join(firsts, SOLUTION).select(*SOLUTION, "solution")


def validated(
    problems: DataFrame, cases: DataFrame, passing: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Problems with a passing solution and its code; their cases, labelled with its order."""
    kept = problems.join(passing.select(F.col("problem_id").alias("id"), "solution"), "id")
    labels = passing.select("problem_id", F.col("solution_order").cast("bigint").alias("validation"))
    return kept, join_spread(cases.drop("validation"), labels, ["problem_id"])


def until_first_failure(results: DataFrame, order: str = "testcase_order") -> DataFrame:
    """Cases up to and including the first failed one of each solution.

    The first failure is an aggregate joined back, so a solution with very many cases is
    not sorted in one task.
    """
    failed = ~F.coalesce(F.col("validation"), F.lit(False))
    stops = results.where(failed).groupBy(*SOLUTION).agg(F.min(order).alias("_stop"))
    return (
        join_spread(results, stops, SOLUTION, "left")
        .where(F.col("_stop").isNull() | (F.col(order) <= F.col("_stop")))
        .drop("_stop")
    )


def verdicts(df: DataFrame) -> DataFrame:
    """MATCH, MISMATCH, ERROR or TIMEOUT from stored output, return code and time-out flag."""
    same = strip_text(blank_if_null(F.col("actual_output"))) == strip_text(blank_if_null(F.col("expected_output")))
    result = (
        F.when(F.col("timed_out"), "TIMEOUT")
        .when(F.col("error"), "ERROR")
        .when(same, "MATCH")
        .otherwise("MISMATCH")
    )
    return df.withColumn("result", result)


def pass_counts(v: DataFrame) -> DataFrame:
    return v.groupBy("problem_id").agg(
        F.count_if(F.col("result") == "MATCH").alias("passed"), F.count(F.lit(1)).alias("total")
    )


def error_counts(df: DataFrame, key: str = "problem_id") -> DataFrame:
    """Generated cases per problem: all, good ones, and ``#ERROR`` ones.

    An ``#ERROR`` input is never run, so it counts as an error whatever the output says.
    """
    bad = (F.col("input") == "#ERROR") | (F.col("output") == "#ERROR")
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(~F.coalesce(bad, F.lit(False))).alias("ok_count"),
        F.count_if(bad).alias("error_count"),
    )


def status_counts(df: DataFrame, keys: Sequence[str], status: str) -> DataFrame:
    """Rows that are TRUE, FALSE and neither, per key."""
    state = df.select(*keys, tri_state(F.col(status)).alias("_state"))
    return state.groupBy(*keys).agg(
        *[F.count_if(F.col("_state") == s).alias(f"{s.lower()}_count") for s in ("TRUE", "FALSE", "ERROR")]
    )


def success_rate(df: DataFrame, key: str = "problem_id", answered: str = "ok", spent: str = "call_elapsed_cs") -> DataFrame:
    """Items answered of items sent, and seconds per item, from hundredths of a second."""
    sent, good = F.count(F.lit(1)), F.count_if(F.col(answered))
    return df.groupBy(key).agg(
        sent.alias("sent"), good.alias("answered"), (good / sent).alias("rate"),
        (F.sum(spent) / sent / F.lit(100.0)).alias("seconds_per_item"),
    )


def zero_groups(df: DataFrame, key: str = "problem_id", count: str = "count") -> DataFrame:
    """Keys whose counts add up to 0; rows without a key are left out."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(count).alias("_sum")).where(
        F.col("_sum") == 0
    ).select(key)


def zero_group_totals(df: DataFrame, key: str = "problem_id", count: str = "count") -> DataFrame:
    """How many keys there are, and how many of them add up to 0."""
    sums = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.sum(count).alias("_sum"))
    return sums.agg(F.count(F.lit(1)).alias("groups"), F.count_if(F.col("_sum") == 0).alias("zero_groups"))
