"""Corpus preparation from end to end. Every plan is lazy; the caller writes the results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable.functions.text import canonical_id
from casetable.operators import columns as C, joins as J, judge as G, nested as N, order as O


def validate_corpus(
    corpus: DataFrame, results: DataFrame, require_complete: bool = True
) -> tuple[DataFrame, DataFrame]:
    """A nested corpus and its stored results to problems with a passing solution, and their cases."""
    problems, cases, sols = N.split_corpus(corpus)
    return G.validated(problems, cases, G.first_passing(results, sols, cases, require_complete))


def public_cases(cases: DataFrame, over: DataFrame, problems: DataFrame, order: str) -> DataFrame:
    """Case table for readers: overlay applied, unknown problems dropped, hidden cases marked.

    Ids may be text on all three sides; rows whose id or order is no number are left out.
    """

    def keyed(df: DataFrame) -> DataFrame:
        ids = {c: canonical_id(F.col(c)) for c in ("problem_id", "testcase_order")}
        return df.withColumns(ids).na.drop(subset=list(ids))

    updated = J.overlay_replace(keyed(cases), keyed(over), ["problem_id", "testcase_order"], ["input", "output"], order)
    known = problems.select(canonical_id(F.col("id")).alias("problem_id")).na.drop()
    return C.to_public_cases(J.semi_by_id(updated, known, "problem_id"))


def merge_flag_shards(shards: Sequence[DataFrame], flags: Sequence[str]) -> DataFrame:
    """Flag tables of several shards as one: ids read as numbers, equal flag rows of a problem
    kept once (the lowest order), false flags blank, sorted."""
    whole = O.union_shards(shards)
    whole = whole.withColumns({c: canonical_id(F.col(c)) for c in ("problem_id", "solution_order")})
    once = O.dedup_first(whole, ["problem_id", *flags], "solution_order")
    return O.sort_numeric(C.blank_false(once, flags), ["problem_id", "solution_order"])
