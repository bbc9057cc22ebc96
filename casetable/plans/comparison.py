"""All comparisons of two score tables over one paired table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable import vocab as V
from casetable.operators import compare as C, joins as J


def paired_scores(run1: DataFrame, run2: DataFrame, key: str = "problem_solution_key") -> DataFrame:
    def slim(df: DataFrame) -> DataFrame:
        return df.select(
            F.col(key).alias("key"), F.col("primary_algorithm").alias("primary"), "confidence", "scores",
            F.col("compared_with_other_solutions").alias("note"),
        )

    return J.pair_runs(slim(run1), slim(run2), ["key"])


def compare_runs(
    run1: DataFrame, run2: DataFrame, recheck1: DataFrame, recheck2: DataFrame,
    tags: Sequence[str] = V.SCORE_TAGS, marker: str = V.NO_COMPARISON_MARKER,
) -> tuple[dict[str, DataFrame], DataFrame]:
    """Named comparison tables, and the paired table they share.

    The paired table is marked for caching, as many small aggregates read it; unpersist it
    when the tables have been written.
    """
    key, both = "problem_solution_key", ["problem_solution_key", "source_broad_tag"]
    pairs = C.with_q3_sets(paired_scores(run1, run2), tags).persist()
    cols = [*both, "recheck_decision", "recheck_best_candidate"]
    shifts = J.pair_runs(recheck1.select(*cols), recheck2.select(*cols), both)
    tables = {
        "coverage": J.coverage_counts(J.key_coverage(run1, run2, [key])),
        "agreement": C.agreement_rate(pairs),
        "changes": C.change_pairs(pairs),
        "confidence": C.crosstab(pairs),
        "confidence_totals": C.marginals(pairs),
        "drift": C.tag_drift(pairs, tags),
        "drift_overall": C.overall_drift(pairs, tags),
        "boilerplate": C.marker_share(pairs, marker),
        "rows": C.row_diff(pairs, tags, marker),
        "sets": C.set_summary(pairs),
        "lowest": C.lowest_pairs(pairs),
        "recheck_coverage": J.coverage_counts(J.key_coverage(recheck1, recheck2, both)),
        "recheck_shift": C.decision_shift(shifts),
        "recheck_decisions": C.crosstab(shifts, "recheck_decision1", "recheck_decision2", V.DECISIONS),
        "recheck_tags": C.broad_tag_counts(shifts),
        "metrics": C.metric_table(pairs),
    }
    return tables, pairs
