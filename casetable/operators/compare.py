"""Two scoring runs side by side.

``pairs`` has one row per key: ``primary``, ``confidence``, ``scores`` and, where asked for,
``note``, each ending in 1 or 2. Scores are arrays in tag order, so per-row measures need no
shuffle; per-table measures are single aggregates.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetable import vocab as V
from casetable.functions.score_sets import first_highest, q3_tags, score_gaps, set_score


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def _rows() -> Column:
    return F.count(F.lit(1))


def agreement_rate(pairs: DataFrame, a: str = "primary1", b: str = "primary2") -> DataFrame:
    """Pairs, equal ones and their share; the share of no pairs is null."""
    hits = F.count_if(_same(a, b))
    return pairs.agg(_rows().alias("pairs"), hits.alias("matches"), F.try_divide(hits, _rows()).alias("rate"))


def change_pairs(pairs: DataFrame, k: int = 15, a: str = "primary1", b: str = "primary2", key: str = "key") -> DataFrame:
    """The ``k`` most common changes; equal counts go by the lowest key that changed so."""
    changed = pairs.where(~_same(a, b)).groupBy(F.col(a).alias("from_tag"), F.col(b).alias("to_tag"))
    return (
        changed.agg(_rows().alias("n"), F.min(key).alias("_first"))
        .orderBy(F.col("n").desc(), "_first")
        .limit(k)
        .drop("_first")
    )


def crosstab(
    pairs: DataFrame, a: str = "confidence1", b: str = "confidence2",
    levels: Sequence[str] = tuple(V.CONFIDENCE_LEVELS),
) -> DataFrame:
    """Counts of level by level, zero filled. One aggregate with a counter per cell."""
    cells = [(x, y, f"_c{i}_{j}") for i, x in enumerate(levels) for j, y in enumerate(levels)]
    one = pairs.agg(*[F.count_if((F.col(a) == x) & (F.col(b) == y)).alias(n) for x, y, n in cells])
    table = [
        F.struct(F.lit(x).alias("level"), *[F.col(n).alias(y) for x2, y, n in cells if x2 == x]) for x in levels
    ]
    return one.select(F.inline(F.array(*table)))


def marginals(pairs: DataFrame, a: str = "confidence1", b: str = "confidence2") -> DataFrame:
    both = F.array(
        F.struct(F.lit(1).cast("bigint").alias("run"), F.col(a).alias("level")),
        F.struct(F.lit(2).cast("bigint").alias("run"), F.col(b).alias("level")),
    )
    return pairs.select(F.inline(both)).groupBy("run", "level").agg(_rows().alias("n"))


def _gap_sums(pairs: DataFrame, tags: Sequence[str], a: str, b: str) -> DataFrame:
    """One row: pairs, and the summed score gap of every tag. Nothing is exploded."""
    gaps = pairs.select(score_gaps(F.col(a), F.col(b)).alias("_gaps"))
    return gaps.agg(
        _rows().alias("_pairs"), *[F.sum(F.get("_gaps", i)).alias(f"_g{i}") for i in range(len(tags))]
    )


def tag_drift(
    pairs: DataFrame, tags: Sequence[str], k: int = 15, a: str = "scores1", b: str = "scores2"
) -> DataFrame:
    """The ``k`` tags with the highest mean absolute score difference; ties go by tag order."""
    rows = [
        F.struct(F.lit(i).alias("_i"), F.lit(t).alias("tag"), (F.col(f"_g{i}") / F.col("_pairs")).alias("mean_diff"))
        for i, t in enumerate(tags)
    ]
    return (
        _gap_sums(pairs, tags, a, b)
        .select(F.inline(F.array(*rows)))
        .orderBy(F.col("mean_diff").desc(), "_i")
        .limit(k)
        .drop("_i")
    )


def overall_drift(pairs: DataFrame, tags: Sequence[str], a: str = "scores1", b: str = "scores2") -> DataFrame:
    whole = sum((F.col(f"_g{i}") for i in range(len(tags))), F.lit(0).cast("bigint"))
    return _gap_sums(pairs, tags, a, b).select(
        F.try_divide(whole, F.col("_pairs") * len(tags)).alias("mean_diff")
    )


def has_marker(col: str, marker: str) -> Column:
    return F.coalesce(F.contains(F.col(col), F.lit(marker)), F.lit(False))


def row_diff(pairs: DataFrame, tags: Sequence[str], marker: str = V.NO_COMPARISON_MARKER) -> DataFrame:
    """Per key: what changed between the runs, the largest score gap and the mean gap, unrounded."""
    held = pairs.withColumn("_gaps", score_gaps(F.col("scores1"), F.col("scores2"))).withColumn(
        "_top", first_highest(F.col("_gaps"), tags)
    )
    total = F.aggregate("_gaps", F.lit(0).cast("bigint"), lambda s, x: s + x)
    return held.select(
        "key", "primary1", "primary2", _same("primary1", "primary2").alias("primary_match"),
        "confidence1", "confidence2",
        F.col("_top.score").alias("max_tag_diff"), F.col("_top.tag").alias("max_tag_diff_tag"),
        (total / F.size("_gaps")).alias("avg_tag_diff"),
        has_marker("note1", marker).alias("boilerplate1"), has_marker("note2", marker).alias("boilerplate2"),
    )


def marker_share(pairs: DataFrame, marker: str = V.NO_COMPARISON_MARKER) -> DataFrame:
    """Rows whose note holds the marker, and their share, per run."""
    one = pairs.agg(
        _rows().alias("_n"), *[F.count_if(has_marker(f"note{r}", marker)).alias(f"_m{r}") for r in (1, 2)]
    )
    rows = [
        F.struct(
            F.lit(r).cast("bigint").alias("run"), F.col(f"_m{r}").alias("marked"), F.col("_n").alias("total"),
            F.try_divide(F.col(f"_m{r}"), F.col("_n")).alias("share"),
        )
        for r in (1, 2)
    ]
    return one.select(F.inline(F.array(*rows)))


def with_q3_sets(pairs: DataFrame, tags: Sequence[str]) -> DataFrame:
    """``set1``, ``set2`` and their ``set_score``."""
    sets = pairs.withColumns(
        {"set1": q3_tags(F.col("scores1"), tags), "set2": q3_tags(F.col("scores2"), tags)}
    )
    return sets.withColumn("set_score", set_score(F.col("set1"), F.col("set2")))


def _match_counts() -> dict[str, Column]:
    full, none = F.col("set_score") >= V.FULL_MATCH, F.col("set_score") <= V.NO_MATCH
    return {
        "full_match": F.count_if(full),
        "partial_match": F.count_if(~full & ~none),
        "no_match": F.count_if(none),
    }


def set_summary(scored: DataFrame) -> DataFrame:
    """Mean set score, full, partial and no matches, mean set sizes. Wants ``with_q3_sets``."""
    return scored.agg(
        _rows().alias("pairs"),
        # exact decimals: the sum does not depend on the order of the rows
        (F.sum(F.col("set_score").cast("decimal(18,12)")).cast("double") / _rows()).alias("mean_score"),
        *[c.alias(n) for n, c in _match_counts().items()],
        (F.sum(F.size("set1")) / _rows()).alias("mean_size1"),
        (F.sum(F.size("set2")) / _rows()).alias("mean_size2"),
    )


def lowest_pairs(scored: DataFrame, k: int = 7) -> DataFrame:
    """The ``k`` lowest set scores below 1, ties by key."""
    # the k lowest first, then those below 1: a filter before would score every pair twice
    below = scored.orderBy("set_score", "key").limit(k).where(F.col("set_score") < 1)
    return below.select(
        "key", "set_score",
        F.array_join(F.array_sort("set1"), ",").alias("tags1"),
        F.array_join(F.array_sort("set2"), ",").alias("tags2"),
    )


def metric_table(scored: DataFrame) -> DataFrame:
    """Seven measures of the primary tag alone and of the tag sets; null where not defined."""
    one = scored.agg(
        _rows().alias("n"),
        F.count_if(_same("primary1", "primary2")).alias("p_full"),
        (F.sum(F.col("set_score").cast("decimal(18,12)")).cast("double") / _rows()).alias("s_mean"),
        *[c.alias(f"s_{n}") for n, c in _match_counts().items()],
    )
    n, p_full = F.col("n"), F.col("p_full")
    undefined = F.lit(None).cast("double")
    measures = [
        ("full match, count", p_full, F.col("s_full_match")),
        ("full match, share", F.try_divide(p_full, n), F.try_divide("s_full_match", n)),
        ("partial match, count", undefined, F.col("s_partial_match")),
        ("partial match, share", undefined, F.try_divide("s_partial_match", n)),
        ("no match, count", n - p_full, F.col("s_no_match")),
        ("no match, share", F.try_divide(n - p_full, n), F.try_divide("s_no_match", n)),
        ("mean score", F.try_divide(p_full, n), F.col("s_mean")),
    ]
    rows = [
        F.struct(F.lit(m).alias("metric"), p.cast("double").alias("primary_only"), s.cast("double").alias("q3_set"))
        for m, p, s in measures
    ]
    return one.select(F.inline(F.array(*rows)))


def decision_shift(pairs: DataFrame) -> DataFrame:
    """Paired recheck rows: equal best candidates, and decisions made stricter or relaxed."""
    keep = V.DECISIONS[0]
    was, now = F.col("recheck_decision1"), F.col("recheck_decision2")
    hits = F.count_if(_same("recheck_best_candidate1", "recheck_best_candidate2"))
    return pairs.agg(
        _rows().alias("pairs"), hits.alias("same_candidate"), F.try_divide(hits, _rows()).alias("candidate_rate"),
        F.count_if((was == keep) & now.isin(*V.DECISIONS[1:])).alias("escalated"),
        F.count_if(was.isin(*V.DECISIONS[1:]) & (now == keep)).alias("relaxed"),
    )


def broad_tag_counts(pairs: DataFrame, tag: str = "source_broad_tag") -> DataFrame:
    return pairs.groupBy(tag).agg(_rows().alias("n"))
