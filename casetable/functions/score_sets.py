"""Row-local score arithmetic over arrays aligned to one tag list."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetable.functions.text import let, loose_int


def tag_array(tags: Sequence[str]) -> Column:
    return F.array(*[F.lit(t) for t in tags])


def score_vector(raw: Column, tags: Sequence[str]) -> Column:
    """Scores of a text map in tag order; a tag that is missing or no number scores 0."""
    return F.transform(tag_array(tags), lambda t: loose_int(F.try_element_at(raw, t)))


def score_map(scores: Column, tags: Sequence[str]) -> Column:
    return F.map_from_arrays(tag_array(tags), scores)


def upper_quartile(scores: Column) -> Column:
    """Inclusive third quartile of the scores above zero; null when there is none."""

    def cut(a: Column) -> Column:
        steps = (F.size(a) - 1) * 3
        at, part = F.floor(steps / 4).cast("int"), steps % 4
        low = F.get(a, at)
        high = F.coalesce(F.get(a, at + 1), low)
        return (low * (4 - part) + high * part) / F.lit(4.0)

    return let(F.array_sort(F.filter(scores, lambda x: x > 0)), cut)


def q3_tags(scores: Column, tags: Sequence[str]) -> Column:
    """Tags scoring at least the upper quartile of the row's non-zero scores."""
    named = F.zip_with(tag_array(tags), scores, lambda t, s: F.struct(t.alias("tag"), s.alias("score")))
    kept = let(
        upper_quartile(scores),
        lambda cut: F.filter(named, lambda x: (x["score"] > 0) & (x["score"] >= cut)),
    )
    return F.transform(kept, lambda x: x["tag"])


def set_score(a: Column, b: Column) -> Column:
    """Share of the smaller set found in the larger, minus 0.1 per extra tag of the larger."""
    swap = F.size(a) > F.size(b)
    small, large = F.when(swap, b).otherwise(a), F.when(swap, a).otherwise(b)
    share = F.size(F.array_intersect(small, large)) / F.size(small)
    extra = F.lit(0.1) * F.size(F.array_except(large, small))
    return (
        F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
        .when(F.size(small) == 0, F.lit(0.0))
        .otherwise(F.greatest(F.lit(0.0), share - extra))
    )


def score_gaps(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: F.abs(x - y))


def first_highest(values: Column, tags: Sequence[str]) -> Column:
    """``struct(score, tag)`` of the highest value; the first of equals wins."""

    def pick(v: Column) -> Column:
        return let(F.array_max(v), lambda m: F.struct(
            m.alias("score"), F.get(tag_array(tags), (F.array_position(v, m) - 1).cast("int")).alias("tag")
        ))

    return let(values, pick)
