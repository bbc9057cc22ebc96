"""Ids, slices, samples and key checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from casetable.functions.text import canonical_id, has_all_digits
from casetable.session import ranged, settle

_IN_PARTITION = (1 << 33) - 1


def assign_ids(df: DataFrame, order: Sequence[str], name: str = "id") -> DataFrame:
    """Ids 1..n in the given order, without a one-partition sort: one range shuffle, then ``number_rows``."""
    return number_rows(ranged(df, *order).sortWithinPartitions(*order), name)


def number_rows(df: DataFrame, name: str = "id") -> DataFrame:
    """Ids 1..n in the order in which the rows stand.

    A row's id is its place in its partition plus the size of the partitions before it. Only the
    partition sizes, one row each, are added up in one place.
    """
    placed = settle(df).withColumn("_at", F.monotonically_increasing_id())
    placed = placed.withColumns(
        {"_part": F.shiftright("_at", 33), "_place": F.col("_at").bitwiseAND(F.lit(_IN_PARTITION))}
    )
    before = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_size"))
    starts = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    # bounded: one row per partition
    return placed.join(F.broadcast(starts), "_part").select(
        (F.col("_start") + F.col("_place") + 1).cast("bigint").alias(name), *df.columns
    )


def slice_range(df: DataFrame, start: int, end: int | None = None, row: str = "row_no") -> DataFrame:
    """Rows ``start`` to ``end``, counted from 1, both included; the end may lie beyond the table."""
    kept = df.where(F.col(row) >= max(start, 1))
    return kept if end is None else kept.where(F.col(row) <= end)


def preview(df: DataFrame, n: int, row: str = "row_no") -> DataFrame:
    return df.orderBy(row).limit(n)


def sample_after(
    df: DataFrame, offset: int, n: int, seed: int, key: str, row: str = "row_no"
) -> DataFrame:
    """A repeatable sample of up to ``n`` rows after row ``offset``."""
    lot = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return (
        df.where(F.col(row) > offset)
        .withColumn("_lot", lot)
        .orderBy("_lot", key)
        .limit(n)
        .drop("_lot")
    )


def with_canonical_id(df: DataFrame, col: str, name: str | None = None) -> DataFrame:
    return df.withColumn(name or col, canonical_id(F.col(col)))


def keep_digit_ids(df: DataFrame, col: str) -> DataFrame:
    return df.where(has_all_digits(F.col(col)))


def drop_null_id(df: DataFrame, col: str) -> DataFrame:
    return df.na.drop(subset=[col])


def id_quality(df: DataFrame, col: str) -> DataFrame:
    """Rows checked and rows whose id is no number."""
    return df.agg(
        F.count(F.lit(1)).alias("checked"),
        F.count_if(canonical_id(F.col(col)).isNull()).alias("not_numeric"),
    )


def distinct_keys(df: DataFrame, *cols: str | Column) -> DataFrame:
    return df.select(*cols).distinct()
