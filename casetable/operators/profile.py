"""Totals, distribution measures and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from casetable.operators.order import running
from casetable.session import settle


def corpus_totals(df: DataFrame) -> DataFrame:
    """Problems, summed list lengths, and problems whose lists differ in length."""
    n, unequal = F.count(F.lit(1)), F.count_if(~F.col("count_same"))
    return df.agg(
        n.alias("problems"),
        F.coalesce(F.sum("count_input"), F.lit(0)).alias("inputs"),
        F.coalesce(F.sum("count_output"), F.lit(0)).alias("outputs"),
        unequal.alias("unequal"),
        F.try_divide(unequal, n).alias("unequal_share"),
    )


def describe(df: DataFrame, col: str) -> DataFrame:
    """Mean, extremes and exact quartiles (linear between neighbours) of a column, in one row.

    Quartiles come from running counts over the distinct values, so neither the rows nor the
    distinct values are ever held in one task.
    """
    values = df.where(F.col(col).isNotNull()).select(F.col(col).alias("_v"))
    counts = values.groupBy("_v").agg(F.count(F.lit(1)).alias("_n"))
    placed = running(counts, [], ["_v"], {"_upto": F.col("_n")}, position="_at")
    last = (placed.agg(F.max("_upto")).first()[0] or 1) - 1  # one number, from settled rows

    def value_at(rank: int) -> Column:
        return F.min(F.when(F.col("_upto") > rank, F.col("_v")))

    ranked, named = [], []
    for name, quarter in (("q1", 1), ("median", 2), ("q3", 3)):
        at, part = divmod(last * quarter, 4)
        ranked += [value_at(at).alias(f"_{name}_lo"), value_at(at + (part > 0)).alias(f"_{name}_hi")]
        lo, hi = F.col(f"_{name}_lo"), F.col(f"_{name}_hi")
        named.append((lo + (hi - lo) * F.lit(part / 4)).cast("double").alias(name))
    one = placed.agg(
        F.sum("_n").alias("_rows"), F.sum(F.col("_v") * F.col("_n")).alias("_sum"),
        F.min("_v").alias("min"), F.max("_v").alias("max"), *ranked,
    )
    return one.select(
        F.try_divide("_sum", "_rows").cast("double").alias("mean"),
        F.col("min").cast("double").alias("min"), *named, F.col("max").cast("double").alias("max"),
    )


def range_filter(df: DataFrame, col: str, lo: float, hi: float) -> DataFrame:
    """Rows with ``lo`` to ``hi``, both included; totals and ``describe`` take it as is."""
    return df.where(F.col(col).between(lo, hi))


def histogram(df: DataFrame, col: str, width: int) -> DataFrame:
    """Rows per bin of ``width``, bins counted from the minimum; bins without rows are left out.

    The table is read once, to count each value; the minimum and the bins come from these counts.
    """
    counts = settle(df.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    low = counts.agg(F.min("_v")).scalar()
    bin_no = F.floor((F.col("_v") - low) / width).cast("bigint")
    counted = counts.groupBy(bin_no.alias("bin_no")).agg(F.sum("_n").alias("n"))
    start = (low + F.col("bin_no") * width).cast("double")
    return counted.select("bin_no", start.alias("bin_start"), (start + width).alias("bin_end"), "n")


def merge_counts(kept: DataFrame, rejects: DataFrame) -> DataFrame:
    """Kept and rejected ids per reason."""
    rows = kept.select(F.lit("kept").alias("reason")).unionByName(rejects.select("reason"))
    return rows.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def merge_examples(rejects: DataFrame, key: str, k: int = 10) -> DataFrame:
    """The first ``k`` ids of every reject reason."""
    place = F.row_number().over(W.partitionBy("reason").orderBy(key))
    # Spark cuts each reason to k rows before the shuffle
    return rejects.withColumn("place", place).where(F.col("place") <= k).select(
        "reason", key, F.col("place").cast("bigint").alias("place")
    )


def dedup_report(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows before and after ``dedup_first`` by these keys, and how many go: one scan, keys only."""
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    one = counts.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("before"), F.count(F.lit(1)).alias("after"))
    return one.select("before", "after", (F.col("before") - F.col("after")).alias("removed"))


def write_counted(df: DataFrame, path: str, **measures: Column) -> dict:
    """Write a table and return measures of it, taken while it is written and not by a second scan.

    ``rows`` is always among them.
    """
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows"), *[c.alias(n) for n, c in measures.items()]).write.mode("overwrite").parquet(path)
    return seen.get


def log_stats(log: DataFrame, run: str = "run") -> DataFrame:
    """Per run: calls, good and failed ones, seconds per call, wall time and calls per minute."""
    done = log.where(F.col("event") == "chunk_done")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    one = done.groupBy(run).agg(
        F.count(F.lit(1)).alias("calls"), F.count_if(F.col("ok")).alias("ok_count"),
        F.sum("call_elapsed_cs").alias("_cs"), F.max("call_elapsed_cs").alias("_most"),
        (F.max(micros) - F.min(micros)).alias("_wall"),
    )
    wall = F.col("_wall") / F.lit(1000000.0)
    return one.select(
        run, "calls", "ok_count", (F.col("calls") - F.col("ok_count")).alias("failed"),
        (F.col("_cs") / F.col("calls") / F.lit(100.0)).alias("mean_s"), (F.col("_most") / F.lit(100.0)).alias("max_s"),
        wall.alias("wall_s"), F.try_divide(F.col("calls") * F.lit(60.0), wall).alias("calls_per_minute"),
    )
