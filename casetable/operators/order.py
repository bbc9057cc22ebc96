"""Order-dependent operators that do not put a whole group into one task.

A group may hold a large share of the table, so positions and running sums are built in
two levels: rows fall into blocks that follow the order, each block is scanned on its own,
and what came before a block enters it as one carried row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from casetable.functions.text import canonical_id
from casetable.operators.joins import first_rows
from casetable.session import ranged, settle


def range_blocks(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Blocks of about equal size by sampled ranges of the keys.

    The ranges come from a sample, so the rows are settled before their partition is used.
    """
    return settle(ranged(df, *keys)).withColumn("_block", F.spark_partition_id().cast("bigint"))


def width_blocks(df: DataFrame, key: str, width: int) -> DataFrame:
    """Blocks of ``width`` consecutive values of a whole-number key, no extra pass."""
    return df.withColumn("_block", F.floor(F.col(key) / width).cast("bigint"))


def running(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    position: str = "position",
    width: int | None = None,
) -> DataFrame:
    """Position and running sums of each row inside its group, in the given order.

    ``width`` may be given when the first order column is a whole number that is (nearly)
    unique in its group: blocks then hold at most about ``width`` rows by construction.
    Otherwise blocks are sampled ranges of group and order, balanced for any key.
    """
    sums = dict(sums or {})
    blocks = width_blocks(df, order[0], width) if width else range_blocks(df, [*group, *order])
    steps = {position: F.lit(1).cast("bigint"), **sums}
    rows = blocks.withColumns({f"_step_{n}": c for n, c in steps.items()}).withColumn("_head", F.lit(False))

    totals = rows.groupBy(*group, "_block").agg(
        *[F.sum(f"_step_{n}").alias(f"_step_{n}") for n in steps]
    )
    earlier = W.partitionBy(*group).orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    heads = totals.select(
        *group,
        "_block",
        *[F.sum(f"_step_{n}").over(earlier).alias(f"_step_{n}") for n in steps],
        F.lit(True).alias("_head"),
    ).where(F.col(f"_step_{position}").isNotNull())

    scan = (
        W.partitionBy(*group, "_block")
        .orderBy(F.col("_head").desc(), *order)
        .rowsBetween(W.unboundedPreceding, W.currentRow)
    )
    return (
        rows.unionByName(heads, allowMissingColumns=True)
        .select(
            *df.columns,
            "_head",
            *[F.sum(f"_step_{n}").over(scan).alias(n) for n in steps],
        )
        .where(~F.col("_head"))
        .drop("_head")
    )


def sort_numeric(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sort by ids held as text, as numbers, unreadable ones last."""
    return df.orderBy(*[canonical_id(F.col(c)).asc_nulls_last() for c in cols])


def dedup_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Of the rows with equal keys, null keys included, the one with the lowest order.

    Rows without an order come last; remaining ties go by a hash of the other columns.
    """
    return first_rows(df, keys, order)


def union_shards(shards: Sequence[DataFrame]) -> DataFrame:
    whole = shards[0]
    for shard in shards[1:]:
        whole = whole.unionByName(shard, allowMissingColumns=True)
    return whole


def key_intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def key_except(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).subtract(b.select(*keys))


def chunk_rows(
    df: DataFrame, group: Sequence[str], order: Sequence[str], n: int, width: int | None = None
) -> DataFrame:
    """Consecutive chunks of ``n`` rows inside each group: ``chunk_no`` and ``item_no`` from 0."""
    placed = running(df, group, order, position="_at", width=width)
    at = F.col("_at") - 1
    return placed.withColumns(
        {"chunk_no": F.floor(at / n).cast("bigint"), "item_no": (at % n).cast("bigint")}
    ).drop("_at")


def renumber_typed(
    items: DataFrame, plan: Sequence[tuple[str, int]], problems: DataFrame, key: str = "problem_id",
    type_col: str = "type", order: Sequence[str] = ("item_no",), value: str = "input",
) -> DataFrame:
    """Every problem gets, per type of the plan, up to ``count`` items numbered from the type's start.

    A type with no item at all (the reply failed) is filled with ``#ERROR`` rows. ``items``
    beyond the count are left out, as the plan asks for no more.
    """
    starts, at = [], 1
    for name, count in plan:
        starts.append((name, at, count))
        at += count
    slots = F.array(*[
        F.struct(F.lit(n).alias(type_col), F.lit(s).cast("bigint").alias("_start"), F.lit(c).cast("bigint").alias("_count"))
        for n, s, c in starts
    ])
    limits = F.create_map(*[x for n, _, c in starts for x in (F.lit(n), F.lit(c).cast("bigint"))])
    firsts = F.create_map(*[x for n, s, _ in starts for x in (F.lit(n), F.lit(s).cast("bigint"))])
    most = max(count for _, count in plan)

    place = F.row_number().over(W.partitionBy(key, type_col).orderBy(*order))
    kept = (
        items.withColumn("_n", place)
        .where(F.col("_n") <= most)  # lets Spark cut each group before the shuffle
        .where(F.col("_n") <= F.try_element_at(limits, F.col(type_col)))
        .select(
            key,
            type_col,
            (F.try_element_at(firsts, F.col(type_col)) + F.col("_n") - 1).cast("bigint").alias("testcase_order"),
            F.col(value),
        )
    )
    wanted = problems.select(key, F.inline(slots))
    failed = (
        wanted.join(kept.select(key, type_col).distinct(), [key, type_col], "left_anti")
        .select(
            key,
            type_col,
            F.explode(F.sequence(F.col("_start"), F.col("_start") + F.col("_count") - 1)).alias("testcase_order"),
            F.lit("#ERROR").alias(value),
        )
    )
    return kept.join(problems.select(key), key, "left_semi").unionByName(failed)


def running_totals(log: DataFrame, run: str = "run", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """Done and ok counts and time spent so far in each run, in completion order."""
    done = log.where(F.col("event") == "chunk_done")
    return running(
        done, [run], order,
        {"ok_so_far": F.col("ok").cast("bigint"), "elapsed_so_far": F.col("call_elapsed_cs")},
        position="done_so_far",
    )


#: What an every-n summary tells, for tables and streams alike.
SUMMARY_SCHEMA = (
    "group_no bigint, done_so_far bigint, ok_so_far bigint, ok_count bigint, mean_s double, progress string, "
    "elapsed_min double, failed string"
)


def every_n_summary(log: DataFrame, n: int, run: str = "run", order: Sequence[str] = ("ts", "seq")) -> DataFrame:
    """One row per ``n`` finished events of a run; a last group below ``n`` gives none.

    ``progress`` and ``elapsed_min`` are those of the group's last event, ``failed`` names the failed
    events of the group in order, each as ``problem#[indices]``.
    """
    placed = running_totals(log, run, order).withColumn("group_no", F.floor((F.col("done_so_far") - 1) / n).cast("bigint"))
    named = F.concat(
        F.col("problem_id").cast("string"), F.lit("#["),
        F.array_join(F.transform("solution_indices", lambda i: i.cast("string")), ", "), F.lit("]"),
    )
    failed = F.when(~F.col("ok"), F.struct("done_so_far", F.coalesce(named, F.lit("")).alias("name")))
    last = F.max(F.struct("done_so_far", "progress", "total_elapsed_cs"))
    # at most n rows of a group by construction, so the list of failures is bounded
    return (
        placed.groupBy(run, "group_no")
        .agg(
            F.count(F.lit(1)).alias("_n"), last.alias("_last"),
            F.max("ok_so_far").alias("ok_so_far"),
            F.sum(F.col("ok").cast("bigint")).alias("ok_count"),
            F.sum("call_elapsed_cs").alias("_cs"),
            F.array_sort(F.collect_list(failed)).alias("_failed"),
        )
        .where(F.col("_n") == n)
        .select(
            run, "group_no", "_last.done_so_far", "ok_so_far", "ok_count",
            (F.col("_cs") / F.lit(n) / F.lit(100.0)).alias("mean_s"), "_last.progress",
            (F.col("_last.total_elapsed_cs") / F.lit(6000.0)).alias("elapsed_min"),
            F.array_join(F.transform("_failed", lambda x: x["name"]), ", ").alias("failed"),
        )
    )
