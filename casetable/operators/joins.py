"""Joins by equal keys: semi, anti, lookups, overlays, coverage, grids and reply alignment.

No side is broadcast by hint. Spark broadcasts by measured size, and splits a hot key of a
sort-merge join at run time (`spark.sql.adaptive.skewJoin.enabled`), see ``join_spread``.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casetable.functions.json_cells import is_list_literal, strip_fence, whole_json
from casetable.functions.text import fill_status, loose_int, number_or_null


def join_spread(df: DataFrame, grouped: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join rows with a table that was grouped by the same keys, however many rows a key has.

    Spark splits a hot key only where both sides are shuffled by the join itself. A grouped side
    is not: it comes partitioned by its keys already. A hash of the keys as one more key makes
    the join shuffle it once more; it is the small side, one row per key.
    """
    spread = F.hash(*keys)
    return df.withColumn("_spread", spread).join(
        grouped.withColumn("_spread", spread), [*keys, "_spread"], how
    ).drop("_spread")


_TIE_BITS = 60


def place_number(df: DataFrame, order: str, ties: Sequence[str], last: bool = False) -> Column:
    """The place of a row as one number of fixed width: a missing order behind all others, then the order,
    then a hash of the other columns. The smallest number comes first, with ``last`` the highest order."""
    kind, value = df.schema[order].dataType, F.col(order)
    if isinstance(kind, T.TimestampType):
        value = F.unix_micros(value)
    elif isinstance(kind, T.DateType):
        value = F.unix_date(value)
    elif not isinstance(kind, T.IntegralType):
        raise TypeError(f"the order must be whole numbers, dates or timestamps, not {kind.simpleString()}")
    value = value.cast("bigint")
    value = F.bitwise_not(value) if last else value  # falls as the order rises, without overflow
    tie = F.xxhash64(*ties).bitwiseAND(F.lit((1 << _TIE_BITS) - 1)) if ties else F.lit(0).cast("bigint")
    upper = (value.cast("decimal(20,0)") + F.lit(Decimal(1 << 63))) * F.lit(Decimal(1 << _TIE_BITS))
    late = F.lit(Decimal(1 << (64 + _TIE_BITS)))
    return (F.coalesce(upper, late) + tie.cast("decimal(19,0)")).cast("decimal(38,0)")


def first_rows(df: DataFrame, keys: Sequence[str], order: str, last: bool = False, where: Column | None = None) -> DataFrame:
    """One whole row for each key, null keys included: that with the lowest order, or the highest with ``last``.

    Two phases. Keys and places, a number of fixed width, are aggregated by hashing, however wide the rows
    are; then the rows are fetched by key and place, which Spark does without moving them where few keys are
    left. Ties go by a hash of the other columns, rows repeated whole count once, and a missing order comes
    last. ``where`` names the rows that may win.
    """
    ties = [c for c in df.columns if c not in keys and c != order]
    placed = df.withColumn("_place", place_number(df, order, ties, last))
    placed = placed if where is None else placed.where(where)
    best = placed.groupBy(*keys).agg(F.min("_place").alias("_best"))
    best = best.select(*[F.col(k).alias(f"_best_{i}") for i, k in enumerate(keys)], "_best")
    same = F.col("_place") == F.col("_best")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_best_{i}"))
    # the place is a join key as well, so the rows of a hot key are spread by it
    return placed.join(best, same).select(*df.columns).distinct()


def semi_by_id(df: DataFrame, ids: DataFrame, key: str, id_col: str | None = None) -> DataFrame:
    return df.join(ids.select(F.col(id_col or key).alias(key)), key, "left_semi")


def pending(
    work: DataFrame, done: DataFrame, keys: Sequence[str], status: str | None = None,
    retry_errors: bool = False,
) -> DataFrame:
    """Work rows without a finished row. With ``status``, rows whose status is null are not
    finished, nor those with ``ERROR`` when ``retry_errors`` is set."""
    if status is not None:
        finished = F.col(status).isNotNull()
        if retry_errors:
            finished = finished & (F.col(status) != "ERROR")
        done = done.where(finished)
    return work.join(done.select(*keys), list(keys), "left_anti")


def enrich(df: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add the columns of a lookup table that is unique by its keys."""
    return df.join(lookup, list(keys), "left")


def overlay(base: DataFrame, over: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Non-null overlay values win; unknown keys and columns of the overlay are ignored.

    A key that comes twice in the overlay stops the job; keys that are null match nothing.
    """
    shared = [c for c in over.columns if c in base.columns and c not in keys]
    # keys are counted on their own; the overlay's cells are only moved by the joins
    once = over.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    told = F.when(F.col("_n") == 1, F.lit(True)).otherwise(
        F.raise_error(F.lit("overlay key is not unique")).cast("boolean")
    )
    unique = over.select(*keys, *[F.col(c).alias(f"_over_{c}") for c in shared]).join(once, list(keys)).where(told).drop("_n")
    joined = join_spread(base, unique, keys, "left")
    return joined.select(
        *[F.coalesce(F.col(f"_over_{c}"), F.col(c)).alias(c) if c in shared else F.col(c) for c in base.columns]
    )


def overlay_replace(
    base: DataFrame, over: DataFrame, keys: Sequence[str], cols: Sequence[str], order: str
) -> DataFrame:
    """The overlay's named columns always win, nulls included; its last row by ``order`` counts."""
    last = first_rows(over.select(*keys, order, *cols), keys, order, last=True)
    last = last.select(*keys, *[F.col(c).alias(f"_over_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = join_spread(base, last, keys, "left")
    return joined.select(
        *[F.when(F.col("_hit"), F.col(f"_over_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns]
    )


def key_coverage(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Every key once, with its ``side``: both, only_1 or only_2. One shuffle, no join."""
    marked = a.select(*keys, F.lit(1).alias("_a"), F.lit(0).alias("_b")).unionByName(
        b.select(*keys, F.lit(0).alias("_a"), F.lit(1).alias("_b"))
    )
    seen = marked.groupBy(*keys).agg(F.max("_a").alias("_a"), F.max("_b").alias("_b"))
    side = F.when((F.col("_a") == 1) & (F.col("_b") == 1), "both").when(F.col("_a") == 1, "only_1").otherwise("only_2")
    return seen.select(*keys, side.alias("side"))


def coverage_counts(coverage: DataFrame) -> DataFrame:
    return coverage.groupBy("side").agg(F.count(F.lit(1)).alias("n"))


def pair_runs(a: DataFrame, b: DataFrame, keys: Sequence[str], order: str | None = None) -> DataFrame:
    """Rows of two runs side by side; columns other than the keys end in 1 and 2.

    With ``order`` a run may hold a key more than once, and its last row counts.
    """

    def tagged(df: DataFrame, n: int) -> DataFrame:
        df = df if order is None else first_rows(df, keys, order, last=True).drop(order)
        return df.select(*[F.col(c) if c in keys else F.col(c).alias(f"{c}{n}") for c in df.columns])

    return tagged(a, 1).join(tagged(b, 2), list(keys))


def first_filled(
    shards: DataFrame, key: str, cols: Sequence[str], list_cols: Sequence[str] = (),
    rank: str = "rank", base: int = 0,
) -> tuple[DataFrame, DataFrame]:
    """Per id the base shard's row if fully filled, or the first later fully filled one.

    The base row decides: with a broken list cell or partly filled it is rejected, whatever
    later shards hold. Returns kept rows and rejects with their ``reason``: broken, partial
    or all_empty. Ids the base shard lacks are in neither.
    """
    sound = F.lit(True)
    for c in list_cols:
        sound = sound & is_list_literal(F.col(c))
    is_base, status = F.col(rank) == base, fill_status([F.col(c) for c in cols])
    full = (status == "all") & (F.col(rank) >= base)
    # flags and a place of fixed width are aggregated by hashing; the rows are fetched by key and place
    ties = [c for c in shards.columns if c not in (key, rank)]
    judged = shards.select(
        key, is_base.cast("int").alias("_is_base"), (is_base & ~sound).cast("int").alias("_broken"),
        (is_base & (status == "partial")).cast("int").alias("_partial"),
        F.when(full, place_number(shards, rank, ties)).alias("_place"),
    )
    merged = judged.groupBy(key).agg(
        F.max("_is_base").alias("_is_base"), F.max("_broken").alias("_broken"), F.max("_partial").alias("_partial"),
        F.min("_place").alias("_best"),
    ).where(F.col("_is_base") == 1)
    reason = F.when(F.col("_broken") == 1, "broken").when(F.col("_partial") == 1, "partial").when(F.col("_best").isNull(), "all_empty")
    outcome = merged.select(F.col(key).alias("_key"), "_best", reason.alias("reason"))
    wanted = outcome.where(F.col("reason").isNull()).drop("reason")
    rows = shards.where(full).withColumn("_place", place_number(shards, rank, ties))
    kept = rows.join(wanted, (F.col("_place") == F.col("_best")) & F.col(key).eqNullSafe(F.col("_key"))).select(*shards.columns).distinct()
    return kept, outcome.where(F.col("reason").isNotNull()).select(F.col("_key").alias(key), "reason")


#: Solutions and cases of a problem that one task combines, each.
GRID_BLOCK = 1024


def execution_grid(
    sols: DataFrame, cases: DataFrame, max_order: int | None = None, block: int = GRID_BLOCK
) -> DataFrame:
    """What to run: every case of a problem with each of its solutions, or the first ``max_order``.

    Problems without solutions or without cases drop out. Columns come along as given: hand in
    keys only where texts can be looked up later. A problem with many of both is dealt over tasks on
    both sides: its solutions fall into blocks, its cases as well, and each pair of blocks is a join key.
    A row is repeated once for each block of the other side, ordinary problems have one of each.
    """
    first = sols if max_order is None else sols.where(F.col("solution_order") <= max_order)

    def blocks(df: DataFrame, name: str) -> DataFrame:
        n = F.ceil(F.count(F.lit(1)) / F.lit(block)).cast("int")
        return df.groupBy("problem_id").agg(n.alias(name))

    sizes = blocks(first, "_rows").join(blocks(cases, "_cols"), "problem_id")

    def dealt(df: DataFrame, order: str, own: str, other: str, name: str, other_name: str) -> DataFrame:
        held = join_spread(df, sizes, ["problem_id"])
        return held.select(
            *df.columns, F.pmod(F.xxhash64(order), F.col(own)).cast("int").alias(name),
            F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias(other_name),
        )

    left = dealt(first, "solution_order", "_rows", "_cols", "_row", "_col")
    right = dealt(cases, "testcase_order", "_cols", "_rows", "_col", "_row")
    return left.join(right, ["problem_id", "_row", "_col"]).drop("_row", "_col")


def align_reply(requests: DataFrame, items: DataFrame, chunk: str = "chunk_id") -> tuple[DataFrame, DataFrame]:
    """Reply items matched to the rows asked for, and one status row per chunk.

    ``requests`` has one row per (chunk, solution_index); ``items`` one per reply item, its
    ``solution_index`` still text. Items without a readable or known index are left out; of items
    with one index the first by ``item_no`` counts. A chunk is ok when as many indexes matched as
    were asked for. Matched rows of a chunk that is not ok are kept all the same.
    """
    raw = F.lower(F.trim(F.col("solution_index")))
    index = F.when((raw == "true") | number_or_null(F.col("solution_index")).isNotNull(), loose_int(F.col("solution_index")))
    readable = items.withColumn("solution_index", index).where(F.col("solution_index").isNotNull())
    firsts = readable.groupBy(chunk, "solution_index").agg(F.min("item_no").alias("item_no"))
    readable = readable.join(firsts, [chunk, "solution_index", "item_no"]).drop("item_no")
    rows = requests.join(readable, [chunk, "solution_index"])
    asked = requests.groupBy(chunk).agg(F.count(F.lit(1)).alias("asked"))
    parsed = rows.groupBy(chunk).agg(F.count(F.lit(1)).alias("parsed"))
    status = asked.join(parsed, chunk, "left").withColumn("parsed", F.coalesce("parsed", F.lit(0).cast("bigint")))
    return rows, status.withColumn("ok", F.col("parsed") == F.col("asked"))


def scatter_vector(
    rows: DataFrame, replies: DataFrame, batch: str = "batch_id", pos: str = "item_no",
    reply: str = "reply", name: str = "range_validation",
) -> DataFrame:
    """The i-th value of a batch's reply to the i-th row (from 0): true, false, or ERROR for
    every row of a batch whose reply is missing, unreadable or of another length."""
    sizes = rows.groupBy(batch).agg(F.count(F.lit(1)).alias("_n"))
    values = replies.select(batch, whole_json(strip_fence(F.col(reply)), "array<string>", {}).alias("_values"))
    answers = sizes.join(values, batch, "left").select(
        batch, F.when(F.size("_values") == F.col("_n"), F.col("_values")).alias("_values")
    )
    value = F.get(F.col("_values"), F.col(pos).cast("int"))
    told = F.when(F.col("_values").isNull(), "ERROR").when(value == "true", "true").otherwise("false")
    return join_spread(rows, answers, [batch], "left").withColumn(name, told).drop("_values")
