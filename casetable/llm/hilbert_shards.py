"""Sharding along a Hilbert curve, with DataFrame functions only.

Several columns are quantised to whole numbers of a few bits; the place on the Hilbert curve
through that grid orders the rows, and runs of equal length are cut from the order. Rows of a
shard are then close in every dimension, so the smallest and largest values of a shard rule
most shards out for a filter on any of them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from casetable.llm.common import stored
from casetable.operators.keys import assign_ids

BITS = 6
#: Each row counts this much beside its text.
ROW_BYTES = 16


def magnitude_cell(value: Column, bits: int = BITS) -> Column:
    """An order-keeping cell for a number by its magnitude, in half powers of two.

    Null and numbers below 0 fall into cell 0, like 0; the top cell is open to the right.
    """
    whole = F.greatest(F.floor(value).cast("bigint"), F.lit(0).cast("bigint"))
    digits = F.length(F.bin(whole)).cast("bigint")
    half = F.when(whole > 1, F.substring(F.bin(whole), 2, 1).cast("bigint")).otherwise(0)
    cell = F.when(whole > 0, 2 * digits - 1 + half).otherwise(0)
    return F.coalesce(F.least(cell, F.lit((1 << bits) - 1)), F.lit(0)).cast("bigint")


def value_cells(df: DataFrame, col: str, cell: str, bits: int = BITS) -> DataFrame:
    """Add an order-keeping cell for any column by the place of its value among the distinct ones.

    Null gets cell 0. The value table joins as Spark sees fit; hot values are split there.
    """
    ranks = assign_ids(df.select(col).where(F.col(col).isNotNull()).distinct(), [col], "_rank")
    n = max(ranks.count(), 1)
    table = ranks.select(col, F.floor((F.col("_rank") - 1) * (1 << bits) / n).cast("bigint").alias(cell))
    return df.join(table, col, "left").withColumn(cell, F.coalesce(cell, F.lit(0).cast("bigint")))


def hilbert_index(cells: Sequence[Column], bits: int = BITS) -> Column:
    """The place of a grid cell on the Hilbert curve, below ``2 ** (bits * len(cells))``.

    Works on the cell's coordinates from the top bit down: in each step a set bit mirrors the
    lower bits of the first coordinate, a clear bit swaps them with those of its own; a Gray
    code over the coordinates is then undone and their bits are interleaved.
    """
    n = len(cells)
    if bits * n > 62:
        raise ValueError("bits times dimensions must stay below 63")
    steps = F.array(*[F.lit(1 << b).cast("bigint") for b in range(bits - 1, 0, -1)])

    def untwist(at: Column, q: Column) -> Column:
        low = q - 1
        x = [at[i] for i in range(n)]
        for i in range(n):
            is_set = x[i].bitwiseAND(q) != 0
            swap = x[0].bitwiseXOR(x[i]).bitwiseAND(low)
            own = x[i].bitwiseXOR(F.when(is_set, F.lit(0)).otherwise(swap))
            first = x[0].bitwiseXOR(F.when(is_set, low).otherwise(swap))
            if i:
                x[i] = own
            else:
                first = F.when(is_set, first).otherwise(x[0])
            x[0] = first
        return F.array(*x)

    if bits > 1:
        flat = F.aggregate(steps, F.array(*[c.cast("bigint") for c in cells]), untwist)
    else:
        flat = F.array(*[c.cast("bigint") for c in cells])

    def gray(at: Column) -> Column:
        x = [at[0]]
        for i in range(1, n):
            x.append(at[i].bitwiseXOR(x[i - 1]))
        return F.array(*x)

    def index(at: Column) -> Column:
        last = at[n - 1]
        turn = F.aggregate(
            steps, F.lit(0).cast("bigint"),
            lambda t, q: F.when(last.bitwiseAND(q) != 0, t.bitwiseXOR(q - 1)).otherwise(t),
        )
        x = [at[i].bitwiseXOR(turn) for i in range(n)]
        out = F.lit(0).cast("bigint")
        for b in range(bits):
            for i in range(n):
                bit = F.shiftright(x[i], b).bitwiseAND(F.lit(1).cast("bigint"))
                out = out.bitwiseOR(F.shiftleft(bit, b * n + n - 1 - i))
        return out

    # transform binds each step's array once, where a plain reuse would repeat the whole tree
    return F.transform(F.transform(F.array(flat), gray), index)[0]


def hilbert_order(df: DataFrame, dims: Sequence[str], bits: int = BITS, name: str = "hilbert") -> DataFrame:
    """Add the Hilbert place of each row over the given columns: numbers by magnitude, others by value."""
    cells = []
    for i, dim in enumerate(dims):
        cell = f"_cell_{i}"
        if isinstance(df.schema[dim].dataType, NumericType):
            df = df.withColumn(cell, magnitude_cell(F.col(dim), bits))
        else:
            df = value_cells(df, dim, cell, bits)
        cells.append(cell)
    return df.withColumn(name, hilbert_index([F.col(c) for c in cells], bits)).drop(*cells)


def cut_runs(df: DataFrame, order: Sequence[str], shards: int) -> DataFrame:
    """Add ``shard`` and ``slot``: consecutive runs of the order whose row counts are at most one apart."""
    placed = assign_ids(df, order, "_place")
    n = df.count()
    at = F.col("_place") - 1
    shard = F.expr(f"((_place - 1) * {shards}L) div {max(n, 1)}L")
    first = F.expr(f"((((_place - 1) * {shards}L) div {max(n, 1)}L) * {max(n, 1)}L + {shards - 1}L) div {shards}L")
    return placed.withColumns({"shard": shard.cast("int"), "slot": (at - first).cast("bigint")}).drop("_place")


def shard_documents(
    docs: DataFrame, dims: Sequence[str] = ("lang", "source", "n_chars"), shards: int = 40, *,
    id_col: str = "doc_id", text_col: str = "text", bits: int = BITS,
) -> DataFrame:
    """Each row's shard and slot under the law ``rows``: shard sizes in rows are at most one apart.

    Rows are ordered by Hilbert place, then text checksum, so that equal texts with equal metadata
    are neighbours, then id. A null text has size 16 and checksum 0; null metadata falls into
    cell 0; rows without an id or with repeated ids each get a slot of their own. An empty table
    gives no rows. Only the id, the dimensions and the text are read; the text is not moved.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    narrow = stored(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + ROW_BYTES).cast("bigint").alias("size"),
            F.crc32(text).cast("bigint").alias("text_crc32"),
            *[F.col(d).alias(f"_dim_{i}") for i, d in enumerate(dims)],
        ),
        "shards",
    )
    placed = hilbert_order(narrow, [f"_dim_{i}" for i in range(len(dims))], bits)
    return cut_runs(placed, ["hilbert", "text_crc32", "doc_id"], shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "hilbert",
        *[F.col(f"_dim_{i}").alias(f"dim_{d}") for i, d in enumerate(dims)],
    )


def shard_ranges(placed: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Rows, smallest and largest value of each dimension per shard, by which a filter skips shards."""
    return placed.groupBy("shard").agg(
        F.count(F.lit(1)).alias("rows"),
        *[f(d).alias(f"{k}_{d}") for d in dims for k, f in (("min", F.min), ("max", F.max))],
    )


def write_shards(placed: DataFrame, rows: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write the whole rows by shard, sorted along the curve; ids must be unique here.

    Every task writes the part of the shards it holds, so no shard has to fit one task.
    """
    keyed = rows.join(placed.select(F.col("doc_id").alias(id_col), "shard", "slot"), id_col)
    keyed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
