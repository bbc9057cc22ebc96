"""Nested cells to tables: parse, explode, unpivot, one-hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable.functions.json_cells import (
    FLAGS_SCHEMA, parse_io, parse_list, size_or_zero, strip_fence, truthy, whole_json,
)
from casetable.functions.score_sets import score_map, score_vector
from casetable.functions.text import loose_int, strip_text
from casetable.operators.columns import front_columns, insert_after
from casetable.vocab import PROBLEM_FRONT_COLUMNS


def count_io(df: DataFrame, col: str = "input_output") -> DataFrame:
    """``count_input``, ``count_output`` and ``count_same``, placed right of the cell."""
    parsed = df.withColumn("_io", parse_io(F.col(col)))
    n_in, n_out = size_or_zero(F.col("_io.inputs")), size_or_zero(F.col("_io.outputs"))
    counted = insert_after(
        parsed, col, {"count_input": n_in, "count_output": n_out, "count_same": n_in == n_out}
    )
    return counted.drop("_io")


def explode_cases(df: DataFrame, key: str = "id", io: str = "_io") -> DataFrame:
    """One row per test case, numbered from 1; the longer of the two lists is cut."""
    n = F.least(size_or_zero(F.col(f"{io}.inputs")), size_or_zero(F.col(f"{io}.outputs"))).cast("int")
    pairs = F.arrays_zip(
        F.slice(F.col(f"{io}.inputs"), 1, n).alias("input"),
        F.slice(F.col(f"{io}.outputs"), 1, n).alias("output"),
    )
    return df.select(F.col(key).alias("problem_id"), F.posexplode(pairs).alias("_at", "_case")).select(
        "problem_id",
        (F.col("_at") + 1).cast("bigint").alias("testcase_order"),
        F.col("_case.input").alias("input"),
        F.col("_case.output").alias("output"),
        F.lit(None).cast("boolean").alias("validation"),
    )


def explode_solutions(df: DataFrame, key: str = "id", col: str = "_solutions") -> DataFrame:
    # the outer form: for the plain one Spark adds a filter that parses the cell again
    rows = df.select(F.col(key).alias("problem_id"), F.posexplode_outer(col).alias("_at", "solution"))
    return rows.where(F.col("_at").isNotNull()).select(
        "problem_id",
        (F.col("_at") + 1).cast("bigint").alias("solution_order"),
        "solution",
        F.lit(None).cast("boolean").alias("validation"),
    )


def count_solutions(df: DataFrame, col: str = "solutions") -> DataFrame:
    """``count_solutions``; 0 when the table has no such column."""
    n = size_or_zero(parse_list(F.col(col))) if col in df.columns else F.lit(0).cast("bigint")
    return df.withColumn("count_solutions", n)


def split_corpus(
    df: DataFrame, key: str = "id", io: str = "input_output", solutions: str = "solutions"
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A nested corpus as problems, cases and solutions.

    Three plans over one scan definition: each reads and parses only the cell it needs, which
    costs less than keeping the parsed corpus, larger than its source, in memory or on disk.
    """
    problems = df.withColumn("count_cases", size_or_zero(parse_io(F.col(io))["inputs"]))
    problems = count_solutions(problems, solutions).drop(io, solutions)
    cases = explode_cases(df.select(key, parse_io(F.col(io)).alias("_io")), key)
    if solutions in df.columns:
        sols = explode_solutions(df.select(key, parse_list(F.col(solutions)).alias("_solutions")), key)
    else:
        none = F.lit(None).cast("array<string>")
        sols = explode_solutions(df.select(key, none.alias("_solutions")), key)
    return front_columns(problems, PROBLEM_FRONT_COLUMNS), cases, sols


def solution_columns(columns: Sequence[str], prefix: str = "solution_") -> dict[int, str]:
    """The columns named by the prefix and a number, by that number."""
    found = {c: c.removeprefix(prefix) for c in columns if c.startswith(prefix)}
    return dict(sorted((int(n), c) for c, n in found.items() if n.isascii() and n.isdigit()))


def unpivot_solutions(df: DataFrame, keys: Sequence[str], prefix: str = "solution_") -> DataFrame:
    """All numbered solution columns as rows, trimmed, blank ones left out."""
    cells = [
        F.struct(F.lit(i).cast("bigint").alias("solution_index"), strip_text(F.col(c)).alias("code"))
        for i, c in solution_columns(df.columns, prefix).items()
    ]
    return df.select(*keys, F.inline(F.array(*cells))).where(F.col("code") != "")


def flag_vector(
    df: DataFrame, key: str, reply: str, vocab: Sequence[str], order: str = "position",
    order_name: str = "algorithm_order", order_field: str = "solution_order",
) -> DataFrame:
    """Reply objects as rows of flags over a fixed vocabulary, with their count.

    Numbered by ``position`` in the reply from 1, or by the object's own ``field``; objects
    without a usable number are then left out.
    """
    flags = whole_json(strip_fence(F.col(reply)), FLAGS_SCHEMA, {})
    items = df.select(key, F.posexplode(flags).alias("_at", "_flags")).where(F.col("_flags").isNotNull())
    if order == "position":
        number = (F.col("_at") + 1).cast("bigint")
    elif order == "field":
        number = F.nullif(loose_int(F.try_element_at("_flags", F.lit(order_field))), F.lit(0).cast("bigint"))
    else:
        raise ValueError(f"order must be 'position' or 'field', not {order!r}")
    held = {tag: truthy(F.try_element_at("_flags", F.lit(tag))) for tag in vocab}
    total = sum((F.when(flag, 1).otherwise(0) for flag in held.values()), F.lit(0))
    return items.select(
        key, number.alias(order_name), total.cast("bigint").alias("count"),
        *[flag.alias(tag) for tag, flag in held.items()],
    ).where(F.col(order_name).isNotNull())


def with_scores(df: DataFrame, raw: str, tags: Sequence[str], name: str = "scores") -> DataFrame:
    """The score of every tag, in tag order, from a text map."""
    return df.withColumn(name, score_vector(F.col(raw), tags))


def with_score_map(df: DataFrame, scores: str, tags: Sequence[str], name: str = "score_map") -> DataFrame:
    return df.withColumn(name, score_map(F.col(scores), tags))


def score_pivot(df: DataFrame, tags: Sequence[str], scores: str = "scores") -> DataFrame:
    """One column per tag, in tag order, in place of the score array."""
    kept = [c for c in df.columns if c != scores]
    return df.select(*kept, *[F.get(F.col(scores), i).alias(t) for i, t in enumerate(tags)])


def parse_reply(
    df: DataFrame, reply: str, schema: str, expect: str | None = None, name: str = "parsed"
) -> DataFrame:
    """Parse a reply that should be a JSON list; ``reason`` tells why there is no value.

    UNREADABLE, EMPTY, or LENGTH when the list is not as long as the ``expect`` column says.
    """
    parsed = df.withColumn(name, whole_json(strip_fence(F.col(reply)), schema, {}))
    n = F.size(name)
    reason = F.when(F.col(name).isNull(), "UNREADABLE").when(n == 0, "EMPTY")
    if expect is not None:
        reason = reason.when(n != F.col(expect), "LENGTH")
    return parsed.withColumn("reason", reason).withColumn(
        name, F.when(F.col("reason").isNull(), F.col(name))
    )
