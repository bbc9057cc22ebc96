"""Column layout: order, names, presence. No step here moves a row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetable.functions.json_cells import truthy
from casetable.functions.text import is_hidden


def front_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """The named columns that exist first, all others after them."""
    front = [n for n in names if n in df.columns]
    return df.select(*[df[f"`{c}`"] for c in front + [c for c in df.columns if c not in front]])


def insert_after(
    df: DataFrame, anchor: str, cols: Mapping[str, Column], replaces: Sequence[str] = ()
) -> DataFrame:
    """New columns right of the anchor; columns they replace, and older ones of the same name, go."""
    gone = {*cols, *replaces}
    layout = []
    for name in df.columns:
        if name not in gone:
            layout.append(F.col(f"`{name}`"))
        if name == anchor:
            layout += [expr.alias(new) for new, expr in cols.items()]
    return df.select(*layout)


def drop_prefix(df: DataFrame, prefix: str) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(prefix)])


def to_public_cases(df: DataFrame) -> DataFrame:
    """Case table for readers: new names, no validation, and the two marks is_hidden, is_deleted."""
    return (
        df.withColumnsRenamed({"input": "input_text", "output": "expected_output"})
        .drop("validation")
        .withColumns(
            {"is_hidden": is_hidden(F.col("testcase_order")), "is_deleted": F.lit(None).cast("boolean")}
        )
    )


def ensure_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    missing = {n: F.lit(None).cast(t) for n, t in types.items() if n not in df.columns}
    return df.withColumns(missing) if missing else df


def blank_false(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Flags as text for a sheet: True, or an empty cell."""
    return df.withColumns(
        {c: F.when(truthy(F.col(c).cast("string")), "True").otherwise("") for c in cols}
    )
