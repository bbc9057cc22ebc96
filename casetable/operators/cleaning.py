"""Table steps made of column expressions: one projection each, nothing in Python per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetable import vocab as V
from casetable.functions import limits as L
from casetable.functions import text as T


def with_language(df: DataFrame, col: str, rules=tuple(V.LANGUAGE_RULES), name: str = "language") -> DataFrame:
    return df.withColumn(name, T.first_match_label(F.col(col), rules))


def with_line_count(df: DataFrame, col: str, name: str = "lines") -> DataFrame:
    return df.withColumn(name, T.line_count(F.col(col)))


def with_selected(df: DataFrame, index: str, text: str, name: str = "is_selected") -> DataFrame:
    return df.withColumn(name, T.equals_number(F.col(index), F.col(text)))


def with_solution_key(df: DataFrame, problem: str, solution: str, name: str = "problem_solution_key") -> DataFrame:
    return df.withColumn(name, T.solution_key(F.col(problem), F.col(solution)))


def with_joined(df: DataFrame, col: str, name: str, sep: str = " | ", empty: str = "NONE") -> DataFrame:
    return df.withColumn(name, T.join_list(F.col(col), sep, empty))


def with_limits(df: DataFrame, time: str = "time_limit", memory: str = "memory_limit", strict_units: bool = False) -> DataFrame:
    """Parsed limits right of their text columns, in place of older parsed ones."""
    from casetable.operators.columns import insert_after

    timed = insert_after(
        df, time, {"time_limit_parsed(ms)": L.parse_time_limit(F.col(time), "ms", strict_units)},
        replaces=["time_limit_parsed(s)"],
    )
    return insert_after(timed, memory, {"memory_limit_parsed(mb)": L.parse_memory_limit(F.col(memory))})


def with_hidden(df: DataFrame, order: str, name: str = "is_hidden") -> DataFrame:
    return df.withColumn(name, T.is_hidden(F.col(order)))


def with_fill_status(df: DataFrame, cols: Sequence[str], name: str = "fill") -> DataFrame:
    return df.withColumn(name, T.fill_status([F.col(c) for c in cols]))


def with_tri_state(df: DataFrame, col: str, name: str = "state") -> DataFrame:
    return df.withColumn(name, T.tri_state(F.col(col)))


def keyword_filter(df: DataFrame, col: str, word: str) -> DataFrame:
    return df.where(T.contains_word(F.col(col), word))


def replace_literals(
    df: DataFrame, cols: Sequence[str], pairs: Sequence[tuple[str, str]],
    overrides: Mapping[int, Sequence[tuple[str, str]]] | None = None, key: str = "id",
) -> DataFrame:
    """Ordered literal replacements in several columns, then further ones for single ids."""

    def cell(name: str) -> Column:
        base = T.fold_literals(F.col(name), pairs)
        picked = F
        for who, more in (overrides or {}).items():
            picked = picked.when(F.col(key) == who, T.fold_literals(base, more))
        return picked.otherwise(base) if overrides else base

    return df.withColumns({c: cell(c) for c in cols if c in df.columns})


def replace_words(df: DataFrame, cols: Sequence[str], words: Mapping[str, str]) -> DataFrame:
    return df.withColumns({c: T.replace_words(F.col(c), words) for c in cols})


def with_preview(df: DataFrame, col: str, n: int = 50, name: str = "preview") -> DataFrame:
    return df.withColumn(name, T.preview_text(F.col(col), n))


def with_error_class(df: DataFrame, col: str = "error", name: str = "error_class") -> DataFrame:
    return df.withColumn(name, T.error_class(F.col(col)))


def blank_nulls(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.withColumns({c: T.blank_if_null(F.col(c)) for c in cols})
