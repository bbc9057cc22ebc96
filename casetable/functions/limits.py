"""Time and memory limits written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults, and floors at or below which a limit counts as a typing error.
DEFAULT_MS, FLOOR_MS = 3000.0, 0.1
DEFAULT_S, FLOOR_S = 3.0, 0.0001
DEFAULT_MB, FLOOR_MB = 256.0, 0.0001


def _has(text: Column, *parts: str) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(text, F.lit(part))
    return hit


def _first_number(text: Column) -> Column:
    return F.regexp_extract(text, r"(\d+(?:\.\d+)?)", 1).try_cast("double")


def _or_default(value: Column, floor: float, default: float) -> Column:
    return F.when(value > floor, value).otherwise(F.lit(default))


def parse_time_limit(col: Column, unit: str = "ms", strict_units: bool = False) -> Column:
    """The limit in ``ms`` or ``s``.

    Only ``mili`` and ``ms`` mark milliseconds, so the word ``milliseconds`` is read as
    seconds; ``strict_units`` reads it as milliseconds.
    """
    text = F.lower(col)
    marks = ("mili", "ms", "milli") if strict_units else ("mili", "ms")
    number, in_ms = _first_number(text), _has(text, *marks)
    if unit == "ms":
        return _or_default(F.when(in_ms, number).otherwise(number * 1000.0), FLOOR_MS, DEFAULT_MS)
    if unit == "s":
        return _or_default(F.when(in_ms, number / 1000.0).otherwise(number), FLOOR_S, DEFAULT_S)
    raise ValueError(f"unit must be 'ms' or 's', not {unit!r}")


def parse_memory_limit(col: Column) -> Column:
    """The limit in MB; a number without a unit is bytes."""
    text = F.lower(col)
    number = _first_number(text)
    value = (
        F.when(_has(text, "giga", "gb"), number * 1024.0)
        .when(_has(text, "kilo", "kb"), number / 1024.0)
        .when(_has(text, "mega", "mb"), number)
        .otherwise(number / (1024.0 * 1024.0))
    )
    return _or_default(value, FLOOR_MB, DEFAULT_MB)
