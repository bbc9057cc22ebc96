"""A documents table with every odd case, and helpers."""

from __future__ import annotations

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977} Über{i % 13}" for i in range(30_000))


def odd_rows(n: int = 60) -> list[tuple]:
    rows = [
        (i, f"The {['red', 'green', 'blue'][i % 3]} fox number{i % 7} jumps over doc{i} again and Again {'lazy ' * (i % 5)}dogs.", ["en", "fr"][i % 2], f"s{i % 4}", i)
        for i in range(n)
    ]
    return rows + [
        (1000, None, "en", "s1", None), (1001, "", "en", None, 0), (1002, LONG, "en", "s2", 1), (1003, " \t\n .,", None, "s9", 3),
        (1004, "one", "xx", "only", 3), (None, "a row without an id", "en", "s1", 1), (None, None, None, None, None),
        (5, rows[5][1], "fr", "s1", 5), (5, "another text of the same id", "fr", "s1", 5), (1005, "naïve Ünïcode ÀÉ 日本語 text", "fr", "s3", 9),
        (1006, "x" * 100_000, "en", "s3", 9),
    ]


def odd_table(spark, rows=None, clash: tuple[str, ...] = ()):
    """The rows as a table, with further columns of the given names."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(odd_rows() if rows is None else rows, SCHEMA)
    return df.withColumns({c: F.lit("clash") for c in clash}).repartition(3) if clash else df.repartition(3)


def plain(rows, *cols):
    return sorted((tuple(r[c] for c in cols) for r in rows), key=repr)
