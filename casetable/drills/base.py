"""Drills: one query per operator output on the test tables, each with its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from casetable import session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


class Tables:
    """The test tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in TABLES:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def view(self, text: str) -> DataFrame:
        """A view text, its ``{table}`` names filled with the test tables."""
        used = {t: getattr(self, t) for t in TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)

    def scratch(self, label: str) -> str:
        return session.scratch(self.spark, label)


def check(text: str) -> str:
    """The same view text for the checking engine."""
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text


def drill(name: str, sql: str | None = None):
    """Register a query over the test tables, and the SQL that must return the same rows."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: build(Tables(spark, folder))
        if sql is not None:
            CHECKS[name] = check(sql)
        return build

    return register
