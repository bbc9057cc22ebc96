"""Helpers that several operators of this part share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from casetable.session import scratch


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write the rows to a new table in the shared folder and go on from there.

    One pass over the input, unlike a checkpoint, and the rows stay the same when executors
    are lost. Used where several later steps read the same costly rows.
    """
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def rows_at_once(spark: SparkSession, n: int) -> Iterator[None]:
    """What runs meanwhile hands over n rows at once to Python, for rows of megabytes each."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(key, None)
    spark.conf.set(key, n)
    try:
        yield
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
