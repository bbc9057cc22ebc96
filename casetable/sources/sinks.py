"""Writing tables, report sets and versioned snapshots."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casetable.session import create_note, files, read_note, remove

ROWS_PER_FILE = 2_000_000


def write_table(df: DataFrame, path: str, mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Overwrite or append, as Parquet or CSV with a header in every file."""
    writer = df.write.mode(mode).option("maxRecordsPerFile", ROWS_PER_FILE)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"fmt must be 'parquet' or 'csv', not {fmt!r}")


def _fixed(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit("").alias(c) for c in columns])


def write_report(
    scores: DataFrame, recheck: DataFrame, path: str, score_columns: Sequence[str],
    recheck_columns: Sequence[str],
) -> None:
    """The two report tables with their fixed columns; columns that are absent are empty."""
    write_table(_fixed(scores, score_columns), f"{path}/scores")
    write_table(_fixed(recheck, recheck_columns), f"{path}/recheck")


class SnapshotConflict(Exception):
    """Another writer published first."""


def _versions(spark: SparkSession, path: str) -> dict[int, str]:
    """The published versions and the folders of their rows."""
    listed = {int(p.rsplit("/", 1)[1]): p for p in files(spark, f"{path}/versions") if p.rsplit("/", 1)[1].isdigit()}
    return {n: read_note(spark, p) for n, p in listed.items()}


def publish(df: DataFrame, path: str, keep: int = 2, based_on: int | None = None) -> int:
    """Replace what readers see as a whole; returns the number of the new version.

    The rows go to a folder of their own. A small file named after the version then makes them seen; it is
    only created if there is none, so of two writers that start from one version the second gets a
    ``SnapshotConflict`` and its rows are removed. ``based_on`` is the version the rows were made from, the
    newest at the start by default. A failed write is never seen. The last ``keep`` versions stay.
    """
    spark = df.sparkSession
    before = max(_versions(spark, path), default=0) if based_on is None else based_on
    folder = f"data-{uuid.uuid4().hex}"
    write_table(df, f"{path}/{folder}")
    if not create_note(spark, f"{path}/versions/{before + 1}", folder):
        remove(spark, f"{path}/{folder}")
        raise SnapshotConflict(f"version {before + 1} of {path} is there already")
    for number, old in _versions(spark, path).items():
        if number <= before + 1 - keep:
            remove(spark, f"{path}/versions/{number}")
            remove(spark, f"{path}/{old}")
    return before + 1


def read_snapshot(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The newest version, or one that is still kept."""
    known = _versions(spark, path)
    return spark.read.parquet(f"{path}/{known[max(known) if version is None else version]}")
