from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from casetable.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("casetable-tests", 8, 4)


@pytest.fixture
def one(spark):
    """Evaluate a column expression over a list of cells: ``one(cells, type, build)``."""

    def run(cells, kind, build):
        df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], f"i int, c {kind}")
        from pyspark.sql import functions as F

        return [r[0] for r in df.select(build(F.col("c")).alias("out"), "i").orderBy("i").collect()]

    return run
