"""Looking at one problem by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from casetable.functions.text import canonical_id, tri_state


def review_split(
    problems: DataFrame, cases: DataFrame, problem: int | str, status: str = "range_validation",
    k: int = 15,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One problem's text, its case counts by TRUE, FALSE and ERROR, and the first ``k`` of each."""
    wanted = canonical_id(F.lit(str(problem)))
    text = problems.where(F.col("id") == wanted)
    own = cases.where(F.col("problem_id") == wanted).withColumn("state", tri_state(F.col(status)))
    counts = own.groupBy("state").agg(F.count(F.lit(1)).alias("n"))
    place = F.row_number().over(W.partitionBy("state").orderBy("testcase_order"))
    shown = own.withColumn("_at", place).where(F.col("_at") <= k).drop("_at", "problem_id")
    return text, counts, shown
