"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable.operators.joins import join_spread
from casetable.session import settle


def _follow(rows: DataFrame, col: str, parents: DataFrame) -> DataFrame:
    """Replace a node by its parent where it has one."""
    to = parents.select(F.col("node").alias(col), "parent")
    return join_spread(rows, to, [col], "left").withColumn(col, F.coalesce("parent", col)).drop("parent")


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component``: the smallest node that links reach, for every node in a link.

    Each round every node but the locally smallest takes its smallest neighbour as parent; parents
    are followed in doubling steps up to a root, and the links between roots are what the next
    round works on, at most half as many nodes each time. Everything stays in tables; the driver
    only learns whether one is empty. Nulls and links of a node with itself are left out.
    """
    ends = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    left = settle(ends.select(F.greatest("x", "y").alias("high"), F.least("x", "y").alias("low")).distinct())
    nodes = left.select(F.col("high").alias("node")).union(left.select("low")).distinct()
    labels = nodes.select("node", F.col("node").alias("component"))
    while not left.isEmpty():
        parents = settle(left.groupBy(F.col("high").alias("node")).agg(F.min("low").alias("parent")))
        while True:
            onward = parents.select(F.col("node").alias("parent"), F.col("parent").alias("next"))
            stepped = join_spread(parents, onward, ["parent"], "left")
            stepped = settle(stepped.select("node", F.coalesce("next", "parent").alias("parent"), "next"))
            parents = stepped.select("node", "parent")
            if stepped.where(F.col("next").isNotNull()).isEmpty():
                break
        labels = settle(_follow(labels, "component", parents))
        ends = _follow(_follow(left, "high", parents), "low", parents)
        left = settle(
            ends.where("high <> low").select(F.greatest("high", "low").alias("high"), F.least("high", "low").alias("low"))
            .distinct()
        )
    return labels.select("node", "component")
