"""From problems to request texts, and from reply texts to score and recheck tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetable import vocab as V
from casetable.functions.text import solution_key
from casetable.operators import joins as J, nested as N, order as O, requests as Q, scoring as S


def plan_requests(
    problems: DataFrame, done: DataFrame, per_request: int, header: Column, item: Column,
    footer: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Solutions that have no score row yet, in chunks of one problem: rows asked for, and texts.

    ``header`` and ``item`` are built from problem columns, ``solution_index`` and ``code``.
    """
    numbered = N.solution_columns(problems.columns)
    keep = [c for c in problems.columns if c not in numbered.values()]
    sols = N.unpivot_solutions(problems, keep).withColumn(
        "problem_solution_key", solution_key(F.col("id"), F.col("solution_index"))
    )
    todo = J.pending(sols, done, ["problem_solution_key"])
    # one block holds all solutions of a problem
    chunks = O.chunk_rows(todo, ["id"], ["solution_index"], per_request, width=max(numbered, default=0) + 1)
    chunks = chunks.withColumn("chunk_id", F.concat_ws(":", F.col("id").cast("string"), F.col("chunk_no").cast("string")))
    return chunks, Q.render_requests(chunks, ["chunk_id"], "item_no", header, item, footer)


def read_replies(
    requests: DataFrame, replies: DataFrame, tags: Sequence[str] = V.SCORE_TAGS,
    broad: Mapping[str, Sequence[str]] = V.BROAD_CANDIDATES,
) -> dict[str, DataFrame]:
    """Score rows, recheck rows and chunk status from ``requests`` and one reply text per chunk.

    ``rows``, the matched items, is marked for caching so that replies are parsed once for
    both tables; unpersist it when they have been written.
    """
    sizes = requests.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("asked"))
    told = replies.join(sizes, "chunk_id")
    rows, status = J.align_reply(requests, S.parse_items(told, broad, asked="asked"))
    rows = rows.persist()
    return {
        "rows": rows,
        "scores": S.score_rows(rows, tags),
        "recheck": S.recheck_rows(rows, tags, broad),
        "status": status,
    }
