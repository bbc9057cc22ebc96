"""Exact top-k by inner product without random access (NRA).

Every dimension is a list of the candidates sorted by what they add to the score: for a query,
from the largest component down where its own component is positive, from the smallest up where
it is negative. The lists are read in step, all entries of one height together. At any depth a
candidate's score lies between two bounds: what was read plus the least, or plus the most, that
the unread rest of its lists can add. Reading stops once so few candidates can still reach the
k-th best lower bound that their remaining entries are cheaper to read than the lists; then
their scores are resolved and ranked.

Candidates are dealt into blocks and queries into chunks of bounded size; each pair is one task's
work, with the bounds of all its queries as matrices, and only k rows per query leave it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

K = 20
BLOCK = 8192
CHUNK = 2048
#: Reading stops when so many times k candidates are left for a query on average.
FEW = 4
#: Parts of the lists that are read before the bounds are looked at again.
DEPTHS = (0.35, 0.55, 0.75, 1.0)
_ROWS = 256  # queries whose bounds are held at once


def whole_numbers(vector: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component as double; null if the vector, or a component, is no finite number."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("bigint")))


def _heights(lists: np.ndarray) -> list[int]:
    """Down to which component the lists are read at each depth."""
    if not lists.size:
        return [0]
    return sorted({int(np.quantile(lists, 1 - d)) for d in DEPTHS[:-1]} | {int(lists.min())}, reverse=True)


def search(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int):
    """(query place, row place, score) of each query's k best rows other than its own id, ties to smaller ids."""
    dim = queries.shape[1]
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * max(dim, 1)
    kind = np.float32 if most < 2**24 else np.float64 if most < 2**53 else np.int64
    order = np.argsort(row_ids, kind="stable")
    rows, row_ids = rows[order].astype(kind), row_ids[order]
    up = np.concatenate([rows, -rows], axis=1)  # each dimension read from either end
    ends = up.min(axis=0, initial=0) if dim else up.sum(axis=0)
    weights = np.concatenate([np.maximum(queries, 0), np.maximum(-queries, 0)], axis=1).astype(kind)
    heights = _heights(up)
    seen_low = [np.where(up >= h, up, ends[None, :]).T.copy() for h in heights]
    seen_high = [np.maximum(up, h - 1).T.copy() for h in heights]  # unread entries lie below the height
    lowest = np.iinfo(np.int64).min / 4 if kind is np.int64 else -np.inf
    out_q, out_r, out_s = [], [], []
    for at in range(0, len(queries), _ROWS):
        part, own_ids = weights[at:at + _ROWS], query_ids[at:at + _ROWS]
        own = np.searchsorted(row_ids, own_ids), np.searchsorted(row_ids, own_ids, "right")
        ready = min(k, len(rows))
        for depth in range(len(heights)):
            low, high = part @ seen_low[depth], part @ seen_high[depth]
            if heights[depth] <= int(up.min(initial=0)):
                low = high  # all is read
            for i, (a, b) in enumerate(zip(*own)):
                low[i, a:b] = high[i, a:b] = lowest
            bar = np.partition(low, len(rows) - ready, axis=1)[:, len(rows) - ready]
            # the leaders by their upper bound are resolved at once; they raise the bar
            lead = np.argpartition(high, len(rows) - ready, axis=1)[:, len(rows) - ready:]
            sure = np.einsum("qd,qkd->qk", queries[at:at + _ROWS].astype(kind), rows[lead])
            hidden = (lead >= own[0][:, None]) & (lead < own[1][:, None])
            sure[hidden] = lowest
            bar = np.maximum(bar, sure.min(axis=1))
            open_ = (high >= bar[:, None]) & (high > lowest)
            if open_.sum() <= FEW * k * len(part) or depth == len(heights) - 1:
                break
        q, r = np.nonzero(open_)
        score = np.einsum("nd,nd->n", queries[at:at + _ROWS][q].astype(kind), rows[r])
        place = np.lexsort((row_ids[r], -score, q))
        q, r, score = q[place], r[place], score[place]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        keep = rank < k
        out_q.append(q[keep] + at)
        out_r.append(order[r[keep]])
        out_s.append(score[keep].astype(np.int64))
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) if x else empty for x in (out_q, out_r, out_s))


def _matrix(table: pa.Table) -> np.ndarray:
    cells = table["cells"].combine_chunks()
    flat = cells.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(table), -1) if len(table) else flat.reshape(0, 0)


def top_k(
    vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 20, k: int = K,
    scale: int = 64, block: int = BLOCK, chunk: int = CHUNK,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best rows for each row whose id is divisible by ``every``.

    The score is the inner product of the components scaled and floored to whole numbers. Vectors
    that are null or hold nulls or numbers that are not finite take no part, nor do rows without an
    id; vectors are compared with those of equal length. Rows with the query's id are its own; other
    repeated ids are rows of their own. Fewer rows than k give them all; an empty table gives none.
    """
    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), whole_numbers(F.col(vector_col), scale).alias("cells"))
    rows = rows.where("id is not null and cells is not null").withColumn("dim", F.size("cells"))
    wanted = rows.where(F.col("id") % every == 0)
    n, n_wanted = rows.count(), wanted.count()
    blocks, chunks = max(1, -(-n // block)), max(1, -(-n_wanted // chunk))

    def dealt(df: DataFrame, own: str, parts: int, other: str, copies: int) -> DataFrame:
        spread = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
        return df.withColumn(own, F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")).withColumn(other, spread)

    left = dealt(wanted, "chunk", chunks, "block", blocks).groupBy("dim", "block", "chunk")
    right = dealt(rows, "block", blocks, "chunk", chunks).groupBy("dim", "block", "chunk")

    def best(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        ids = [t["id"].to_numpy() for t in (queries, candidates)]
        if not len(ids[0]) or not len(ids[1]):
            q = r = s = np.zeros(0, np.int64)
        else:
            q, r, s = search(_matrix(queries), ids[0], _matrix(candidates), ids[1], k)
        return pa.table({"query_id": ids[0][q], "vec_id": ids[1][r], "score": s})

    found = left.cogroup(right).applyInArrow(best, "query_id long, vec_id long, score long")
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )
