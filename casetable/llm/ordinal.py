"""Quality grades by ordinal cumulative-link regression on hashed text.

Ratings are grades 0 < 1 < .. < K-1. One weight vector over hashed text features gives a text
its score s; ordered thresholds t_0 < t_1 < .. turn it into P(grade <= k) = 1 / (1 + exp(s - t_k)).
From these follow the expected grade and the tail probability P(grade >= k) by which texts are
selected.

The model is fitted on a bounded sample of rated texts (``SAMPLE``, those with the smallest
hashed ids); every text is scored whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence
from itertools import groupby
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rated texts the model is fitted on, at most.
SAMPLE = 16_000
BITS = 20
GRADES = 3
ROUNDS = 120
#: Features in fewer texts of the sample get no weight: a rare word marks one text and teaches nothing.
LEAST_TEXTS = 8
#: Weight of the squared weights in the loss.
DECAY = 2e-5

_UPPER, _LOWER_CASE = bytes(range(65, 91)), bytes(range(97, 123))
_MARKS = bytes(set(range(33, 127)) - set(range(48, 58)) - set(_UPPER) - set(_LOWER_CASE))
_DIGITS = bytes(range(48, 58))
_WORDS = bytes.maketrans(_UPPER + _MARKS, _LOWER_CASE + b" " * len(_MARKS))


def _share(part: int, whole: int) -> int:
    """A share in rough steps that are finer near 0."""
    return 0 if not part or not whole else 1 + int(10 * (part / whole) ** 0.5)


def features(text: str | None, bits: int = BITS) -> np.ndarray:
    """Hashed features: the distinct words, and rough shares of capitals, each mark, digits and repeats."""
    raw = (text or "").encode()
    plain = raw.translate(_WORDS).split()
    tokens = raw.split()
    distinct = set(plain)
    lines = raw.split(b"\n")
    twins = sum(map(eq, plain, plain[1:]))
    marks = len(raw) - len(raw.translate(None, _MARKS))
    kinds = [
        b"capitals %d" % _share(len(raw) - len(raw.translate(None, _UPPER)), len(raw)),
        b"marks %d" % _share(marks, len(raw)),
        b"digits %d" % _share(len(raw) - len(raw.translate(None, _DIGITS)), len(raw)),
        b"twins %d" % _share(twins, len(plain)),
        b"run %d" % (max(sum(1 for _ in same) for _, same in groupby(plain)) if twins else 0).bit_length(),
        b"distinct %d %d" % (len(plain).bit_length(), _share(len(distinct), len(plain))),
        b"lines %d" % _share(len(lines) - len(set(lines)), len(lines)),
        b"bare %d" % _share(len(tokens) - min(len(tokens), len(plain)), len(tokens)),
        b"length %d" % len(plain).bit_length(),
    ]
    kinds += [b"mark %d %d" % (m, _share(n, len(raw))) for m in _MARKS if marks and (n := raw.count(m))]
    names = [b"w " + w for w in distinct] + [b"k " + k for k in kinds]
    return np.unique(np.fromiter(map(zlib.crc32, names), np.uint32, len(names)) & np.uint32((1 << bits) - 1))


def link(score: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade >= k) for k = 1 .. K-1, a column each."""
    return 1 / (1 + np.exp(np.clip(thresholds[None, :] - score[:, None], -40, 40)))


def fit(rows: Sequence[np.ndarray], grades: np.ndarray, n_grades: int, bits: int, rounds: int = ROUNDS, decay: float = DECAY):
    """Weights and thresholds by full-batch gradient steps with per-weight rates; no randomness."""
    weights = np.zeros(1 << bits)
    counts = np.bincount(grades, minlength=n_grades) + 1.0
    above = np.cumsum(counts[::-1])[::-1][1:] / counts.sum()
    thresholds = -np.log(above / (1 - above))
    if not len(rows):
        return weights, thresholds
    texts_of = np.bincount(np.concatenate(rows), minlength=1 << bits)
    rows = [r[texts_of[r] >= LEAST_TEXTS] for r in rows]
    rows = [np.append(r, 1 << bits) for r in rows]  # a place of no weight, so that no row is empty
    flat = np.concatenate(rows).astype(np.int64)
    sizes = np.array([len(r) for r in rows])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    gaps = np.log(np.maximum(np.diff(thresholds), 1e-3))
    moment, square = np.zeros(1 << bits), np.zeros(1 << bits)
    base_square = 0.0
    low_square = np.zeros(n_grades - 2)
    at = np.arange(len(grades))
    for step in range(1, rounds + 1):
        thresholds = thresholds[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])
        score = np.add.reduceat(np.append(weights, 0)[flat], starts)
        tail = np.pad(link(score, thresholds), ((0, 0), (1, 1)), constant_values=((0, 0), (1, 0)))
        p = np.maximum(tail[at, grades] - tail[at, grades + 1], 1e-9)
        slope = tail * (1 - tail)
        d_score = -(slope[at, grades] - slope[at, grades + 1]) / p / len(grades)
        d_tail = np.zeros_like(tail)
        d_tail[at, grades] += slope[at, grades] / p
        d_tail[at, grades + 1] -= slope[at, grades + 1] / p
        d_threshold = d_tail[:, 1:-1].sum(0) / len(grades)  # tail falls as its threshold rises
        grad = np.bincount(flat, np.repeat(d_score, sizes), (1 << bits) + 1)[:-1] + decay * weights
        moment = 0.9 * moment + 0.1 * grad
        square = 0.99 * square + 0.01 * grad * grad
        weights -= 0.05 * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        base = d_threshold.sum()
        base_square += base * base
        gap_grad = np.array([d_threshold[k + 1:].sum() * np.exp(gaps[k]) for k in range(n_grades - 2)])
        low_square += gap_grad * gap_grad
        thresholds[0] -= 0.1 * base / (base_square**0.5 + 1e-9)
        gaps -= 0.1 * gap_grad / (np.sqrt(low_square) + 1e-9)
    return weights, thresholds[0] + np.concatenate([[0], np.cumsum(np.exp(gaps))])


def grades_of_labels(labels: DataFrame) -> DataFrame:
    """``doc_id, grade``: 0 toxic, 1 of low quality, 2 good; unreadable labels give no row."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(
        (F.col("quality") == 1) & (F.col("toxic") == 0), 2
    )
    rated = labels.select("doc_id", grade.alias("grade")).where("doc_id is not null and grade is not null")
    return rated.groupBy("doc_id").agg(F.min("grade").alias("grade"))


def fit_grades(
    docs: DataFrame, ratings: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n_grades: int = GRADES,
    sample: int = SAMPLE, bits: int = BITS,
) -> tuple[np.ndarray, np.ndarray]:
    """Fit on the texts of at most ``sample`` ratings. A rating whose document is missing is not used.

    The sample's features meet in one task; it is bounded by ``sample``.
    """
    chosen = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).select(F.col("doc_id").alias("_id"), "grade")
    # bounded by the sample size
    rated = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), "_id")

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [features(t.as_py(), bits) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(1).cast(pa.int32()), pa.array(rows, pa.list_(pa.int32()))],
                ["id", "grade", "places"],
            )

    def learn(group: pa.Table) -> pa.Table:
        group = group.sort_by([("id", "ascending"), ("grade", "ascending")])
        rows = [np.array(r, np.int64) for r in group["places"].to_pylist()]
        weights, thresholds = fit(rows, group["grade"].to_numpy().astype(np.int64), n_grades, bits)
        return pa.table({"weights": [weights.astype(np.float32).tobytes()], "thresholds": [thresholds.tobytes()]})

    encoded = rated.select("_id", "grade", "_text").mapInArrow(encode, "id long, grade int, places array<int>")
    model = encoded.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(learn, "weights binary, thresholds binary").first()
    if model is None:
        return fit([], np.zeros(0, np.int64), n_grades, bits)
    return np.frombuffer(bytes(model[0]), np.float32), np.frombuffer(bytes(model[1]))


def grade_column(df: DataFrame, text_col: str, weights: np.ndarray, thresholds: np.ndarray, tail: int) -> Column:
    """A struct of ``score``, ``expected_grade`` and ``tail_prob`` = P(grade >= tail) for a text column."""
    bits = len(weights).bit_length() - 1
    shared = df.sparkSession.sparkContext.broadcast((weights, thresholds))  # bounded: 2 ** bits numbers

    @F.arrow_udf("score double, expected_grade double, tail_prob double")
    def grade(texts: pa.Array) -> pa.Array:
        weights, thresholds = shared.value
        score = np.fromiter((weights[features(t.as_py(), bits)].sum() for t in texts), float, len(texts))
        tails = link(score, thresholds)
        return pa.StructArray.from_arrays(
            [pa.array(score), pa.array(tails.sum(1)), pa.array(tails[:, tail - 1])], ["score", "expected_grade", "tail_prob"]
        )

    return grade(F.col(text_col))


def select_by_grade(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", tail: int = GRADES - 1,
    least: float = 0.5, sample: int = SAMPLE,
) -> DataFrame:
    """All rows and columns with one more, ``graded``: ``score, expected_grade, tail_prob, selected``.

    ``selected`` holds where P(grade >= tail) is at least ``least``. A null text is graded as an empty
    one; without any usable rating all texts get the same grade. Rows are graded each by itself, so
    repeated ids and an empty table need no care; a column named ``graded`` is replaced.
    """
    ratings = grades_of_labels(labels)
    weights, thresholds = fit_grades(docs, ratings, id_col=id_col, text_col=text_col, sample=sample)
    graded = docs.withColumn("graded", grade_column(docs, text_col, weights, thresholds, tail))
    return graded.withColumn("graded", F.col("graded").withField("selected", F.col("graded.tail_prob") >= least))
