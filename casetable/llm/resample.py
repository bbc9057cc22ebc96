"""Importance resampling of documents towards a target distribution.

Features are runs of consecutive words, hashed by CRC-32 into a fixed number of buckets. How much
more frequent a bucket is in the target texts than in all documents is its gain; a document's
weight is its mean gain, and the highest weights with Gumbel noise added are drawn, which samples
without replacement in proportion to the weights.

The checksum is linear over bits: that of a span is the XOR of what each byte contributes at its
distance from the span's end, and of a constant for the span's length. One table holds these
contributions for all bytes and distances up to a block, so the checksums of all features of a
batch are one lookup a byte and one ``bitwise_xor.reduceat`` over the spans. Longer spans are cut
into blocks, whose values are folded in one block after the other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetable.llm.spans import LOWER, SLICE_BYTES, buffers, byte_class, gathered, joined, runs
from casetable.llm.words import text_slices
from casetable.operators.keys import assign_ids

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]"
BUCKETS = 10_000
POLYNOMIAL = 0xEDB88320
_ONES = np.uint32(0xFFFFFFFF)
#: Feature bytes looked up at once.
_PORTION = 1 << 18


class PositionTable:
    """CRC-32 of many spans at once, from byte contributions by distance from the end of a block."""

    def __init__(self, block: int = 64):
        self.block = block
        step = np.arange(256, dtype=np.uint32)
        for _ in range(8):
            step = np.where(step & 1, (step >> 1) ^ np.uint32(POLYNOMIAL), step >> 1)
        self._step = step
        rows = [step]
        for _ in range(block - 1):
            rows.append(self._past_zero(rows[-1]))
        self.table = np.concatenate(rows)  # [distance * 256 + byte]
        starts = [np.array([_ONES])]
        for _ in range(block):
            starts.append(self._past_zero(starts[-1]))
        self.starts = np.concatenate(starts)  # the initial register after so many bytes
        self.fold = []  # what each byte of the register becomes a block further on
        for k in range(4):
            x = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
            for _ in range(block):
                x = self._past_zero(x)
            self.fold.append(x)

    def _past_zero(self, register: np.ndarray) -> np.ndarray:
        return (register >> np.uint32(8)) ^ self._step[register & np.uint32(255)]

    def _past_block(self, register: np.ndarray) -> np.ndarray:
        out = np.zeros_like(register)
        for k, part in enumerate(self.fold):
            out ^= part[(register >> np.uint32(8 * k)) & np.uint32(255)]
        return out

    def _linear(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The XOR of the contributions of spans of 1 to ``block`` bytes."""
        out = []
        ends = np.cumsum(stop - start)
        at = 0
        while at < len(start):
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + _PORTION, "right")))
            place, bounds = gathered(raw, start[at:to], stop[at:to])
            distance = np.repeat(stop[at:to] - 1, stop[at:to] - start[at:to]) - place
            out.append(np.bitwise_xor.reduceat(self.table[distance * 256 + raw[place]], bounds[:-1]))
            at = to
        return joined(out, np.uint32)

    def crc32(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The unsigned CRC-32 of each span; spans may overlap, be empty, and have any length."""
        out = np.zeros(len(start), np.uint32)
        some = np.flatnonzero(stop > start)
        start, stop = start[some], stop[some]
        blocks = -(-(stop - start) // self.block)
        head = stop - (blocks - 1) * self.block  # the first block is the short one
        register = self.starts[head - start] ^ self._linear(raw, start, head)
        more = np.flatnonzero(blocks > 1)
        done = 1
        while len(more):
            at = head[more] + (done - 1) * self.block
            register[more] = self._past_block(register[more]) ^ self._linear(raw, at, at + self.block)
            done += 1
            more = more[blocks[more] > done]
        out[some] = register ^ _ONES
        return out


class Features:
    """The buckets of all features of texts."""

    def __init__(self, min_n: int, max_n: int, buckets: int):
        self.sizes, self.buckets = range(min_n, max_n + 1), buckets
        self.inside = byte_class(WORD)
        self.crc = PositionTable()

    def read(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For slices of the texts: words per text, the text of each feature, and its bucket."""
        for part in text_slices(texts, SLICE_BYTES):
            raw, offsets = buffers(part)
            raw = LOWER[raw]
            start, stop, first = runs(raw, offsets, self.inside)
            n_words = np.diff(first)
            if max(self.sizes) > 1:  # words joined by one space, one after the other
                place, bounds = gathered(raw, start, stop)
                spaced = np.full(len(place) + len(start), 32, np.uint8)
                spaced[np.arange(len(place)) + np.repeat(np.arange(len(start)), stop - start)] = raw[place]
                raw, start, stop = spaced, bounds[:-1] + np.arange(len(start)), bounds[1:] + np.arange(len(start))
            text_of = np.repeat(np.arange(len(part)), n_words)
            of, hashed = [], []
            for n in self.sizes:
                last = np.flatnonzero(text_of[n - 1:] == text_of[:len(text_of) - n + 1]) if len(text_of) >= n else np.zeros(0, np.int64)
                of.append(text_of[last])
                hashed.append(self.crc.crc32(raw, start[last], stop[last + n - 1]))
            yield n_words, joined(of), (joined(hashed, np.uint32) % np.uint32(self.buckets)).astype(np.int64)


def bucket_counts(texts: DataFrame, text_col: str, min_n: int, max_n: int, buckets: int) -> np.ndarray:
    """How many features of all texts fall into each bucket; a fixed number of counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, total = Features(min_n, max_n, buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, bucket in features.read(batch.column(0)):
                total += np.bincount(bucket, minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # bounded by the buckets
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per bucket 1000 times the log of how much more frequent it is in the target, with one feature more each, floored."""
    n, all_source, all_target = len(source), float(source.sum()), float(target.sum())
    return np.array([
        math.floor(1000 * math.log((t + 1.0) * (all_source + n) / ((s + 1.0) * (all_target + n))))
        for s, t in zip(source.tolist(), target.tolist())
    ], np.int64)


def gumbel(doc_id: Column, seed: int) -> Column:
    """1000 times a Gumbel variate, floored, from the id alone."""
    lot = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10)
    share = (lot.cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("bigint")


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text",
    min_n: int = 1, max_n: int = 1, buckets: int = BUCKETS, min_words: int = 20, percent: int = 10, seed: int = 2024,
) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` per row; ``rank`` is null for rows that are not drawn.

    Of the rows with at least ``min_words`` words the best ``percent`` of 100 by score are drawn, ties to
    the smaller id, a null id last. Only A-Z is lower-cased; repeated features count each time. A null
    or empty text has no features and weight 0, and is never drawn unless ``min_words`` is 0. Rows with
    equal ids share their noise and are drawn each on its own; a null id has the noise of an empty
    one. An empty target leaves the rarity in the documents to decide; an empty table gives no rows.
    Other columns are not looked at.
    """
    known = bucket_counts(docs, text_col, min_n, max_n, buckets)
    gain = gains(known, bucket_counts(target, target_col, min_n, max_n, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # one number a bucket

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features(min_n, max_n, buckets)
        for batch in batches:
            at = 0
            for n_words, text_of, bucket in features.read(batch.column(1)):
                n = np.bincount(text_of, minlength=len(n_words))
                total = np.zeros(len(n_words), np.int64)
                np.add.at(total, text_of, shared.value[bucket])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(at, len(n)), pa.array(n_words.astype(np.int64)), pa.array(n.astype(np.int64)),
                    pa.array(total // np.maximum(n, 1)),
                ], ["doc_id", "n_words", "n_features", "weight"])
                at += len(n)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    weighed = rows.mapInArrow(weigh, "doc_id long, n_words long, n_features long, weight long")
    scored = weighed.select("*", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score")).select(
        (F.col("n_words") < min_words).alias("out"), (-F.col("score")).alias("low"), F.col("doc_id").isNull().alias("nameless"), "*"
    )
    placed = assign_ids(scored, ["out", "low", "nameless", "doc_id"], "place")
    many = placed.where("not out").agg(F.floor(F.count(F.lit(1)) * percent / 100).cast("bigint")).first()[0]
    return placed.select(
        "doc_id", "n_features", "weight", "score",
        F.when(~F.col("out") & (F.col("place") <= many), F.col("place")).alias("rank"),
    )
