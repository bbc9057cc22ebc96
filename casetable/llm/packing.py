"""Packing token sequences by multiway differencing (Karmarkar-Karp).

Documents are tokenised and cut; whole windows leave at once and what remains of each
document, in pieces of bounded length, waits in a pool of a few dozen windows. A full pool is
split by differencing: every piece starts as a partial partition of its own, and the two
partial partitions with the largest imbalance are merged with opposing sums, largest to
smallest, until one is left. Its windows are near equal; if one exceeds the capacity, the
number of windows rises and the pool is split again.

A pool lives inside one task and is bounded, so nothing is shuffled and a lost task is simply
run again on its own rows.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
#: No piece of a document's remainder is longer; several per window are needed for a near-equal split.
PIECE = 256
#: Windows in a pool.
POOL = 48
END = 0

SCHEMA = (
    "doc_id long, start long, ids binary, doc_tokens long, sequence_id long, offset long"
)
_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary()), ("doc_tokens", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()),
])


def difference(sizes: Sequence[int], parts: int) -> list[list[int]]:
    """Split the sizes into ``parts`` groups of near-equal sums; returns the places in each group."""
    if not sizes:
        return [[] for _ in range(parts)]
    # a partial partition: its sums from large to small, and a tree of places for each sum
    heap = [(-s, i, [s] + [0] * (parts - 1), [i] + [None] * (parts - 1)) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    tie = len(sizes)
    while len(heap) > 1:
        _, _, a, held_a = heapq.heappop(heap)
        _, _, b, held_b = heapq.heappop(heap)
        sums = [x + y for x, y in zip(a, reversed(b))]
        held = [y if x is None else x if y is None else (x, y) for x, y in zip(held_a, reversed(held_b))]
        order = sorted(range(parts), key=sums.__getitem__, reverse=True)
        sums = [sums[i] for i in order]
        heapq.heappush(heap, (sums[-1] - sums[0], tie, sums, [held[i] for i in order]))
        tie += 1
    groups = []
    for tree in heap[0][3]:
        group, todo = [], [] if tree is None else [tree]
        while todo:
            at = todo.pop()
            if isinstance(at, tuple):
                todo += at
            else:
                group.append(at)
        groups.append(sorted(group))
    return groups


def split_pool(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Differencing into the fewest windows that hold the sizes, more where one would overflow."""
    parts = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = difference(sizes, parts)
        if all(sum(sizes[i] for i in g) <= capacity for g in groups):
            return [g for g in groups if g]
        parts += 1


def added_tokens(tokenizer_file: str) -> dict[str, int]:
    """The strings that a tokenizer file adds to its vocabulary, which are one id wherever they stand in a text."""
    with open(tokenizer_file, encoding="utf-8") as f:
        added = json.load(f)["added_tokens"]  # a vocabulary file is bounded
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
        raise ValueError("only added tokens that stand for themselves are supported")
    return {t["content"]: t["id"] for t in added}


def byte_level_encoder(rank_file: str, added: Mapping[str, int]) -> Callable[[str], np.ndarray]:
    """Ids of a byte-level vocabulary in rank form, and of the strings added to it."""
    known = _ENCODINGS.get((rank_file, *added.items()))
    if known is None:
        import public_tokenizers
        import tiktoken

        with open(rank_file, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        known = tiktoken.Encoding("packing", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=dict(added))
        _ENCODINGS.clear()
        _ENCODINGS[(rank_file, *added.items())] = known
    return lambda text: known.encode_to_numpy(text, allowed_special="all")


#: The encoding that a Python worker used last; it is kept from task to task.
_ENCODINGS: dict = {}


class Packer:
    """The windows of one task."""

    def __init__(self, first: int, capacity: int, piece: int, pool: int):
        self.sequence, self.capacity, self.piece, self.room = first, capacity, piece, pool * capacity
        self.pieces: list[tuple] = []  # doc, start, ids, tokens of the document
        self.waiting = 0
        self.rows: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, cap = len(ids), self.capacity
        whole = n // cap * cap
        for at in range(0, whole, cap):
            self.rows.append((doc_id, at, ids[at:at + cap].tobytes(), n, self.sequence, 0))
            self.sequence += 1
        for at in range(whole, n, self.piece):
            self.pieces.append((doc_id, at, ids[at:at + self.piece], n))
        self.waiting += n - whole
        if self.waiting >= self.room:
            self.split()

    def split(self) -> None:
        for group in split_pool([len(p[2]) for p in self.pieces], self.capacity) if self.pieces else []:
            offset = 0
            for i in group:
                doc_id, start, ids, n = self.pieces[i]
                self.rows.append((doc_id, start, ids.tobytes(), n, self.sequence, offset))
                offset += len(ids)
            self.sequence += 1
        self.pieces, self.waiting = [], 0

    def take(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows)) or [[]] * len(_ARROW)
        self.rows = []
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def pack_documents(
    docs: DataFrame, rank_file: str, added: Mapping[str, int] | None = None, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
    piece: int = PIECE, pool: int = POOL,
) -> DataFrame:
    """One row per piece: ``doc_id, start, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit token ids; strings in ``added`` have one id of their own,
    and every document ends with id 0. A null or
    empty text is that one id. A document longer than a window fills whole windows first. Rows
    with null or repeated ids are packed each on its own; an empty table gives no rows. Sequence
    ids are unique, rising inside a task; the input's other columns are not looked at.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId() << 33, capacity, piece, pool)
        encode = None
        for batch in batches:
            encode = encode or byte_level_encoder(rank_file, added or {})
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                ids = encode(text.as_py() or "")
                packer.add(doc_id.as_py(), np.append(ids, END).astype("<u4"))
                if len(packer.rows) >= 4096:
                    yield packer.take()
        packer.split()
        yield packer.take()

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, SCHEMA)


def piece_length(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("bigint")


def sequences(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The sequences themselves: ``sequence_id, ids, tokens``, padded with zero bytes to the capacity."""
    part = F.struct("offset", "ids")  # bounded: the pieces of one window
    ids = F.aggregate(
        F.array_sort(F.collect_list(part)), F.lit(b"").cast("binary"), lambda acc, p: F.concat(acc, p["ids"])
    )
    return packed.groupBy("sequence_id").agg(ids.alias("ids")).select(
        "sequence_id",
        F.rpad("ids", F.lit(4 * capacity), F.lit(b"\0")).alias("ids"),
        piece_length(F.col("ids")).alias("tokens"),
    )
