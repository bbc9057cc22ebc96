"""Language-model scores by online logistic context mixing.

A text is coded as its lower-cased words, one end byte after each word and one more end at the
close. Every byte is a path of binary decisions in a Huffman tree (few decisions for common bytes),
and each decision is predicted by several hashed-context predictors: the tree node with two, three and
five bytes before it in the word, with the word so far (past six bytes with the last four), and with
three bytes, the place in the word and the word before, as far as that is a short one. A predictor's
table holds how often each branch was taken in the training texts.

Their predictions are mixed in the logistic domain by weights that a gate selects, whether a word
begins. The weights follow the coding error every
few words, all along the text; a last adaptive stage corrects the mixed probability by what has
happened at about that probability so far. Before each decision the probabilities of its two branches
add to 1, so a text's score is the log10 of a probability over all texts. Texts are read side by
side in one task, each with weights of its own.

Texts are held as blocks of word numbers with a vocabulary of their own. The corpus counts of a block's
words reach it by one exchange of the block's distinct words, dealt by a hash into parts of bounded
size, never of the words of the text.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetable.llm.common import rows_at_once, stored
from casetable.llm.spans import LOWER, as_binary, buffers, gathered, joined, runs
from casetable.llm.words import text_slices

#: Predictors that see the word only, all predictors, and entries of each one's table.
IN_WORD, CONTEXTS = 4, 5
SLOT_BITS = 21
#: Bytes of text in a block; of a long text all.
BLOCK_BYTES = 2 << 20
#: Distinct words of all blocks in a part of the exchange.
PART_WORDS = 500_000
#: Bytes of blocks from which one task gathers its share of the tables, at least.
TABLE_BYTES = 256 << 20
#: Blocks handed over to Python at once while tables are gathered; Spark's own bound is 64 MB, which costs several times
#: as much outside of the heap while it is filled.
BATCH_BLOCKS = 4
#: Words laid out or read at once, words of a text between two updates of its weights, and texts read side by side.
PORTION, STEP, LANES = 2048, 16, 128
END = 0  # closes a word; also the only byte of the closing end
#: A word before with more bytes is any long word, told by a number; a word so far with more is known by its last four.
SHORT, LONG, NEAR = 4, np.uint32(2), 6
#: Bytes by which words are put in order.
PREFIX = 8
#: Weights at the start of a text, the same for every gate, in the order of the contexts; how fast they and the
#: corrections follow the error.
GATES, BUCKETS = 2, 8
START = np.tile(np.array([[0.0], [0.1], [0.4], [0.3], [0.4]], np.float32), (1, GATES))
RATE, FIX_RATE = np.float32(0.002), np.float32(0.01)
#: Branches that a context is taken to have seen of each kind before any.
PRIOR = 0.1
#: Log odds are kept in steps of one part of so many; those mixed are kept within so much of 0.
SHARP = 10
LIMIT = np.float32(14)
#: Decisions whose probabilities are multiplied before a logarithm is taken; their product is a double in any case.
PRODUCT = 48
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """Whether a text is kept out of training."""
    return (F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 7) == 2


# ---------------------------------------------------------------- blocks of words

_BLOCK = pa.schema([
    ("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n_words", pa.list_(pa.int64())),
    ("words", pa.binary()), ("lengths", pa.binary()), ("train", pa.binary()), ("numbers", pa.binary()), ("n_distinct", pa.int64()),
])
_BLOCK_DDL = (
    "block long, doc_id array<long>, held array<boolean>, n_words array<long>, words binary, lengths binary, train binary, "
    "numbers binary, n_distinct long"
)


def _packed(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 as compressed bytes."""
    return pa.compress(numbers.astype("<u4").tobytes(), codec="zstd", asbytes=True)


def _unpacked(data: bytes, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, 4 * n, codec="zstd", asbytes=True), "<u4").astype(np.int64) if n else np.zeros(0, np.int64)


def word_blocks(docs: DataFrame, id_col: str, text_col: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Texts as blocks: per text its number of words, per block its distinct words one after the other with their
    lengths, their counts in training texts, and all words as numbers into that list."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    rows = rows.select("id", held_out(F.col("id")).alias("held"), "text")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            at = 0
            for part in text_slices(batch.column(2), block_bytes):
                raw, offsets = buffers(part)
                start, stop, first = runs(raw, offsets, ~_SPACE)
                place, bounds = gathered(raw, start, stop)
                coded = as_binary(LOWER[raw[place]], bounds).dictionary_encode()
                words = coded.dictionary.cast(pa.large_binary())
                ends = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
                data = words.buffers()[2]
                blob = data.to_pybytes()[ends[0]:ends[-1]] if len(words) and data is not None else b""
                numbers, n_words = coded.indices.to_numpy().astype(np.int64), np.diff(first)
                ids, held = batch.column(0).slice(at, len(part)), batch.column(1).slice(at, len(part))
                at += len(part)
                told = np.repeat(~held.to_numpy(zero_copy_only=False).astype(bool), n_words)
                train = np.bincount(numbers[told], minlength=len(words))
                row = (number, ids.to_pylist(), held.to_pylist(), n_words.tolist(), blob, _packed(np.diff(ends)), _packed(train), _packed(numbers), len(words))
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, _BLOCK)], schema=_BLOCK)
                number += 1

    return rows.mapInArrow(build, _BLOCK_DDL)


class Words:
    """The distinct words of a block in one buffer."""

    def __init__(self, blob: bytes, lengths: np.ndarray):
        self.data, self.ends = np.frombuffer(blob, np.uint8), np.concatenate([[0], np.cumsum(lengths)])

    def __len__(self) -> int:
        return len(self.ends) - 1

    def part_of(self, parts: int) -> np.ndarray:
        """The part of the exchange that each word belongs to, from its bytes."""
        if not len(self):
            return np.zeros(0, np.int64)
        at = np.arange(len(self.data)) - np.repeat(self.ends[:-1], np.diff(self.ends))
        mixed = (self.data.astype(np.uint64) + np.uint64(1)) * ((at.astype(np.uint64) * np.uint64(2) + np.uint64(1)) * _MIX)
        total = np.add.reduceat(mixed ^ (mixed >> np.uint64(31)), self.ends[:-1]) * np.uint64(0xD6E8FEB86659FD93)
        return ((total >> np.uint64(33)) % np.uint64(parts)).astype(np.int64)


# ---------------------------------------------------------------- corpus counts of a block's words


def corpus_counts(blocks: DataFrame, parts: int) -> DataFrame:
    """``block, part, counts, distinct, total``: how often each word of a block that belongs to a part comes in
    all training texts, in the block's order; the last two, once a part, are its training words."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob, lengths, train, n in zip(*(c.to_pylist() for c in batch.columns)):
                words = Words(blob, _unpacked(lengths, n))
                train, part = _unpacked(train, n), words.part_of(parts)
                order = np.argsort(part, kind="stable")
                cuts = np.searchsorted(part[order], np.arange(parts + 1))
                rows = []
                for p in np.flatnonzero(np.diff(cuts)):
                    some = order[cuts[p]:cuts[p + 1]]
                    place, bounds = gathered(words.data, words.ends[some], words.ends[some + 1])
                    rows.append((int(p), block, words.data[place].tobytes(), _packed(np.diff(bounds)), _packed(train[some]), len(some)))
                if rows:
                    yield pa.RecordBatch.from_arrays([
                        pa.array(c, k) for c, k in zip(zip(*rows), (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64()))
                    ], ["part", "block", "words", "lengths", "train", "n"])

    def count(group: pa.Table) -> pa.Table:
        sizes = group["n"].to_pylist()
        lengths = np.concatenate([_unpacked(x, n) for x, n in zip(group["lengths"].to_pylist(), sizes)])
        train = np.concatenate([_unpacked(x, n) for x, n in zip(group["train"].to_pylist(), sizes)])
        data = np.frombuffer(b"".join(group["words"].to_pylist()), np.uint8)
        codes = as_binary(data, np.concatenate([[0], np.cumsum(lengths)])).dictionary_encode().indices.to_numpy()
        total = np.zeros(codes.max(initial=-1) + 1, np.int64)
        np.add.at(total, codes, train)
        known, cuts = total[codes], np.cumsum([0, *sizes])
        first = np.arange(len(sizes)) == 0
        return pa.table({
            "block": group["block"], "part": group["part"],
            "counts": pa.array([known[a:b].astype("<i8").tobytes() for a, b in zip(cuts, cuts[1:])], pa.binary()),
            "distinct": pa.array(np.where(first, (total > 0).sum(), 0)), "total": pa.array(np.where(first, total.sum(), 0)),
        })

    sent = blocks.select("block", "words", "lengths", "train", "n_distinct").mapInArrow(
        send, "part long, block long, words binary, lengths binary, train binary, n long"
    )
    return sent.groupBy("part").applyInArrow(count, "block long, part long, counts binary, distinct long, total long")


# ---------------------------------------------------------------- the decision tree of bytes


def byte_tree(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Huffman paths for all 256 bytes: where each path starts, and its nodes and branches."""
    heap = [(int(c) + 1, b, (b,)) for b, c in enumerate(counts)]
    heapq.heapify(heap)
    paths: list[list[tuple[int, int]]] = [[] for _ in range(256)]
    node = 0
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for branch, side in ((0, a), (1, b)):
            for byte in side[2]:
                paths[byte].append((node, branch))
        heapq.heappush(heap, (a[0] + b[0], 256 + node, a[2] + b[2]))
        node += 1
    flat = [step for path in paths for step in reversed(path)]
    starts = np.concatenate([[0], np.cumsum([len(p) for p in paths])])
    return starts, np.array([n for n, _ in flat], np.uint64), np.array([b for _, b in flat], bool)


def by_prefix(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Words in the order of their first bytes, and how many bytes, the end counted, each has as the one before it."""
    lengths = np.diff(words.ends)
    key = np.zeros(len(words), np.uint64)
    for k in range(PREFIX):
        some = np.flatnonzero(lengths > k)
        key[some] |= words.data[words.ends[some] + k].astype(np.uint64) << np.uint64(56 - 8 * k)
    order = np.argsort(key, kind="stable")
    key, size = key[order], lengths[order] + 1
    shared = np.zeros(len(words), np.int64)
    for k in range(PREFIX):
        shared[1:] += (key[1:] ^ key[:-1]) >> np.uint64(56 - 8 * k) == 0
    shared[1:] = np.minimum(shared[1:], np.minimum(size[1:], size[:-1]))
    return order, shared


class Portion:
    """The decisions of some words, those of a common beginning once: the slots of the contexts in the word, branches,
    what the context of the word before is hashed with, and of which ``byte`` they are. ``of`` are the decisions of one
    word after the other, from ``first`` on, and ``source`` their bytes.
    """

    def __init__(self, words: Words, some: np.ndarray, shared: np.ndarray, tree, slot_bits: int):
        starts, nodes, branches = tree
        self.lengths = lengths = words.ends[some + 1] - words.ends[some] + 1
        last = np.cumsum(lengths) - 1
        begin = last + 1 - lengths
        data = np.zeros(int(lengths.sum()), np.uint8)  # END is 0
        inside = np.ones(len(data), bool)
        inside[last] = False
        data[inside] = words.data[gathered(words.data, words.ends[some], words.ends[some + 1])[0]]
        place = np.arange(len(data)) - np.repeat(begin, lengths)
        shared = np.where(np.arange(len(some)) > 0, shared, 0)
        new = place >= np.repeat(shared, lengths)
        self.source = np.cumsum(new) - 1
        for k in range(min(PREFIX, int(shared.max(initial=0)))):
            have = np.flatnonzero(lengths > k)
            at = begin[have] + k
            self.source[at] = np.maximum.accumulate(np.where(shared[have] <= k, self.source[at], -1))
        all_steps, steps = np.diff(starts)[data], np.diff(starts)[data[new]]
        at = np.flatnonzero(new)
        codes, place, data = data.astype(np.uint64) + np.uint64(1), place[at], data[at]
        back, so_far = [], np.zeros(len(data), np.uint64)
        for k in range(1, NEAR + 1):
            back.append(codes.take(np.maximum(at - k, 0)) * (place >= k))
            so_far += back[-1] * np.uint64(pow(int(_MIX), k - 1, 1 << 64))  # hash of the word so far, if not longer
        m = np.uint64(0x100000001B3)
        two = back[0] * m + back[1]
        three = two * m + back[2]
        four = three * m + back[3]
        far = np.where(place <= NEAR, so_far ^ (so_far >> np.uint64(29)), four ^ np.uint64(0x5BD1E995))
        contexts = [two, three, four * m + back[4], far]
        near = three * np.uint64(3) + np.minimum(place, 3).astype(np.uint64)
        first = np.cumsum(steps) - steps
        self.byte = byte = np.repeat(np.arange(len(data)), steps)
        where = (starts[data] - first).take(byte)
        where += np.arange(len(where))
        in_slots = (nodes * np.uint64(0xA0761D6478BD642F)).take(where)
        shift = np.uint64(64 - slot_bits)
        self.slots = []
        for k, c in enumerate(contexts):  # what a byte's decisions share is computed once a byte
            x = ((c + np.uint64(k + 1)) * np.uint64(0xD6E8FEB86659FD93)).take(byte)
            x += in_slots
            x ^= (c << np.uint64(17)).take(byte)
            x *= np.uint64(0xE7037ED1A0B428DB)
            x >>= shift
            self.slots.append(x.view(np.int64))
        x = (near * np.uint64(0xBF58476D1CE4E5B9)).take(byte)
        x += (nodes * np.uint64(0x94D049BB133111EB)).take(where)
        x >>= np.uint64(32)
        self.base, self.branch = x.astype(np.uint32), branches.take(where)
        self.of = _expand(first[self.source], all_steps)
        self.first = (np.cumsum(all_steps) - all_steps)[begin]


class Decisions:
    """The decisions of a list of words: their number, that of a word's first byte, and all of them by portions of the words
    in order; ``rank`` is a word's place there. All at once would take many times the bytes of the words."""

    def __init__(self, words: Words, tree, slot_bits: int = SLOT_BITS):
        self.words, self.tree, self.slot_bits = words, tree, slot_bits
        steps = np.diff(tree[0])
        ends = np.concatenate([[0], np.cumsum(steps.take(words.data))])[words.ends]
        self.per_word = np.diff(ends) + steps[END]
        self.in_first = np.full(len(words), steps[END])
        some = np.flatnonzero(np.diff(words.ends))
        self.in_first[some] = steps[words.data[words.ends[some]]]
        self.order, self.shared = by_prefix(words)
        self.rank = np.empty_like(self.order)
        self.rank[self.order] = np.arange(len(words))

    def portions(self) -> Iterator[tuple[int, np.ndarray, Portion]]:
        """The rank of the first word, the words, and their decisions."""
        for begin in range(0, len(self.words), PORTION):
            here = slice(begin, begin + PORTION)
            yield begin, self.order[here], Portion(self.words, self.order[here], self.shared[here], self.tree, self.slot_bits)

    def pairs(self, words: np.ndarray, before: np.ndarray, **more) -> tuple[np.ndarray, ...]:
        """Distinct words with the word before, by rank, as numbers; see ``np.unique``."""
        return np.unique(self.rank[words] << 32 | before, **more)

    def of_pairs(self, pairs: np.ndarray, begin: int, p: Portion) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
        """Of the pairs of a portion, some at a time: which, where their decisions stand, and for each pair the word before
        and the number of decisions."""
        at, stop = np.searchsorted(pairs, [begin << 32, begin + PORTION << 32])
        for a in range(at, stop, PORTION):
            here = slice(a, min(a + PORTION, stop))
            rank = pairs[here] >> 32
            count = self.per_word[self.order[rank]]
            yield here, p.of.take(_expand(p.first[rank - begin], count)), pairs[here].astype(np.uint32), count

    @cached_property
    def whole(self) -> dict[str, np.ndarray]:
        """All decisions, one word after the other by rank."""
        parts = [(np.stack(p.slots)[:, p.of], p.base[p.of], p.branch[p.of]) for _, _, p in self.portions()]
        return {"slots": np.concatenate([x[0] for x in parts], axis=1), "base": joined([x[1] for x in parts]), "branch": joined([x[2] for x in parts])}

    @property
    def slots(self) -> np.ndarray:
        return self.whole["slots"]

    @property
    def base(self) -> np.ndarray:
        return self.whole["base"]

    @property
    def branch(self) -> np.ndarray:
        return self.whole["branch"]

    @cached_property
    def first(self) -> np.ndarray:
        """Where a word's decisions begin among all."""
        count = self.per_word[self.order]
        return (np.cumsum(count) - count)[self.rank]

    @property
    def begins(self) -> np.ndarray:
        """Whether a decision is of a word's first byte."""
        out = np.zeros(len(self.branch), bool)
        out[_expand(self.first, self.in_first)] = True
        return out


def short_words(words: Words) -> np.ndarray:
    """What tells a short word from others where it stands before a word; the same for all longer ones."""
    lengths = np.diff(words.ends)
    so_far = np.zeros(len(words), np.uint64)
    for k in range(SHORT):
        some = np.flatnonzero((lengths > k) & (lengths <= SHORT))
        so_far[some] = so_far[some] * _MIX + words.data[words.ends[some] + k] + np.uint64(1)
    whole = ((so_far * np.uint64(0xE7037ED1A0B428DB)) >> np.uint64(32)).astype(np.uint32)
    return np.where(lengths <= SHORT, whole, LONG)


def with_before(base: np.ndarray, before: np.ndarray | np.uint32, slot_bits: int) -> np.ndarray:
    """The slot of a decision with the word before."""
    with np.errstate(over="ignore"):
        x = base ^ (before * np.uint32(0x9E3779B1))
    x *= np.uint32(0x85EBCA6B)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0xC2B2AE35)
    x >>= np.uint32(32 - slot_bits)
    return x


class Stream:
    """The words of a block's texts in order, a closing end behind each text, and the word before each."""

    def __init__(self, n_words: np.ndarray, numbers: np.ndarray, whole: np.ndarray):
        self.sizes = n_words + 1
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.words = np.full(int(self.sizes.sum()), len(whole) - 1, np.int64)  # the empty word comes last
        keep = np.ones(len(self.words), bool)
        keep[self.begin + n_words] = False
        self.words[keep] = numbers
        self.before = np.zeros(len(self.words), np.uint32)
        self.before[1:] = whole[self.words[:-1]]
        self.before[self.begin] = 1


def _laid_out(row: dict, tree, slot_bits: int) -> tuple[Words, Decisions, Stream]:
    """A block's words, the decisions of these and of the empty word, and its texts."""
    lengths, n_words = _unpacked(row["lengths"], row["n_distinct"]), np.array(row["n_words"], np.int64)
    closed = Words(row["words"], np.append(lengths, 0))
    stream = Stream(n_words, _unpacked(row["numbers"], int(n_words.sum())), short_words(closed))
    return Words(row["words"], lengths), Decisions(closed, tree, slot_bits), stream


def _expand(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Where the decisions of some words stand, from where each word's first stands and their number."""
    where = np.repeat(first - (np.cumsum(count) - count), count)
    where += np.arange(len(where))
    return where


# ---------------------------------------------------------------- training


def byte_counts(blocks: DataFrame) -> np.ndarray:
    """How often each byte comes in the training texts; 256 numbers."""

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256)
        for batch in batches:
            for blob, lengths, train, n, held in zip(*(c.to_pylist() for c in batch.columns)):
                train = _unpacked(train, n)
                total += np.bincount(np.frombuffer(blob, np.uint8), np.repeat(train, _unpacked(lengths, n)), 256)
                total[END] += train.sum() + len(held) - sum(held)
        yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total.astype(np.int64))], ["byte", "n"])

    rows = blocks.select("words", "lengths", "train", "n_distinct", "held").mapInArrow(tally, "byte int, n long")
    out = np.zeros(256)
    for r in rows.groupBy("byte").agg(F.sum("n").alias("n")).collect():
        out[r.byte] = r.n
    return out


def add_block(total: np.ndarray, row: dict, tree, slot_bits: int) -> None:
    """Count the branches of a block's training texts in ``total[context, 2 * slot + branch]``."""
    words, d, stream = _laid_out(row, tree, slot_bits)
    told = ~np.array(row["held"], bool)
    train = np.append(_unpacked(row["train"], row["n_distinct"]), told.sum())
    tokens = np.repeat(told, stream.sizes)
    pairs, times = d.pairs(stream.words[tokens], stream.before[tokens], return_counts=True)
    long = pairs & 0xFFFFFFFF == LONG
    after_long = np.zeros(len(train), np.int64)
    after_long[d.order[pairs[long] >> 32]] = times[long]
    pairs, times = pairs[~long], times[~long].astype(total.dtype)
    for begin, some, p in d.portions():
        slots = [*p.slots, with_before(p.base, LONG, slot_bits).astype(np.int64)]
        for count, of in ((train, range(IN_WORD)), (after_long, [IN_WORD])):
            weight = np.bincount(p.source, np.repeat(count[some], p.lengths)).astype(total.dtype).take(p.byte)
            for k in of:
                np.add.at(total[k], slots[k] * 2 + p.branch, weight)
        for here, where, before, count in d.of_pairs(pairs, begin, p):
            slot = with_before(p.base.take(where), np.repeat(before, count), slot_bits)
            np.add.at(total[IN_WORD], slot.astype(np.int64) * 2 + p.branch.take(where), np.repeat(times[here], count))


def train_tables(blocks: DataFrame, tree, size: int, slot_bits: int = SLOT_BITS) -> np.ndarray:
    """The predictors' tables: for each context and slot the log odds of the second branch, 0 where never met.

    Tables have a fixed size, so their sum over tasks can meet on the driver; a task gathers from blocks of
    ``TABLE_BYTES`` or more, so that what is sent stays a small part of the input.
    """
    width, part = 2 << slot_bits, 1 << 14
    part = min(part, width)
    tasks = max(blocks.sparkSession.sparkContext.defaultParallelism, -(-size // TABLE_BYTES))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((CONTEXTS, width), np.uint32)
        for batch in batches:
            for at in range(batch.num_rows):  # one block at a time in Python's own memory
                add_block(total, batch.slice(at, 1).to_pylist()[0], tree, slot_bits)
        flat = total.reshape(-1, part)
        used = np.flatnonzero(flat.any(axis=1))
        for at in range(0, len(used), 64):
            some = used[at:at + 64]
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array([_packed(flat[i]) for i in some], pa.binary())], ["part", "n"])

    def add(group: pa.Table) -> pa.Table:
        total = sum(_unpacked(b, part) for b in group["n"].to_pylist()).reshape(-1, 2)
        odds = np.log((total[:, 1] + PRIOR) / (total[:, 0] + PRIOR))
        sharp = np.clip(np.round(odds * SHARP), -127, 127).astype(np.int8)
        return pa.table({"part": group["part"][:1], "odds": pa.array([sharp.tobytes()], pa.binary())})

    columns = ["held", "n_words", "words", "lengths", "train", "numbers", "n_distinct"]
    sums = blocks.select(*columns).coalesce(tasks).mapInArrow(tally, "part long, n binary").groupBy("part").applyInArrow(add, "part long, odds binary")
    out = np.zeros((CONTEXTS * width // part, part // 2), np.int8)
    with rows_at_once(blocks.sparkSession, BATCH_BLOCKS):
        for r in sums.toLocalIterator():  # bounded by slot_bits
            out[r.part] = np.frombuffer(bytes(r.odds), np.int8)
    return out.reshape(CONTEXTS, width // 2)


# ---------------------------------------------------------------- scoring


def follow(
    x: np.ndarray, taken: np.ndarray, spot: np.ndarray, same: np.ndarray, gate: np.ndarray, length: np.ndarray,
    weights: np.ndarray, fixes: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """The log odds z of the second branch of decisions, one after the other by lane, with exp(-z), and then the lanes'
    weights and corrections after them.

    ``x`` holds the predictors' log odds of the second branch, a row for each predictor, ``taken`` whether it
    was taken. What is known before gives the probability of the second branch; the first branch has
    the rest of 1. ``weights`` has a column for each gate of each lane, ``fixes`` some buckets for each lane,
    from ``spot`` on. Runs of decisions with one ``gate`` begin at ``same``.
    """
    z = x[0] * np.repeat(weights[0].take(gate), length)
    for k in range(1, CONTEXTS):
        z += x[k] * np.repeat(weights[k].take(gate), length)
    spot = spot + np.clip(z + np.float32(BUCKETS / 2), 0, BUCKETS - 1).astype(np.int64)
    z += fixes.take(spot)
    np.clip(z, -LIMIT, LIMIT, out=z)
    e = np.exp(-z)
    error = taken - 1 / (1 + e)
    for k in range(CONTEXTS):
        np.add.at(weights[k], gate, RATE * np.add.reduceat(error * x[k], same))
    fixes += FIX_RATE * np.bincount(spot, error, len(fixes)).astype(np.float32)
    return z, e


def mix(x: np.ndarray, taken: np.ndarray, row: np.ndarray, begins_word: np.ndarray, weights: np.ndarray, fixes: np.ndarray) -> np.ndarray:
    """Bits of decisions, each alone, as ``follow`` reads them; ``row`` is the lane of each."""
    key = row * GATES + begins_word
    same = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])  # runs of decisions with one gate
    z, e = follow(x, taken, row * BUCKETS, same, key[same], np.diff(same, append=len(key)), weights, fixes)
    # taken: log(1 + e); not taken: the same with z added, as 1 - 1 / (1 + e) = e / (1 + e)
    return np.log1p(e) + z * ~taken


def bits_by_lane(z: np.ndarray, e: np.ndarray, taken: np.ndarray, lanes: np.ndarray, same: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What ``mix`` gives, summed over each lane; these begin at ``lanes``. One logarithm for the product over a run."""
    parts = -(-length // PRODUCT)  # more for a long word
    first = np.cumsum(parts) - parts
    cuts = np.repeat(same - first * PRODUCT, parts) + np.arange(parts.sum()) * PRODUCT
    logs = np.log(np.multiply.reduceat(e.astype(np.float64) + 1, cuts))
    return np.add.reduceat(logs, np.searchsorted(cuts, lanes)) + np.add.reduceat((z * ~taken).astype(np.float64), lanes)


def evidence(stream: Stream, d: Decisions, tables: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the predictors know of the decisions of every word after every word that is before it in the block, eight
    bytes each: their log odds and the branch; and where those of each word of the texts begin."""
    pairs, which = d.pairs(stream.words, stream.before, return_inverse=True)
    count = d.per_word[d.order[pairs >> 32]]
    first = np.cumsum(count) - count
    out = np.empty(int(count.sum()), np.uint64)
    for begin, _, p in d.portions():
        own = np.zeros((len(p.base), 8), np.int8)
        for k in range(IN_WORD):
            own[:, k] = tables[k].take(p.slots[k])
        own[:, IN_WORD] = tables[IN_WORD].take(with_before(p.base, LONG, d.slot_bits))
        own[:, CONTEXTS] = p.branch
        own = own.view(np.uint64).ravel()
        for here, where, before, count in d.of_pairs(pairs, begin, p):
            got = own.take(where)
            other = before != LONG
            at = np.flatnonzero(np.repeat(other, count))
            slot = with_before(p.base.take(where.take(at)), np.repeat(before[other], count[other]), d.slot_bits)
            got.view(np.int8).reshape(-1, 8)[at, IN_WORD] = tables[IN_WORD].take(slot)
            out[first[here.start]:first[here.start] + len(got)] = got
    return out, first[which]


def score_texts(stream: Stream, d: Decisions, tables: np.ndarray, step: int = STEP) -> np.ndarray:
    """Bits of each text of a block, the end included."""
    known, first = evidence(stream, d, tables)
    scale = np.float32(1 / SHARP)
    order = np.argsort(-stream.sizes, kind="stable")
    total = np.zeros(len(stream.sizes))
    for lane in range(0, len(order), LANES):
        some = order[lane:lane + LANES]
        begin, length = stream.begin[some], stream.sizes[some]
        weights = np.tile(START, (1, len(some)))
        fixes = np.zeros(len(some) * BUCKETS, np.float32)
        bits = np.zeros(len(some))
        for column in range(0, int(length[0]), step):
            alive = int(np.searchsorted(-length, -column, "left"))  # the longest texts come first
            count = np.minimum(length[:alive] - column, step)
            lanes = np.cumsum(count) - count
            of = np.repeat(np.arange(alive), count)
            token = np.repeat(begin[:alive] + column - lanes, count) + np.arange(len(of))
            words = stream.words[token]
            per_word, in_first = d.per_word[words], d.in_first[words]
            where = _expand(first[token], per_word)
            # of each word the first byte and then the others, of which a closing end has none
            runs = np.stack([in_first, per_word - in_first], axis=1).ravel()
            gate = np.stack([of * GATES + 1, of * GATES], axis=1).ravel()
            gate, runs = gate[runs > 0], runs[runs > 0]
            same = np.cumsum(runs) - runs
            seen = known.take(where).view(np.int8).reshape(-1, 8)
            x = np.empty((CONTEXTS, len(seen)), np.float32)
            for k in range(CONTEXTS):
                np.multiply(seen[:, k], scale, out=x[k])
            taken = seen[:, CONTEXTS].astype(bool)
            spot = np.repeat(of * BUCKETS, per_word)
            z, e = follow(x, taken, spot, same, gate, runs, weights[:, :alive * GATES], fixes[:alive * BUCKETS])
            bits[:alive] += bits_by_lane(z, e, taken, (np.cumsum(per_word) - per_word)[lanes], same, runs)
        total[some] = bits / math.log(2)
    return total


def score_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES,
    slot_bits: int = SLOT_BITS, step: int = STEP,
) -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte`` per row.

    Training texts are those with crc32(id as text) mod 7 other than 2; all are scored. Tokens are
    the words, lower-cased in A-Z, and one end. ``base_score`` is the add-one unigram log10
    probability, ``score`` that of the mixing model over the words with their ends. A null or
    empty text is the end alone. A null id counts as an empty text in the choice of training texts;
    repeated ids are rows of their own. Without training texts all counts are 0. An empty table gives
    no rows.
    """
    blocks = stored(word_blocks(docs, id_col, text_col, block_bytes), "blocks")
    known = F.octet_length("words") + F.octet_length("lengths") + F.octet_length("train") + F.octet_length("numbers")
    told = F.size("held") - F.size(F.filter("held", lambda x: x))
    one = blocks.agg(F.sum("n_distinct").alias("words"), F.sum(known).alias("size"), F.sum(told).alias("ends")).first()
    ends, parts = one.ends or 0, max(1, -(-(one.words or 0) // PART_WORDS))
    counts = stored(corpus_counts(blocks, parts), "counts")
    seen = counts.agg(F.sum("distinct").alias("words"), F.sum("total").alias("tokens")).first()
    n_train, n_distinct = (seen.tokens or 0) + ends, (seen.words or 0) + (1 if ends else 0)
    tree = byte_tree(byte_counts(blocks))
    tables = train_tables(blocks, tree, one.size or 0, slot_bits)
    model = docs.sparkSession.sparkContext.broadcast((tables, tree))  # bounded by slot_bits

    # a block's words with their corpus counts; bounded by the block
    met = counts.groupBy("block").agg(F.collect_list(F.struct("part", "counts")).alias("known"))
    ready = blocks.drop("train").join(met, "block", "left").drop("block")
    ddl = (
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, "
        "n_bytes long, bits_per_byte double"
    )
    base = math.log10(n_train + n_distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, tree = model.value
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                words, decisions, stream = _laid_out(row, tree, slot_bits)
                corpus, part = np.zeros(len(words) + 1, np.int64), words.part_of(parts)
                for held in row["known"] or []:
                    corpus[np.flatnonzero(part == held["part"])] = np.frombuffer(held["counts"], "<i8")
                corpus[-1] = ends  # the empty word stands for the end
                logs = np.log10(corpus + 1.0) - base
                stops = stream.begin + stream.sizes
                tokens = stream.words
                per_known = np.concatenate([[0], np.cumsum(corpus[tokens] > 0)])
                per_size = np.concatenate([[0], np.cumsum(np.append(np.diff(words.ends), 0)[tokens] + 1)])
                n_bytes = per_size[stops] - per_size[stream.begin]
                bits = score_texts(stream, decisions, tables, step)
                yield pa.RecordBatch.from_arrays([
                    pa.array(row["doc_id"], pa.int64()), pa.array(row["held"], pa.bool_()), pa.array(stream.sizes),
                    pa.array(per_known[stops] - per_known[stream.begin]), pa.array(np.full(len(bits), n_train, np.int64)),
                    pa.array([math.fsum(logs[tokens[a:b]]) for a, b in zip(stream.begin, stops)]),
                    pa.array(-bits * math.log10(2)), pa.array(n_bytes), pa.array(bits / n_bytes),
                ], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"])

    return ready.mapInArrow(score, ddl)
