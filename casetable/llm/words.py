"""Words and word shingles of text columns as 64-bit hashes, computed over whole Arrow buffers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from casetable.llm.spans import LOWER, buffers, runs

#: Text bytes worked on at once, and of these, bytes hashed at once.
SLICE_BYTES = 1 << 20
PORTION = 1 << 18
_BASE = 0x2545F4914F6CDD1D | 1
_BASE_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def spread_bits(x: np.ndarray) -> np.ndarray:
    """Mix every bit of 64-bit numbers into every other."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_slices(texts: pa.Array, size: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Consecutive parts of a text column of about ``size`` bytes; a longer text is a part of its own."""
    if not len(texts):
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
        yield texts.slice(at, to - at)
        at = to


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse."""
    both = []
    for factor in (_BASE, _BASE_INVERSE):
        power = np.full(n, factor, np.uint64)
        power[0] = 1
        both.append(np.cumprod(power, out=power))
    return both[0], both[1]


_PORTION_POWERS = _powers(PORTION)


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, A-Z lower-cased and cut at ASCII white space, and each text's first word (one more at the end).

    Words are hashed in portions of bounded size, also those of one long text.
    """
    raw, offsets = buffers(texts)
    start, stop, first = runs(raw, offsets, ~_SPACE)
    words = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        to = max(at + 1, int(np.searchsorted(stop, base + PORTION, "right")))
        part = LOWER[raw[base:stop[to - 1]]].astype(np.uint64) + np.uint64(1)
        power, inverse = _PORTION_POWERS if len(part) <= PORTION else _powers(len(part))  # else one long word
        part *= power[:len(part)]
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=total[1:])
        begins = start[at:to] - base
        words[at:to] = spread_bits((total[stop[at:to] - base] - total[begins]) * inverse[begins])
        at = to
    return words, first


def shingle_hashes(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a short text is one shingle, a blank one has none."""
    words, first = word_hashes(texts)
    factors = [np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(size)]
    if len(words) >= size:
        runs = sum(words[i:len(words) - size + 1 + i] * factors[i] for i in range(size))
        runs = spread_bits(runs)
    for a, b in zip(first[:-1], first[1:]):
        if b - a >= size:
            yield np.unique(runs[a:b - size + 1])
        elif b > a:
            short = np.sum(words[a:b] * np.array(factors[:b - a]), dtype=np.uint64, keepdims=True)
            yield spread_bits(short + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
