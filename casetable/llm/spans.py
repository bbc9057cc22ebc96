"""Runs of bytes in the texts of an Arrow column, found over whole buffers."""

from __future__ import annotations

import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes worked on at once; a longer text is worked on alone.
SLICE_BYTES = 1 << 20
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(pattern: str) -> np.ndarray:
    """Which bytes belong to words, from the pattern of one character; bytes of other than ASCII go by its answer for 0x80."""
    one = re.compile(pattern)
    inside = np.array([one.fullmatch(chr(min(b, 128))) is not None for b in range(256)])
    return inside


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, nulls as empty, and each text's place in them (one more at the end)."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    return raw, offsets - offsets[0]


def runs(raw: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and stop of every longest run of inside bytes within a text, and each text's first run (one more at the end)."""
    n = len(raw)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offsets), np.int64)
    solid = inside[raw]
    cut = np.zeros(n + 1, bool)  # places where a text begins
    cut[offsets] = True
    edge = solid.copy()
    edge[1:] &= ~solid[:-1] | cut[1:n]
    start = np.flatnonzero(edge)
    edge[:] = solid
    edge[:-1] &= ~solid[1:] | cut[1:n]
    return start, np.flatnonzero(edge) + 1, np.searchsorted(start, offsets)


def gathered(raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all bytes of the spans, one span after the other, and where each span begins in that list (one more at the end)."""
    ends = np.concatenate([[0], np.cumsum(stop - start)])
    at = np.arange(ends[-1]) + np.repeat(start - ends[:-1], stop - start)
    return at, ends


def as_binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Consecutive spans of a buffer as an Arrow column."""
    return pa.Array.from_buffers(
        pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]
    )


def joined(parts: Sequence[np.ndarray], kind=np.int64) -> np.ndarray:
    return np.concatenate(parts) if len(parts) else np.zeros(0, kind)
