"""Minimal acyclic transducers: a sorted list of terms as an automaton that gives each term its ordinal."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


class Transducer:
    """States and edges of the automaton in arrays.

    Edges are sorted by ``state * 256 + byte``. What an edge adds is the number of terms that come
    before those behind it, so the sum along a term's path is its place among the terms.
    """

    def __init__(self, edges: np.ndarray, targets: np.ndarray, adds: np.ndarray, finals: np.ndarray, root: int):
        self.edges, self.targets, self.adds, self.finals, self.root = edges, targets, adds, finals, root

    @classmethod
    def build(cls, terms: Iterable[bytes]) -> Transducer:
        """From distinct terms in byte order. States that accept the same endings are made once."""
        known: dict[tuple, int] = {}
        sizes: list[int] = []  # terms behind a state
        finals: list[bool] = []
        edges: list[int] = []
        targets: list[int] = []
        adds: list[int] = []

        def close(final: bool, out: list[tuple[int, int]]) -> int:
            key = (final, *out)
            state = known.get(key)
            if state is None:
                state = known[key] = len(finals)
                size = int(final)
                for byte, target in out:
                    edges.append(state << 8 | byte)
                    targets.append(target)
                    adds.append(size)
                    size += sizes[target]
                sizes.append(size)
                finals.append(final)
            return state

        # the states along the last term, still open: whether one is final, and its closed edges
        path: list[list] = [[False, []]]
        last = b""
        for term in terms:
            if term <= last and (last or path[0][0]):
                raise ValueError("terms must be distinct and sorted")
            shared = 0
            while shared < len(last) and shared < len(term) and last[shared] == term[shared]:
                shared += 1
            for at in range(len(last), shared, -1):
                path[at - 1][1].append((last[at - 1], close(*path.pop())))
            path += [[False, []] for _ in range(len(term) - shared)]
            path[-1][0] = True
            last = term
        for at in range(len(last), 0, -1):
            path[at - 1][1].append((last[at - 1], close(*path.pop())))
        root = close(*path[0])
        return cls(
            np.array(edges, np.int64), np.array(targets, np.int32), np.array(adds, np.int32), np.array(finals, bool), root
        )

    def ordinals(self, raw: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """The place of each span of bytes among the terms, -1 where it is none. All spans advance a byte at a time."""
        out = np.full(len(start), -1, np.int64)
        live = np.arange(len(start))
        state = np.full(len(start), self.root, np.int64)
        total = np.zeros(len(start), np.int64)
        at = start.copy()
        while len(live):
            done = at == stop[live]
            if done.any():
                whole = done & self.finals[state]
                out[live[whole]] = total[whole]
                live, state, total, at = (x[~done] for x in (live, state, total, at))
            if not len(live) or not len(self.edges):
                break
            wanted = state << 8 | raw[at]
            edge = np.minimum(np.searchsorted(self.edges, wanted), len(self.edges) - 1)
            on = self.edges[edge] == wanted
            edge, live = edge[on], live[on]
            state, total, at = self.targets[edge].astype(np.int64), total[on] + self.adds[edge], at[on] + 1
        return out

    def pack(self) -> tuple[bytes, bytes, bytes, bytes, int]:
        return (
            self.edges.astype("<i8").tobytes(), self.targets.astype("<i4").tobytes(), self.adds.astype("<i4").tobytes(),
            self.finals.astype("u1").tobytes(), self.root,
        )

    @classmethod
    def unpack(cls, edges: bytes, targets: bytes, adds: bytes, finals: bytes, root: int) -> Transducer:
        return cls(
            np.frombuffer(edges, "<i8"), np.frombuffer(targets, "<i4"), np.frombuffer(adds, "<i4"),
            np.frombuffer(finals, "u1").astype(bool), root,
        )
