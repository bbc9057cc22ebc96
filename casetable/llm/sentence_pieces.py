"""SentencePiece encoding and decoding by shared-prefix Viterbi.

Texts become marked words: runs of the space mark and what follows up to the next mark. No piece
reaches over such a border, so a word's ids never depend on its neighbours. The distinct words of a
batch are sorted, which lays them out as a depth-first walk of their trie: the forward state of
every prefix stays on a stack, and each word starts where it departs from the word before it.

The state of a prefix depends on the model. For a unigram model it is the best total score with the
start of its last piece. For a merge (BPE) model a split is right exactly if every two neighbouring
pieces, merged on their own, stay as they are; the state is then the last piece of the one split of
the prefix that is right, and a piece is added where it stands beside the last one of its start.
Only words that begin with two marks are merged directly, as pieces of marks alone all score the same.
"""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
UNIGRAM, BPE = 1, 2
#: Words whose ids a task remembers between batches.
REMEMBERED = 300_000
_NORMAL, _UNKNOWN, _CONTROL, _USER_DEFINED, _BYTE = 1, 2, 3, 4, 6
#: A unigram model scores an unknown character so much below its lowest piece.
UNKNOWN_PENALTY = 10.0


class Model:
    """The pieces of a model file, and the walk over sorted words."""

    def __init__(self, data: bytes):
        from sentencepiece import sentencepiece_model_pb2 as files

        proto = files.ModelProto()
        proto.ParseFromString(data)
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces:
            raise ValueError("only models that keep their text as it is are supported")
        if any(p.type == _USER_DEFINED for p in proto.pieces) or proto.trainer_spec.model_type not in (UNIGRAM, BPE):
            raise ValueError("only unigram and merge models without user-defined pieces are supported")
        self.kind = proto.trainer_spec.model_type
        self.prefix = norm.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == _NORMAL}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece reaches over a word border")
        self.scores = [p.score for p in proto.pieces]
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == _UNKNOWN)
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == _BYTE}
        self.tails: dict = {}  # the pieces as a trie from their last character back; "" marks where one begins
        for piece in self.ids:
            node = self.tails
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = True
        self.letters = {c for p in self.ids for c in p}
        self.low = min((self.scores[i] for i in self.ids.values()), default=0.0) - UNKNOWN_PENALTY
        self.raw = [self._raw(p) for p in proto.pieces]
        self.beside: dict[tuple[str, str], bool] = {}
        cuts = "".join(c for c in "\n\t\r" if c not in self.letters)  # never part of a piece: words end there as well
        self.pattern = re.compile(f"{MARK}*[^{MARK}{cuts}]+|{MARK}+" + (f"|[{cuts}]" if cuts else ""))

    @staticmethod
    def _raw(piece) -> bytes:
        if piece.type == _BYTE:
            return bytes([int(piece.piece[3:5], 16)])
        if piece.type == _CONTROL:
            return b""
        return " ⁇ ".encode() if piece.type == _UNKNOWN else piece.piece.replace(MARK, " ").encode()

    def words(self, text: str) -> list[str]:
        if not text:
            return []
        marked = text.replace(" ", MARK)
        return self.pattern.findall(MARK + marked if self.prefix else marked)

    # -- merge models

    def merged(self, word: str) -> list[str]:
        """Pieces by merging the best-scored pair first, the leftmost of equals."""
        parts: list[str | None] = list(word)
        after = list(range(1, len(parts) + 1))
        before = list(range(-1, len(parts) - 1))
        heap: list[tuple] = []

        def offer(i):
            if 0 <= i and after[i] < len(parts):
                both = parts[i] + parts[after[i]]
                if both in self.ids:
                    heapq.heappush(heap, (-self.scores[self.ids[both]], i, after[i], both))

        for i in range(len(parts) - 1):
            offer(i)
        while heap:
            _, i, j, both = heapq.heappop(heap)
            if parts[i] is None or j >= len(parts) or parts[j] is None or after[i] != j or parts[i] + parts[j] != both:
                continue
            parts[i], parts[j] = both, None
            after[i] = after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p is not None]

    def fits(self, last: str, piece: str) -> bool:
        """Whether two pieces stay as they are beside each other; ``last`` may be empty."""
        key = (last, piece)
        known = self.beside.get(key)
        if known is None:
            if len(self.beside) >= 1_000_000:
                self.beside.clear()
            known = self.merged(last + piece) == ([last, piece] if last else [piece])
            self.beside[key] = known
        return known

    # -- the walk

    def walk(self, words: Sequence[str]) -> Iterator[list[str]]:
        """The pieces of each word; words come sorted."""
        starts, states = [0], [0.0 if self.kind == UNIGRAM else ""]
        extend = self.extend if self.kind == UNIGRAM else self.extend_merged
        previous = ""
        for word in words:
            if self.kind == BPE and word.startswith(MARK * 2):
                # pieces of marks alone all score the same, so their order of merging is no local matter
                yield self.merged(word)
                continue
            shared = min(len(word), len(previous))
            if word[:shared] != previous[:shared]:
                shared = next(i for i, (a, b) in enumerate(zip(word, previous)) if a != b)
            del starts[shared + 1:], states[shared + 1:]
            extend(word, shared, starts, states)
            previous = word
            pieces, end = [], len(word)
            while end:
                start = starts[end]
                pieces.append(word[start:end])
                end = start
            pieces.reverse()
            yield pieces

    def extend_merged(self, word: str, shared: int, starts: list[int], states: list[str]) -> None:
        """Start and last piece of the one right split of every longer prefix, for a merge model."""
        tails, letters, beside = self.tails, self.letters, self.beside
        for end in range(shared + 1, len(word) + 1):
            at = end - 1
            if word[at] not in letters:
                starts.append(at)
                states.append("")
                continue
            begins, node = [at], tails.get(word[at])  # a character alone is a piece
            while node is not None and at:
                at -= 1
                node = node.get(word[at])
                if node is not None and "" in node:
                    begins.append(at)
            while begins:
                start = begins.pop()  # the longest first
                piece, last = word[start:end], states[start]
                right = beside.get((last, piece))
                if right or right is None and self.fits(last, piece):
                    break
            else:
                raise AssertionError(f"no right split of {word[:end]!r}")
            starts.append(start)
            states.append(piece)

    def extend(self, word: str, shared: int, starts: list[int], states: list[float]) -> None:
        """Start of the last piece and score of the best split of every longer prefix, for a unigram model."""
        for end in range(shared + 1, len(word) + 1):
            at = place = end - 1
            known = self.ids.get(word[at])
            best = states[at] + (self.low if known is None else self.scores[known])
            node = self.tails.get(word[at])
            while node is not None and at:
                at -= 1
                node = node.get(word[at])
                if node is not None and "" in node:
                    score = states[at] + self.scores[self.ids[word[at:end]]]
                    if score >= best:  # of equals the longest piece
                        best, place = score, at
            starts.append(place)
            states.append(best)

    def spell(self, pieces: list[str]) -> list[int]:
        out: list[int] = []
        for piece in pieces:
            i = self.ids.get(piece)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in piece.encode()]
            else:
                out.append(self.unknown)
        return out

    def decode(self, ids: Sequence[int]) -> str:
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text


class Encoder:
    """Encodes batches of texts and remembers words between them."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, bytes] = {}
        self.pieces = {p: struct.pack("<i", i) for p, i in model.ids.items()}

    def packed(self, piece: str) -> bytes:
        known = self.pieces.get(piece)
        return known if known is not None else struct.pack(f"<{len(ids := self.model.spell([piece]))}i", *ids)

    def encode(self, texts: Sequence[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [self.model.words(t or "") for t in texts]
        new = sorted({w for words in split for w in words} - self.known.keys())
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = sorted({w for words in split for w in words})
        for word, pieces in zip(new, self.model.walk(new)):
            try:
                self.known[word] = b"".join([self.pieces[p] for p in pieces])
            except KeyError:  # a character outside the model
                self.known[word] = b"".join(map(self.packed, pieces))
        return [b"".join(map(self.known.__getitem__, words)) for words in split]


#: The encoder that a Python worker used last: what it remembers lives from task to task.
_ENCODERS: dict[bytes, Encoder] = {}


def _encoder(data: bytes) -> Encoder:
    if data not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[data] = Encoder(Model(data))
    return _ENCODERS[data]


def encode(
    docs: DataFrame, model_file: str, *, id_col: str = "doc_id", text_col: str = "text", check: bool = False
) -> DataFrame:
    """``doc_id, ids`` per row, and with ``check`` whether decoding the ids gives the text back.

    A null or empty text has no ids. Characters outside the model become its byte pieces, or its
    unknown piece; the space mark itself is read as a space. Rows are encoded each on its own:
    repeated or null ids and an empty table need no care. Other columns are not looked at.
    """
    with open(model_file, "rb") as f:
        data = f.read()  # a model file is bounded, half a megabyte here

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = None
        for batch in batches:
            encoder = encoder or _encoder(data)
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column(1).to_pylist()
                packed = encoder.encode(texts)
                offsets = np.cumsum([0] + [len(p) // 4 for p in packed], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<i4")))
                columns = [part.column(0), ids]
                if check:
                    back = (encoder.model.decode(np.frombuffer(p, "<i4").tolist()) for p in packed)
                    columns.append(pa.array([b == (t or "").replace(MARK, " ") for b, t in zip(back, texts)], pa.bool_()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "ids"] + ["round_trip"] * check)

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>" + ", round_trip boolean" * check)


def decode(rows: DataFrame, model_file: str, *, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``doc_id, text`` from id lists. Null ids give a null text, no ids an empty one."""
    with open(model_file, "rb") as f:
        data = f.read()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            model = model or Model(data)
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(
        run, "doc_id long, text string"
    )
