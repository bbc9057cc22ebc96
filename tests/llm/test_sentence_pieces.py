from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2 as files

from casetable.llm import sentence_pieces as S

SF = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("piece_bpe_32k.model")
ODD = [
    "", " ", "  ", "   a", "a  b", " a", "a ", "a\nb", "\n\n", "\t x", "é", "\U0001f600 x", "▁", "a▁b", "x" * 300, " " * 50 + "y" + " " * 7,
    "aaaaaaaaaaaa", "the the", "Hello, World! 123 456", "中文 字符", "\x00", "ﬁ ½", "lo" * 99, "a\r\nb", "é",
]


def data(kind):
    """The model file as it is, or read as a unigram model with the same pieces and scores."""
    proto = files.ModelProto()
    with open(FILE, "rb") as f:
        proto.ParseFromString(f.read())
    if kind == S.UNIGRAM:  # log probabilities of ordinary size; the file's merge ranks lose their digits in a sum
        proto.trainer_spec.model_type = kind
        for i, piece in enumerate(proto.pieces):
            if piece.type == 1:
                piece.score = -1 - len(piece.piece) / 2 - (i * 37 % 101) / 64
    return proto.SerializeToString()


def texts():
    rng = random.Random(5)
    mixed = ["".join(rng.choice(" ▁aeinorst\nthé.,XY0") for _ in range(rng.randrange(1, 60))) for _ in range(300)]
    return ODD + mixed + pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist()


@pytest.mark.parametrize("kind", [S.BPE, S.UNIGRAM])
def test_ids_are_those_of_the_library(kind):
    library = sentencepiece.SentencePieceProcessor(model_proto=data(kind))
    encoder = S.Encoder(S.Model(data(kind)))
    some = texts()
    for text, packed in zip(some, encoder.encode(some)):
        ids = np.frombuffer(packed, "<i4").tolist()
        assert ids == library.encode(text), text[:80]
        assert encoder.model.decode(ids) == text.replace(S.MARK, " ")
    again = encoder.encode(some[:50])
    assert again == S.Encoder(S.Model(data(kind))).encode(some[:50])


def test_tables(spark):
    rows = [(i, t, "x") for i, t in enumerate(ODD)] + [(None, None, "y"), (3, "a", "z"), (3, "a", "z")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, ids string")
    encoded = S.encode(df, FILE, check=True)
    library = sentencepiece.SentencePieceProcessor(model_file=FILE)
    got = sorted(((r.doc_id, r.ids, r.round_trip) for r in encoded.collect()), key=repr)
    assert got == sorted(((d, library.encode(t or ""), True) for d, t, _ in rows), key=repr)
    back = sorted(((r.doc_id, r.text) for r in S.decode(encoded, FILE).collect()), key=repr)
    assert back == sorted(((d, (t or "").replace(S.MARK, " ")) for d, t, _ in rows), key=repr)
    assert S.encode(df.where("doc_id > 999"), FILE).count() == 0
