from __future__ import annotations

import math
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest

from casetable.llm import mixing as M
from casetable.llm.spans import joined

SF = "/root/testdata/sf0.001"


def words_of(text):
    return (text or "").encode().lower().split()


def held(doc_id):
    return zlib.crc32(str("" if doc_id is None else doc_id).encode()) % 7 == 2


def base_rows(rows):
    count = Counter()
    for d, t in rows:
        if not held(d):
            count.update(words_of(t) + [None])
    n, v = sum(count.values()), len(count)
    out = []
    for d, t in rows:
        tokens = words_of(t) + [None]
        out.append((
            d, held(d), len(tokens), sum(count[w] > 0 for w in tokens), n,
            sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens),
        ))
    return out


def check(rows, got):
    want = sorted(base_rows(rows), key=repr)
    got = sorted(got, key=lambda r: repr((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score)))
    assert len(got) == len(want)
    for w, r in zip(want, got):
        assert w[:5] == (r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens)
        assert r.base_score == pytest.approx(w[5], rel=1e-12, abs=1e-9)
        assert r.score < 0 and r.bits_per_byte == pytest.approx(-r.score / math.log10(2) / r.n_bytes)


def test_held_out_documents(spark, monkeypatch):
    monkeypatch.setattr(M, "PART_WORDS", 5000)  # many parts and many blocks
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = M.score_documents(docs, block_bytes=50_000, slot_bits=18).collect()
    check([(r.doc_id, r.text) for r in docs.collect()], got)
    away = [r for r in got if r.held_out]
    assert sum(r.bits_per_byte * r.n_bytes for r in away) / sum(r.n_bytes for r in away) < 2.5  # about 4.3 by single bytes


def test_odd_rows(spark):
    rows = [(1, "a B c"), (2, None), (3, ""), (4, " \t"), (5, "É é ɐ x\x0by"), (None, "a b"), (1, "a B c"), (6, "z" * 5000), (7, "b a " * 900)]
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id bigint, text string, words int")
    check(rows, M.score_documents(df, slot_bits=12).collect())
    assert M.score_documents(df.where("doc_id > 99"), slot_bits=12).count() == 0
    alone = [i for i in range(100) if held(i)][:2]
    only = spark.createDataFrame([(i, "a b") for i in alone], "doc_id bigint, text string")
    assert {r.train_tokens for r in M.score_documents(only, slot_bits=12).collect()} == {0}
    blank = spark.createDataFrame([(1, None), (2, " ")], "doc_id bigint, text string")
    check([(1, None), (2, " ")], M.score_documents(blank, slot_bits=12).collect())


def block(texts, held_out=None):
    """The row of a block of texts, each a list of words."""
    vocabulary = sorted({w for t in texts for w in t})
    place = {w: i for i, w in enumerate(vocabulary)}
    numbers = [[place[w] for w in t] for t in texts]
    held_out = held_out or [False] * len(texts)
    train = np.bincount(joined([np.array(t, np.int64) for t, h in zip(numbers, held_out) if not h]), minlength=len(vocabulary))
    return {
        "held": held_out, "n_words": [len(t) for t in texts], "words": b"".join(vocabulary), "n_distinct": len(vocabulary),
        "lengths": M._packed(np.array([len(w) for w in vocabulary])), "train": M._packed(train),
        "numbers": M._packed(joined([np.array(t, np.int64) for t in numbers])),
    }


def texts_of(seed, n_words):
    rng = np.random.default_rng(seed)
    vocabulary = [bytes(rng.integers(97, 123, rng.integers(1, 9)).tolist()) for _ in range(60)]
    return [[vocabulary[i] for i in rng.integers(0, 60, n)] for n in n_words]


@pytest.fixture(scope="module")
def model():
    texts = texts_of(3, (0, 1, 5, 8, 40, 300, 700))
    row = block(texts, [False, True, False, False, False, False, False])
    tree = M.byte_tree(np.bincount(np.frombuffer(row["words"], np.uint8), minlength=256))
    total = np.zeros((M.CONTEXTS, 2 << 10), np.uint32)
    M.add_block(total, row, tree, 10)
    return texts, row, tree, total


def test_tables_count_every_branch_of_the_training_texts(model):
    texts, _, tree, total = model
    steps = np.diff(tree[0])
    want = sum(int(steps[b]) for i, t in enumerate(texts) if i != 1 for w in [*t, b""] for b in [*w, M.END])
    assert total.sum(axis=1).tolist() == [want] * M.CONTEXTS


def test_tables_do_not_depend_on_blocks(model):
    texts, row, tree, total = model
    again = np.zeros_like(total)
    for text, out in zip(texts, row["held"]):
        M.add_block(again, block([text], [out]), tree, 10)
    assert (again == total).all()


def one_by_one(words, tables, tree):
    """The model read word by word and decision by decision in plain Python, one text."""
    row = block([words])
    _, d, stream = M._laid_out(row, tree, 10)
    weights, fix = [[float(w) for w in gate] for gate in M.START.T], [0.0] * M.BUCKETS
    bits = 0.0
    for at in range(0, len(stream.words), M.STEP):
        change, change_fix = [[0.0] * M.CONTEXTS for _ in range(M.GATES)], [0.0] * M.BUCKETS
        for token in range(at, min(at + M.STEP, len(stream.words))):
            word = stream.words[token]
            for i in range(d.first[word], d.first[word] + d.per_word[word]):
                slots = [int(d.slots[k][i]) for k in range(M.IN_WORD)]
                slots.append(int(M.with_before(d.base[i:i + 1], stream.before[token:token + 1], 10)[0]))
                x = [float(tables[k][s]) / M.SHARP for k, s in enumerate(slots)]
                g = int(d.begins[i])
                z = sum(a * b for a, b in zip(x, weights[g]))
                b = int(min(max(z + M.BUCKETS / 2, 0), M.BUCKETS - 1))
                p = 1 / (1 + math.exp(-min(max(z + fix[b], -14), 14)))
                taken = bool(d.branch[i])
                bits -= math.log2(p if taken else 1 - p)
                for k in range(M.CONTEXTS):
                    change[g][k] += (taken - p) * x[k]
                change_fix[b] += taken - p
        for g in range(M.GATES):
            for k in range(M.CONTEXTS):
                weights[g][k] += float(M.RATE) * change[g][k]
        for b in range(M.BUCKETS):
            fix[b] += float(M.FIX_RATE) * change_fix[b]
    return bits


def test_lanes_equal_reading_one_by_one(model, monkeypatch):
    texts, row, tree, total = model
    tables = np.clip(np.round(np.log((total[:, 1::2] + 0.1) / (total[:, ::2] + 0.1)) * M.SHARP), -127, 127).astype(np.int8)
    _, d, stream = M._laid_out(row, tree, 10)
    want = [one_by_one(t, tables, tree) for t in texts]
    for lanes in (512, 2):
        monkeypatch.setattr(M, "LANES", lanes)
        assert M.score_texts(stream, d, tables) == pytest.approx(want, rel=1e-3)  # single precision


def outcomes(x, per_step):
    """Bits of every way that the decisions may go, the evidence being the same for all."""
    bits = []
    for way in range(1 << len(x)):
        taken = np.array([way >> i & 1 for i in range(len(x))], bool)
        weights, fixes, cost = M.START.copy(), np.zeros(M.BUCKETS, np.float32), 0.0
        for at in range(0, len(x), per_step):
            part = slice(at, at + per_step)
            n = len(x[part])
            cost += M.mix(x[part].T, taken[part], np.zeros(n, np.int64), np.arange(n) % 2 == 0, weights, fixes).sum()
        bits.append(cost / math.log(2))
    return np.array(bits)


@pytest.mark.parametrize("per_step", [1, 3, 10])
def test_the_probabilities_of_all_outcomes_add_to_one(monkeypatch, per_step):
    for rate in ("RATE", "FIX_RATE"):
        monkeypatch.setattr(M, rate, np.float32(0.3))  # so that what is learned would show
    x = np.random.default_rng(1).normal(0, 2, (10, M.CONTEXTS)).astype(np.float32)
    assert (2.0 ** -outcomes(x, per_step)).sum() == pytest.approx(1, abs=1e-6)


def test_fair_coins_cost_a_bit_each_on_average():
    bits = outcomes(np.zeros((8, M.CONTEXTS), np.float32), 2)
    assert bits.mean() >= 8 and bits.mean() == pytest.approx(8, abs=1e-2)


def test_the_word_before_is_told_by_short_words_only(model):
    _, d, stream = M._laid_out(block([[b"the", b"house"], [b"of", b"house"], [b"houses", b"house"], [b"horses", b"house"]]), model[2], 10)
    before = [int(stream.before[b + 1]) for b in stream.begin]
    assert len(set(before)) == 3 and before[2] == before[3]


def test_the_tree_holds_every_byte():
    starts, nodes, branches = M.byte_tree(np.arange(256))
    paths = {tuple(zip(nodes[a:b].tolist(), branches[a:b].tolist())) for a, b in zip(starts[:-1], starts[1:])}
    assert len(paths) == 256 and len(set(nodes.tolist())) == 255
    short = M.byte_tree(np.bincount([101] * 900, minlength=256))[0]
    assert short[102] - short[101] == 1


def test_training_holds_the_decisions_of_few_words_at_once():
    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, rng.integers(6, 12)).tolist()) for _ in range(40_000)]
    row = block([words])
    tree = M.byte_tree(np.bincount(np.frombuffer(row["words"], np.uint8), minlength=256))
    total = np.zeros((M.CONTEXTS, 2 << 10), np.uint32)
    tracemalloc.start()
    try:
        M.add_block(total, row, tree, 10)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    decisions = int(total[0].sum())
    assert decisions > 1_000_000 and peak < 20 * decisions  # laid out whole: over 40 bytes each


def test_words_of_one_beginning_share_their_decisions():
    words = sorted({b"a", b"ab", b"abc", b"abcdefgh", b"abcdefghi", b"abcdefghij", b"abd", b"b", b"a\x00", b"a\x00b", "é".encode(), b"z" * 300})
    tree = M.byte_tree(np.ones(256, np.int64))
    together, _ = M._laid_out(block([words]), tree, 12)[1:]
    for i, word in enumerate(words):
        alone = M._laid_out(block([[word]]), tree, 12)[1]
        here, there = (slice(d.first[k], d.first[k] + d.per_word[k]) for d, k in ((together, i), (alone, 0)))
        assert (together.slots[:, here] == alone.slots[:, there]).all() and (together.base[here] == alone.base[there]).all()
        assert (together.branch[here] == alone.branch[there]).all() and (together.begins[here] == alone.begins[there]).all()
        assert together.per_word[i] == sum(len(range(*tree[0][b:b + 2])) for b in [*word, M.END])


def test_tables_are_gathered_from_few_blocks_at_once(spark, monkeypatch):
    key, docs = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.read.parquet(f"{SF}/documents.parquet")
    before, met = spark.conf.get(key), []
    kind = type(docs)
    monkeypatch.setattr(kind, "toLocalIterator", lambda self, *a, f=kind.toLocalIterator: met.append(spark.conf.get(key)) or f(self, *a))
    blocks = M.word_blocks(docs, "doc_id", "text", 20_000)
    M.train_tables(blocks, M.byte_tree(np.ones(256, np.int64)), 0, 10)
    assert met == [str(M.BATCH_BLOCKS)] and spark.conf.get(key) == before

    def sizes(batches):
        for b in batches:
            yield b.slice(0, 1).select(["n_distinct"]).set_column(0, "n_distinct", [b.num_rows])

    with M.rows_at_once(spark, 3):
        assert max(r.n_distinct for r in blocks.coalesce(1).mapInArrow(sizes, "n_distinct long").collect()) == 3
