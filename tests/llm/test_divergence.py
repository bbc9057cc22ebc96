from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from casetable.llm import divergence
from casetable.llm.transducer import Transducer
from odd import odd_rows, odd_table, plain

COLUMNS = ("lang", "source", "part", "item", "value", "rank")


def lookup(machine, terms):
    raw = np.frombuffer(b"".join(terms), np.uint8)
    ends = np.cumsum([0] + [len(t) for t in terms])
    return machine.ordinals(raw, ends[:-1], ends[1:]).tolist()


@pytest.mark.parametrize("seed", range(5))
def test_ordinals_are_places_among_the_terms(seed):
    rng = random.Random(seed)
    terms = sorted({bytes(rng.choice(b"abc\xc3\xa9") for _ in range(rng.randrange(0 if seed else 1, 8))) for _ in range(400)})
    machine = Transducer.unpack(*Transducer.build(terms).pack())
    others = [t + b"a" for t in terms] + [t[:-1] for t in terms] + [b"zzz", b""]
    known = {t: i for i, t in enumerate(terms)}
    assert lookup(machine, terms + others) == [known.get(t, -1) for t in terms + others]


def test_automaton_is_minimal():
    terms = sorted(f"{a}{b}ing".encode() for a in "abcdefgh" for b in ("walk", "talk", "sing"))
    machine = Transducer.build(terms)
    ends = {t[i:] for t in terms for i in range(len(t) + 1)}
    futures = {frozenset(t[i:] for t in terms if t[:i] == p) for p in {t[:i] for t in terms for i in range(len(t) + 1)} for i in [len(p)]}
    assert len(machine.finals) == len(futures) < len(ends)
    assert len(Transducer.build([]).finals) == 1 and lookup(Transducer.build([]), [b"", b"a"]) == [-1, -1]


def test_unsorted_terms_are_refused():
    for terms in ([b"b", b"a"], [b"a", b"a"], [b"", b""]):
        with pytest.raises(ValueError):
            Transducer.build(terms)


def brute(rows, min_docs, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
        groups.add((lang, source))
    out = []
    for lang, source in groups:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)
        same = [s for g, s in groups if g == lang]

        def share(count):
            total = sum(count[t] for t in kept)
            return {t: 1 + 10**9 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        def f(x, y):
            return (x - y) ** 2 // (x + y)

        p, q = share(counts[lang, source]), share(sum((counts[lang, s] for s in same), Counter()))
        pairs = []
        for other in same:
            if other != source:
                o = share(counts[lang, other])
                pairs.append((sum(f(p[t], o[t]) for t in kept), other))
        terms = [(f(p[t], q[t]), t) for t in kept if counts[lang, source][t] and p[t] > q[t]]
        for part, found, most in (("pair", pairs, None), ("term", terms, top)):
            for rank, (value, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most], 1):
                out.append((lang, source, part, item, value, rank))
    return sorted(out, key=repr)


def test_equals_brute_force_with_clashing_columns(spark):
    df = odd_table(spark, clash=("term", "ordinal", "run", "value", "rank", "block"))
    got = divergence.source_divergence(df, min_docs=3).collect()
    want = brute(odd_rows(), 3)
    assert plain(got, *COLUMNS) == want and any(r[2] == "term" for r in want)


def test_many_transducers_passes_and_blocks_give_the_same(spark):
    got = divergence.source_divergence(odd_table(spark), min_docs=2, run_bytes=20, held_bytes=1500, cells=12).collect()
    assert plain(got, *COLUMNS) == brute(odd_rows(), 2)


def test_no_kept_terms_and_empty_table(spark):
    got = divergence.source_divergence(odd_table(spark), min_docs=10**6).collect()
    assert plain(got, *COLUMNS) == brute(odd_rows(), 10**6) and {r.value for r in got} == {0}
    assert divergence.source_divergence(odd_table(spark, [])).collect() == []


def test_shares_do_not_overflow():
    counts, total = np.array([10**15, 3]), np.array([2 * 10**15 + 7] * 2)
    assert divergence.shares(counts, total).tolist() == [1 + 10**9 * c // t for c, t in zip(counts.tolist(), total.tolist())]
