from __future__ import annotations

import hashlib
import random
import time

import pytest

from casetable.llm import warc as W


def archive(n, packed=True, size=60, seed=0):
    """Records with their places: bytes, and (begin, end, payload) of each."""
    rng, out, places = random.Random(seed), b"", []
    for i in range(n):
        payload = f"<p>{i}</p>".encode() + bytes(rng.choices(b"abcdefgh \r\n", k=rng.randrange(size)))
        record = W.record_bytes(f"urn:{i}", "response", payload, hashlib.sha256(payload).hexdigest(), f"http://x/{i}", None)
        record = W.member(record, 6) if packed else record
        places.append((len(out), len(out) + len(record), payload))
        out += record
    return out, places


def read(data):
    records, gaps = [], []
    for begin, end, fields, block, reason in W.salvage(data):
        if fields is None:
            gaps.append((begin, end, reason))
        else:
            records.append((begin, end, block))
    return records, gaps


@pytest.mark.parametrize("packed", [True, False])
def test_sound_archives_are_read_whole(packed):
    data, places = archive(50, packed)
    records, gaps = read(data)
    assert gaps == [] and [b for _, _, b in records] == [p for _, _, p in places]


@pytest.mark.parametrize("packed", [True, False])
@pytest.mark.parametrize("seed", range(6))
def test_a_flipped_byte_costs_one_record_and_is_logged(packed, seed):
    data, places = archive(30, packed, seed=seed)
    rng = random.Random(seed)
    hit = rng.randrange(30)
    begin, end, _ = places[hit]
    at = rng.randrange(begin + 12, end - 12)
    bad = data[:at] + bytes([data[at] ^ (1 << rng.randrange(8))]) + data[at + 1:]
    records, gaps = read(bad)
    wanted = [p for i, (_, _, p) in enumerate(places) if i != hit]
    found = [b for _, _, b in records]
    assert [b for b in found if b in wanted] == wanted
    if len(found) < 30:  # a flip in a field that no check covers may leave the record readable
        assert len(gaps) == 1 and gaps[0][0] <= at < gaps[0][1] and gaps[0][:2] == (begin, end)


def test_cut_joined_and_foreign_bytes():
    data, places = archive(20)
    cut = places[19][0] + 10
    records, gaps = read(data[:cut])
    assert len(records) == 19 and [g[:2] for g in gaps] == [(places[19][0], cut)]
    begin, end, _ = places[7]
    records, gaps = read(data[:begin] + b"some\x1f\x8b\x08 noise WARC/1.0 and more" + data[end:])
    assert len(records) == 19 and [g[0] for g in gaps] == [begin]
    assert read(b"") == ([], []) and read(b"nothing here")[1] == [(0, 12, "no version line")]


def test_wrong_lengths_and_missing_fields():
    payload = b"0123456789"
    good = W.record_bytes("urn:a", "response", payload, hashlib.sha256(payload).hexdigest(), None, None)
    for bad in (
        good.replace(b"Content-Length: 10", b"Content-Length: 11"), good.replace(b"Content-Length: 10", b"Content-Length: -3"),
        good.replace(b"Content-Length: 10\r\n", b""), good.replace(b"Content-Length: 10", b"Content-Length 10"),
    ):
        records, gaps = read(bad + good)
        assert [b for _, _, b in records] == [payload] and gaps[0][:2] == (0, len(bad))


def test_reading_takes_time_in_proportion():
    def seconds(n):
        data = archive(n, size=4000, seed=1)[0]
        at = time.process_time()
        assert len(read(data)[0]) == n
        return time.process_time() - at

    small, large = min(seconds(1000) for _ in range(2)), min(seconds(8000) for _ in range(2))
    assert large < 16 * small  # eight times the records; square growth would be 64 times


def pages(spark, rows, **more):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return df.withColumns({c: F.lit("clash") for c in more.get("clash", ())})


def test_odd_pages_come_back(spark, tmp_path):
    long = "<html>" + "wide é page " * 40_000
    twin = "<html>" + "t" * 200
    rows = [
        (1, "http://a", twin), (2, None, twin), (3, "http://c\r\nX: y", None), (4, "http://d", ""), (5, "u", long), (6, "u", "short"), (7, "u", "short"),
        (None, "n", twin), (None, "n", "x" * 99), (1, "http://again", twin), (8, "u", "\x00\r\n\r\nWARC/1.1\r\n"),
    ]
    df = pages(spark, rows, clash=("digest", "payload", "kind", "first"))
    path = str(tmp_path / "w")
    W.write_archives(W.page_records(df), path, torn_every=2, file_bytes=300)
    found = W.read_archives(spark, path)
    assert found.where("gap_reason is not null").count() > 0 and found.select("path").distinct().count() > 1
    got = sorted((tuple(r) for r in W.resolve_pages(found).collect()), key=repr)
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        again = html == twin and i != 1
        want.append((i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if again else "response", 1 if again else None))
    assert got == sorted(want, key=repr)


def test_no_pages(spark, tmp_path):
    path = str(tmp_path / "w")
    W.write_archives(W.page_records(pages(spark, [])), path)
    assert W.resolve_pages(W.read_archives(spark, path)).count() == 0
