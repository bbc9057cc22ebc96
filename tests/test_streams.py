"""Streams equal their tables, over restarts and repeated batches."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.errors import AnalysisException

from casetable.operators.order import every_n_summary
from casetable.sources.tables import LOG_SCHEMA, parse_log, read_log
from casetable.streaming import log_streams as S


def write(folder, name, events):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.log").write_text("\n".join(e if isinstance(e, str) else json.dumps(e) for e in events) + "\n")


def events(lo, hi):
    return [
        {"event": "chunk_done", "run": f"r{i % 5 and 1}", "seq": i, "ts": f"2024-01-01T00:{i // 60:02d}:{i % 60:02d}.000000",
         "problem_id": i % 7, "ok": i % 4 != 0, "call_elapsed_cs": i * 3, "solution_indices": [i % 3] if i % 2 else [i % 3, 5],
         "progress": f"{i}/999", "total_elapsed_cs": i * 11}
        for i in range(lo, hi)
    ]


def live(spark, folder, **options):
    return parse_log(spark.readStream.options(**options).text(str(folder)), LOG_SCHEMA)


def same_rows(got, want):
    got = got.select(*want.columns)
    return got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def until(condition, seconds=120):
    """Wait for what a stream that goes on will bring about."""
    end = time.time() + seconds
    while not condition():
        assert time.time() < end, "it did not come about"
        time.sleep(0.5)


def n_rows(spark, path):
    try:
        return spark.read.parquet(path).count()
    except AnalysisException:
        return 0


@pytest.fixture(autouse=True)
def one_state_partition(spark):
    """Each partition of a state store takes a Python worker of its own in every batch."""
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_every_n_over_restarts_in_mid_group(spark, tmp_path):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    rnd = random.Random(1)
    # the second part leaves run r0 without a single event
    parts = [events(0, 37), [e for e in events(37, 60) if e["run"] == "r1"], ["oops", {"event": "done", "run": "r1"}], events(60, 140)]
    for i, part in enumerate(parts):
        rnd.shuffle(part)
        write(logs, f"{i}", part)
        S.stream_every_n(live(spark, logs), out, state, 10).awaitTermination()
    want = every_n_summary(read_log(spark, str(logs)), 10)
    assert want.count() > 5 and want.where("failed like '%#[%'").count() > 5
    assert same_rows(spark.read.parquet(out), want)
    S.stream_every_n(live(spark, logs), out, state, 10).awaitTermination()  # nothing new
    assert spark.read.parquet(out).count() == want.count()
    assert not [p for p in (tmp_path / "out").iterdir() if "batch" in p.name]


def test_every_n_with_missing_parts(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    rows = events(0, 12)
    for i, e in enumerate(rows):
        for name in list(e):
            if name in ("solution_indices", "progress", "total_elapsed_cs", "problem_id") and (i + len(name)) % 3 == 0:
                del e[name]
    write(logs, "0", rows)
    S.stream_every_n(live(spark, logs), out, str(tmp_path / "state"), 4).awaitTermination()
    want = every_n_summary(read_log(spark, str(logs)), 4)
    assert same_rows(spark.read.parquet(out), want) and want.count() == 2


def test_a_stream_goes_on_until_it_is_stopped(spark, tmp_path):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    write(logs, "0", events(0, 15))
    query = S.stream_every_n(live(spark, logs), out, state, 5, trigger={"processingTime": "1 second"})
    try:
        until(lambda: n_rows(spark, out) == 2)
        assert query.isActive
        write(logs, "1", events(15, 40))
        until(lambda: n_rows(spark, out) == 7)
    finally:
        query.stop()
    assert same_rows(spark.read.parquet(out), every_n_summary(read_log(spark, str(logs)), 5))


def test_a_finished_run_is_forgotten(spark, tmp_path):
    """Behind the timer its positions begin anew."""
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    one = [e for e in events(0, 60) if e["run"] == "r1"]
    write(logs, "0", [*one[:7], {"event": "done", "run": "r1"}])
    query = S.stream_every_n(live(spark, logs), out, state, 5, trigger={"processingTime": "1 second"}, keep_ms=1)
    try:
        until(lambda: n_rows(spark, out) == 1)
        seen = query.lastProgress["batchId"]
        until(lambda: query.lastProgress["batchId"] >= seen + 3)
        write(logs, "1", one[7:12])
        until(lambda: n_rows(spark, out) == 2)
    finally:
        query.stop()
    assert sorted(r.done_so_far for r in spark.read.parquet(out).collect()) == [5, 5]


def test_passed_lines(spark, tmp_path):
    logs, out, state = tmp_path / "logs", str(tmp_path / "out"), str(tmp_path / "state")
    for i, part in enumerate([[*events(0, 3), "oops"], [{"event": "done"}, "Traceback"], events(3, 5)]):
        write(logs, f"{i}", part)
        S.stream_passed(live(spark, logs), out, state).awaitTermination()
    passed = sorted(((r.event or ""), (r.raw or "")) for r in spark.read.parquet(out).collect())
    assert passed == [("", "Traceback"), ("", "oops"), ("done", "")]


def test_append_once_over_restarts_and_repeats(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    for i, part in enumerate([events(0, 20), events(5, 30), events(0, 31)]):
        write(logs, f"{i}", part)
        rows = live(spark, logs).select("problem_id", "run", "seq")
        S.append_once(rows, out, str(tmp_path / "state"), ["problem_id", "run"], "seq", buckets=4).awaitTermination()
    want = {(e["problem_id"], e["run"]) for e in events(0, 31)}
    got = [(r.problem_id, r.run) for r in S.read_appended(spark, out).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    # lost checkpoint: everything is offered again, and more; the stored keys are the first state of the new one
    write(logs, "9", events(31, 50))
    again = spark.readStream.schema("problem_id long, run string, seq long").option("maxFilesPerTrigger", 1).json(str(logs))
    S.append_once(again, out, str(tmp_path / "state2"), ["problem_id", "run"], "seq", buckets=4).awaitTermination()
    got = [(r.problem_id, r.run) for r in S.read_appended(spark, out).collect()]
    assert len(got) == len(set(got)) and set(got) == {(e["problem_id"], e["run"]) for e in events(0, 50)}


def test_a_batch_reads_nothing_but_its_own_rows(spark, tmp_path):
    """Over twenty batches the rows read stay those of the batch."""
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    for i in range(20):
        write(logs, f"{i:02d}", events(i * 10, i * 10 + 12))
    rows = live(spark, logs, maxFilesPerTrigger=1).select("seq", "run")
    query = S.append_once(rows, out, str(tmp_path / "state"), ["seq"], "seq", buckets=2)
    query.awaitTermination()
    read = [p["numInputRows"] for p in query.recentProgress if p["numInputRows"]]
    assert read == [12] * 20
    assert sorted(r.seq for r in S.read_appended(spark, out).collect()) == list(range(202))
    plan = query._jsq.explainInternal(False) if hasattr(query, "_jsq") else ""
    assert "writer=" not in plan


def test_null_keys_are_kept_once_and_the_lowest_order_wins(spark, tmp_path):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    for i in range(2):
        write(logs, f"{i}", [
            {"event": "chunk_done", "seq": 5 + i}, {"event": "chunk_done", "seq": 3 + i}, {"event": "chunk_done"},
            {"event": "chunk_done", "seq": 9, "problem_id": 1}, {"event": "chunk_done", "problem_id": 1}, {"event": "chunk_done", "problem_id": 2},
        ])
        rows = live(spark, logs).select("problem_id", "seq")
        S.append_once(rows, out, str(tmp_path / "state"), ["problem_id"], "seq", buckets=2).awaitTermination()
    got = {r.problem_id: r.seq for r in S.read_appended(spark, out).collect()}
    assert got == {None: 3, 1: 9, 2: None} and S.read_appended(spark, out).count() == 3


def test_totals_keep_two_folders(spark, tmp_path):
    logs, out, state = tmp_path / "logs", tmp_path / "out", str(tmp_path / "state")
    for i in range(4):
        write(logs, f"{i}", events(i * 20, i * 20 + 20))
        S.stream_totals(live(spark, logs), str(out), state).awaitTermination()
    got = {r.run: (r.done, r.ok_count) for r in S.read_totals(spark, str(out)).collect()}
    every = events(0, 80)
    assert got == {r: (sum(e["run"] == r for e in every), sum(e["run"] == r and e["ok"] for e in every)) for r in ("r0", "r1")}
    assert len(list(out.iterdir())) == 2


@pytest.mark.parametrize("n", [1, 1000])
def test_groups_of_one_and_groups_never_full(spark, tmp_path, n):
    logs, out = tmp_path / "logs", str(tmp_path / "out")
    write(logs, "0", events(0, 12))
    S.stream_every_n(live(spark, logs), out, str(tmp_path / "state"), n).awaitTermination()
    assert spark.read.schema("group_no long").parquet(out).count() == (12 if n == 1 else 0)
