"""Files with awkward cells, snapshots, logs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from casetable.sources import sinks, tables as S


def test_csv_with_bom_quotes_and_line_ends(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes('﻿id,text,n\r\n1,"two\nlines, ""quoted""",5\r\n2,,\r\n'.encode())
    got = S.read_csv(spark, str(path), "id long, text string, n int").orderBy("id").collect()
    assert [tuple(r) for r in got] == [(1, 'two\nlines, "quoted"', 5), (2, None, None)]


def test_very_long_cell(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,text\n1," + "x" * 300_000 + "\n")
    assert len(S.read_csv(spark, str(path), "id long, text string").first().text) == 300_000


def test_tolerant_reading_splits_rows(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("id,n,text\n1,1,a\n2\n3.0,x,b\n nan,1,c\n4,2,\"d\ne\"\n5,1,f,extra\n")
    good, bad = S.read_csv_tolerant(spark, str(path), "id string, n string, text string", ["id", "n"])
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(1, 1, "a"), (4, 2, "d\ne")]
    assert sorted((r.id.strip(), r.reason, r.record) for r in bad.collect()) == [
        ("2", "short", "2"), ("3.0", "key", None), ("5", "long", "5,1,f,extra"), ("nan", "key", None)
    ]


def test_tolerant_reading_counts_cells_not_values(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text('1,5,\n2,5,"say \\"hi, you\\" now"\n3,5,"a, b",more\n4,bad,\n5,,x\n')
    good, bad = S.read_csv_tolerant(spark, str(path), "id string, size long, name string", ["id"], False, "\\")
    assert [tuple(r) for r in good.orderBy("id").collect()] == [(1, 5, None), (2, 5, 'say "hi, you" now'), (5, None, "x")]
    assert sorted((r.id, r.size, r.name, r.reason) for r in bad.collect()) == [("3", "5", "a, b", "long"), ("4", "bad", None, "type")]


def test_log_lines_that_are_no_events_pass_through(spark, tmp_path):
    path = tmp_path / "log.txt"
    path.write_text('{"event": "chunk_done", "ok": true, "seq": 1}\n\nTraceback x\n{"other": 1}\n{"event": "done"}\n')
    got = {(r.event, r.ok, r.raw) for r in S.read_log(spark, str(path)).collect()}
    assert got == {("chunk_done", True, None), (None, None, "Traceback x"), (None, None, '{"other": 1}'), ("done", None, None)}


def test_snapshot_is_replaced_as_a_whole(spark, tmp_path):
    path = str(tmp_path / "snap")
    assert sinks.publish(spark.range(5), path) == 1
    seen = sinks.read_snapshot(spark, path)
    sinks.write_table(spark.range(99), f"{path}/data-unfinished")  # a write that never finished
    assert sinks.read_snapshot(spark, path).count() == 5
    assert sinks.publish(spark.range(3), path) == 2
    assert sinks.read_snapshot(spark, path).count() == 3 and seen.count() == 5
    assert sinks.read_snapshot(spark, path, 1).count() == 5
    with pytest.raises(ValueError):
        sinks.write_table(spark.range(1), path, fmt="xlsx")


def test_of_two_writers_one_wins_and_the_other_is_told(spark, tmp_path):
    path = str(tmp_path / "snap")
    base = sinks.publish(spark.range(5), path)
    assert sinks.publish(spark.range(6), path, based_on=base) == 2
    with pytest.raises(sinks.SnapshotConflict):
        sinks.publish(spark.range(7), path, based_on=base)
    assert sinks.read_snapshot(spark, path).count() == 6
    assert len([p for p in (tmp_path / "snap").iterdir() if p.name.startswith("data-")]) == 2  # the loser's rows are gone


def test_old_snapshots_are_removed(spark, tmp_path):
    path = str(tmp_path / "snap")
    for n in range(1, 6):
        assert sinks.publish(spark.range(n), path, keep=3) == n
    kept = [p for p in (tmp_path / "snap").iterdir() if p.name.startswith("data-")]
    assert len(kept) == 3 and [sinks.read_snapshot(spark, path, v).count() for v in (3, 4, 5)] == [3, 4, 5]
    with pytest.raises(KeyError):
        sinks.read_snapshot(spark, path, 2)


def test_measures_are_taken_while_a_table_is_written(spark, tmp_path):
    from casetable.operators.profile import write_counted

    seen = write_counted(spark.range(10), str(tmp_path / "t"), even=F.count_if(F.col("id") % 2 == 0))
    assert seen == {"rows": 10, "even": 5} and spark.read.parquet(str(tmp_path / "t")).count() == 10


def test_report_has_fixed_columns(spark, tmp_path):
    sinks.write_report(spark.range(2), spark.range(1).toDF("k"), str(tmp_path), ["id", "absent"], ["k"])
    assert spark.read.parquet(f"{tmp_path}/scores").columns == ["id", "absent"]
    assert [r.absent for r in spark.read.parquet(f"{tmp_path}/scores").collect()] == ["", ""]


def test_shards_that_exist(spark, tmp_path):
    for i in (2, 10):
        spark.range(i).write.parquet(f"{tmp_path}/part-{i}")
    got = S.read_shards(spark, f"{tmp_path}/part-*", r"part-(\d+)").groupBy("rank").count().collect()
    assert {tuple(r) for r in got} == {(2, 2), (10, 10)}
