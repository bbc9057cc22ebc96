"""CSV whose cells hold line ends, cut into many splits, equals Spark's one-task reading of whole files."""

from __future__ import annotations

import random

import pytest

from casetable.sources import tables as S

SCHEMA = "id long, name string, note string"


@pytest.fixture
def small_splits(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def cell(rng):
    return rng.choice([
        "", '""', "plain", "two words", '"quoted"', '"a,b"', '"line\nend"', '"say ""hi"" now"', '"\n\n"', '","', '"x,\n"', '"\n,"', '"""\n"""',
        '"é 日本\n語"', '"' + "long line, " * rng.randrange(40) + '\n" "'[:-2], '"' + "many\n" * rng.randrange(60) + '"', '"#\t"',
    ])


def table(rng, n, header="id,name,note"):
    return "\n".join([header] + [f"{i},{cell(rng)},{cell(rng)}" for i in range(n)]) + "\n"


def same(spark, path, **options):
    want = spark.read.schema(SCHEMA).option("multiLine", True).option("escape", '"').option("header", True).csv(path)
    got = S.read_csv(spark, path, SCHEMA)
    assert got.schema.simpleString() == want.schema.simpleString()
    a, b = (sorted(map(tuple, df.collect()), key=repr) for df in (got, want))
    assert a == b
    return len(a)


@pytest.mark.parametrize("seed", range(4))
def test_equals_reading_whole_files(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    for i in range(3):
        (tmp_path / f"{i}.csv").write_text(table(rng, 60 * (i + 1)), encoding="utf-8", newline="")
    assert same(spark, str(tmp_path)) == 360


def test_one_file_runs_in_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "one.csv").write_text(table(random.Random(9), 400), newline="")
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    assert same(spark, str(tmp_path / "one.csv")) == 400


def test_a_cell_longer_than_many_splits(spark, tmp_path, small_splits):
    body = "\n".join(f"line {i}, with a comma" for i in range(400))
    (tmp_path / "a.csv").write_text(f'id,name,note\n1,"{body}",x\n2,"{body}\n","{body}"\n3,,\n', newline="")
    assert same(spark, str(tmp_path)) == 3


def test_marks_returns_blank_lines_and_no_end(spark, tmp_path, small_splits):
    (tmp_path / "a.csv").write_bytes('﻿id,name,note\r\n1,"a\r\nb",c\r\n\r\n2,x,"y"\r\n'.encode())
    (tmp_path / "b.csv").write_bytes(b'id,name,note\n3,"open\n')
    (tmp_path / "c.csv").write_bytes(b"id,name,note")
    (tmp_path / "d.csv").write_bytes(b"")
    got = sorted(map(tuple, S.read_csv(spark, str(tmp_path), SCHEMA).collect()))
    assert [r[0] for r in got] == [1, 2, 3] and got[0][1] == "a\r\nb" and got[0][2] == "c" and got[1][2] == "y"


def test_without_line_ends_nothing_is_put_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text("id,name,note\n1,a,b\n2,\"c,d\",e\n")
    df = S.read_csv(spark, str(tmp_path), SCHEMA, line_ends=False)
    assert sorted(map(tuple, df.collect())) == [(1, "a", "b"), (2, "c,d", "e")]
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_tolerant_reading_in_splits(spark, tmp_path, small_splits):
    rows = [f'{i},"say \\"no\\"\n{i}",{i}' if i % 3 else (f"{i},short" if i % 2 else f"x{i},a,1") for i in range(100)]
    (tmp_path / "a.csv").write_text("\n".join(rows) + "\n")
    good, bad = S.read_csv_tolerant(spark, str(tmp_path), "id string, name string, n long", ["id"], header=False, escape="\\")
    assert sorted(r.id for r in good.collect()) == [i for i in range(100) if i % 3]
    assert {r.name for r in good.where("id = 1").collect()} == {'say "no"\n1'}
    reasons = [r.reason for r in bad.collect()]
    assert (reasons.count("short"), reasons.count("key")) == (17, 17)
