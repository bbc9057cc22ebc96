from __future__ import annotations

import json

import duckdb
import pytest

from casetable.llm.queries import CHECKS, op2
from casetable.llm.tool_calls import link_tool_calls

CALLS = "conv_id long, call_id string, place long, name string, arguments string, depends_on array<string>"
RESULTS = "conv_id long, call_id string, place long, content string"
SCHEMAS = "name string, field string, kind string, required boolean, choices array<string>, least double, most double"
FIELDS = [
    ("add", "a", "integer", True, None, 0.0, 9.0), ("add", "unit", "string", False, ["m", "s"], None, None),
    ("ping", "x", "number", False, None, None, None),
]


def link(spark, calls, results, fields=FIELDS):
    rows = link_tool_calls(
        spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), spark.createDataFrame(fields, SCHEMAS)
    ).collect()
    return sorted(rows, key=repr)


def test_links_rules_and_records(spark):
    calls = [
        (1, "c", 0, "add", '{"unit":"m","a":3}', ["a"]), (1, "a", 1, "add", '{"a":12,"b":1}', None),
        (1, "d", 2, "add", '{"unit":"q"}', ["nobody"]), (2, "x", 0, "add", '{"a":"1"}', ["y"]),
        (2, "y", 1, "ping", '{"x":1}', ["x"]), (3, "r", 0, "ping", "{}", None), (3, "r", 0, "ping", "{}", None),
        (3, "s", 1, "none", "{}", None), (3, "t", 2, "ping", "[1]", None), (3, "u", 3, "ping", None, None),
        (None, "v", 0, "ping", "{}", None), (4, None, 0, "ping", "{}", None),
    ]
    results = [(1, "c", 5, "later"), (1, "c", 4, 'say "é"\n'), (9, "q", 0, None), (3, "r", 1, None)]
    got = link(spark, calls, results)
    by = {}
    for r in got:
        by.setdefault((r.conv_id, r.call_id), []).append(r)
    assert len(got) == len(calls) + 1
    c = by[1, "c"][0]
    assert (c.status, c.depth) == ("answered", 1)
    assert c.record == '{"arguments":{"a":3,"unit":"m"},"call_id":"c","name":"add","result":"say \\"é\\"\\n"}'
    assert by[1, "a"][0].violations == ["range:a", "unknown:b"] and by[1, "a"][0].depth == 0
    assert by[1, "d"][0].violations == ["choice:unit", "required:a"]
    assert by[2, "x"][0].violations == ["type:a"] and by[2, "x"][0].depth is None and by[2, "y"][0].depth is None
    assert sorted(r.status for r in by[3, "r"]) == ["answered", "repeated"]
    assert [by[3, k][0].status for k in "stu"] == ["unknown_tool", "unreadable", "unreadable"]
    assert by[None, "v"][0].status == by[4, None][0].status == "open"
    assert by[9, "q"][0].status == "orphan" and json.loads(by[9, "q"][0].record)["result"] is None


def test_empty_tables(spark):
    assert link(spark, [], [], []) == []


@pytest.mark.parametrize("sf", ["0.001"])
def test_query_agrees_with_sql(spark, sf):
    folder = f"/root/testdata/sf{sf}"
    con = duckdb.connect()
    con.execute(f"create view conversations as from '{folder}/conversations.parquet'")
    want = con.sql(CHECKS["op2_tool_calls"])
    got = op2(spark, folder).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)
