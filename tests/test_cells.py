"""Cell-level semantics, the odd ones first."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from casetable.functions import json_cells as J, limits as L, text as T


def test_strip_removes_all_blanks(one):
    assert one(["\t a b　\n", "\xa0\x85x ", "", None, " \n"], "string", T.strip_text) == ["a b", "x", "", None, ""]


def test_canonical_id(one):
    cells = ["12", "12.0", " 12 ", "x12", None, "", "1.9", "1e3", "nan", "inf", "-4.0", "123456789012345678", "9" * 30, "1d", "12.0.0"]
    assert one(cells, "string", T.canonical_id) == [12, 12, 12, None, None, None, 1, 1000, None, None, -4, 123456789012345678, None, None, None]


def test_loose_int(one):
    cells = ["85", "85.7", "true", "false", None, "high", " 7 ", "-3", "[1]", "1e400"]
    assert one(cells, "string", T.loose_int) == [85, 85, 1, 0, 0, 0, 7, -3, 0, 0]


def test_time_limit_defaults_and_units(one):
    cells = [None, "none", "2 seconds", "1500 ms", "2.5 s", "2 milliseconds", "2 miliseconds", "0 s", "0.00005 s", "0.1 ms"]
    assert one(cells, "string", lambda c: L.parse_time_limit(c, "ms")) == [3000, 3000, 2000, 1500, 2500, 2000, 2, 3000, 3000, 3000]
    assert one(cells[:6], "string", lambda c: L.parse_time_limit(c, "s")) == [3, 3, 2, 1.5, 2.5, 2]
    assert one(["2 milliseconds"], "string", lambda c: L.parse_time_limit(c, "ms", True)) == [2]
    with pytest.raises(ValueError):
        L.parse_time_limit(F.lit("1"), "h")


def test_memory_limit(one):
    cells = [None, "unlimited", "256 megabytes", "64 MB", "1.5 gigabytes", "2048 kb", "268435456", "256", "0 mb"]
    assert one(cells, "string", L.parse_memory_limit) == [256, 256, 256, 64, 1536, 2, 256, 256 / 1048576, 256]


def test_first_rule_wins(one):
    from casetable.vocab import LANGUAGE_RULES

    cells = ["#include <x> print(", "import java.util; def f", "def f(): pass", "puts 1", None]
    assert one(cells, "string", lambda c: T.first_match_label(c, LANGUAGE_RULES)) == ["C++", "Java", "Python", "UNKNOWN", "UNKNOWN"]


def test_line_count_and_preview(one):
    assert one(["", "a", "a\nb\n"], "string", T.line_count) == [1, 1, 3]
    assert one(["a\nb", "x" * 50, "x" * 51], "string", T.preview_text) == ["a b", "x" * 50, "x" * 50 + "..."]


def test_selected_solution(one):
    assert one(["3", " 3", "3.0", "none", None, "4"], "string", lambda c: T.equals_number(F.lit(3), c)) == [True, True, False, False, False, False]


def test_lists_and_pairs(one):
    assert one([["a", "b"], [], None], "array<string>", lambda c: T.join_list(c, empty="NONE")) == ["a | b", "NONE", "NONE"]
    pairs = [[("x", "9"), (None, "1"), ("y", None)], []]
    assert one(pairs, "array<struct<tag:string,score:string>>", T.join_pairs) == ["x:9 | None:1 | y:None", ""]


def test_fill_status_counts_blank_text_as_empty(spark):
    df = spark.createDataFrame([("a", "b"), ("\n", None), ("a", " ")], "a string, b string")
    assert [r[0] for r in df.select(T.fill_status([F.col("a"), F.col("b")])).collect()] == ["all", "none", "partial"]


def test_tri_state(one):
    assert one(["true", " False\n", "ERROR", None, "1"], "string", T.tri_state) == ["TRUE", "FALSE", "ERROR", "ERROR", "ERROR"]
    assert one([True, False, None], "boolean", T.tri_state) == ["TRUE", "FALSE", "ERROR"]


def test_error_class(one):
    cells = ["ClientError: 429", "ServerError: RESOURCE_EXHAUSTED", "Quota hit", "JSON_DECODE_ERROR: 429", "KEY_WAIT_TIMEOUT", "x", None]
    assert one(cells, "string", T.error_class) == ["RATE_LIMIT"] * 3 + ["JSON", "KEY_TIMEOUT", "OTHER", None]


def test_replacements_run_in_order(one):
    assert one(["aab"], "string", lambda c: T.fold_literals(c, [("a", "b"), ("bb", "c")])) == ["cb"]
    words = {"code": "cafe", "cafe": "bar", "a.c": "$1\\"}
    cells = ["code codes éclair", "écode code", "a.c abc a.c", None, "code_1 code-1"]
    assert one(cells, "string", lambda c: T.replace_words(c, words)) == ["bar codes éclair", "écode bar", "$1\\ abc $1\\", None, "code_1 bar-1"]


def test_one_pass_equals_one_word_after_the_other(spark):
    rng = random.Random(3)
    words = {"the": "a cat", "cat": "dog", "dog": "the", "é": "e", "x1": "", "un_der": "und-er", "er": "$1 \\\\", "Über": "über"}
    pieces = list(words) + [" ", "  ", "-", ".", "\n", "cats", "_", "9", "ü", "日本", "'", "THE"]
    cells = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(300)] + ["", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    assert T.closed_words(words) is not None
    slow = F.col("c")
    for old, new in words.items():
        slow = T.let(slow, T._replace_word(old, new))
    got = df.select("i", T.replace_words(F.col("c"), words).alias("got"), slow.alias("want")).collect()
    assert all(r.got == r.want for r in got)
    assert T.closed_words({"the": "a cat", "cat": "dog"}) == {"the": "a dog", "cat": "dog"} and T.closed_words({"a b": "c"}) is None


def test_a_large_dictionary_costs_no_more(spark):
    words = {f"w{i}": f"v{i}" for i in range(3000)}
    df = spark.createDataFrame([("w1 w2999 w3000 x",)], "c string")
    assert df.select(T.replace_words(F.col("c"), words)).first()[0] == "v1 v2999 w3000 x"


def test_variant_kinds(one):
    cells = ['{"a":1}', "[1]", '"5"', "true", "null", "5", "5.0", "5.5", "1e3", None]
    want = ["object", "list", "text", "flag", "null", "whole", "whole", "fraction", "whole", None]
    assert one(cells, "string", lambda c: J.variant_kind(F.try_parse_json(c))) == want


def test_override_of_single_ids(spark):
    from casetable.operators.cleaning import replace_literals

    df = spark.createDataFrame([(1, "ab"), (2, "ab"), (3, None)], "id int, t string")
    out = replace_literals(df, ["t", "absent"], [("a", "x")], {2: [("x", "y")]}).orderBy("id").collect()
    assert [r.t for r in out] == ["xb", "yb", None]


def test_parse_io(one):
    cells = ['{"inputs": ["1", 2, "3"], "outputs": ["a"]}', "{'inputs': ['x'], 'outputs': [None, True]}", "broken{", "[1]", None, "{}"]
    got = one(cells, "string", lambda c: F.to_json(J.parse_io(c), {"ignoreNullFields": "false"}))
    assert got == [
        '{"inputs":["1","2","3"],"outputs":["a"]}', '{"inputs":["x"],"outputs":[null,"true"]}',
        None, None, None, '{"inputs":null,"outputs":null}',
    ]


def test_big_numbers_stay_whole(one):
    big = "9" * 5000
    assert one([f'{{"inputs": [{big}], "outputs": []}}'], "string", lambda c: J.parse_io(c)["inputs"][0]) == [big]


def test_list_literals(one):
    cells = ["['a', 'b']", '["a"]', "[1, 2]", "[None, True]", "[abc]", "a", None, "[1", "{}", "[]"]
    assert one(cells, "string", J.is_list_literal) == [True, True, True, True, False, False, False, False, False, True]


def test_fence(one):
    cells = ["```json\n[1]\n```", "```\n{}\n```", " [1] ", None]
    assert one(cells, "string", J.strip_fence) == ["[1]", "{}", "[1]", None]


def test_truthy(one):
    cells = ["true", "false", "0", "1", "", None, "yes", "False"]
    assert one(cells, "string", J.truthy) == [True, False, False, True, False, False, True, False]


def test_only_whole_cells_are_read(spark, one):
    cells = ['["a", null]', "['a', None]", '["a"] x', '["a"] x]', '["a"', '["a"]}', "[]", None]
    assert one(cells, "string", J.parse_list) == [["a", None], ["a", None], None, None, None, None, [], None]
    assert one(cells, "string", J.is_list_literal) == [True, True, False, False, False, False, True, False]
    pairs = ['{"inputs":["a"],"outputs":["b"]}', '{"inputs":["a"],"outputs":["b"]} junk', '{"inputs":["a"],"outputs":["x", y]}',
             '{"inputs":["a"],"outputs":5}', '{"inputs":["a"]}', '{"inputs":["a"],"outputs":null}', '{"inputs":["a"],"outp']
    got = [None if r is None else (r.inputs, r.outputs) for r in one(pairs, "string", J.parse_io)]
    assert got == [(["a"], ["b"]), None, None, None, (["a"], None), (["a"], None), None]
    flags = one(["[true, false]", "[true, false] hope this helps"], "string", lambda c: J.whole_json(c, "array<string>", {}))
    assert flags == [["true", "false"], None]
