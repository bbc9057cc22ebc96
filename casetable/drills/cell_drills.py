"""Scalar steps over whole texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable.drills import views as W
from casetable.drills.base import Tables, drill
from casetable.functions import text as T
from casetable.functions.limits import parse_time_limit
from casetable.operators import cleaning as E
from casetable.vocab import LANGUAGE_RULES

# the first rules are those for code; prose gets its own below them
DOC_RULES = [*LANGUAGE_RULES, ("German", [" der ", " und "]), ("English", [" the ", " and "]), ("French", [" le ", " et "])]


def _cases_sql(col: str, rules) -> str:
    whens = " ".join(
        f"when {' or '.join(f"contains({col}, '{w}')" for w in words)} then '{label}'" for label, words in rules
    )
    return f"case {whens} else 'UNKNOWN' end"


@drill("E0a_detect_language", f"select doc_id, {_cases_sql('text', DOC_RULES)} as language from documents")
def _(t: Tables) -> DataFrame:
    return E.with_language(t.documents, "text", DOC_RULES).select("doc_id", "language")


@drill("E0a_detect_language_pages", f"select page_id, {_cases_sql('html', LANGUAGE_RULES)} as language from pages")
def _(t: Tables) -> DataFrame:
    return E.with_language(t.pages, "html").select("page_id", "language")


@drill("E0b_line_count", "select doc_id, len(string_split(text, chr(10))) as lines from documents")
def _(t: Tables) -> DataFrame:
    return E.with_line_count(t.documents, "text").select("doc_id", "lines")


_LINE = "l_orderkey, l_partkey, l_suppkey, cast(l_linenumber as bigint) as l_linenumber"


@drill("E0c_is_selected", f"""
select {_LINE}, l_partkey % 3 <> 0 and l_linenumber = l_suppkey % 7 + 1 as is_selected from lineitem""")
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("l_partkey") % 3 == 0, "none").otherwise((F.col("l_suppkey") % 7 + 1).cast("string"))
    line = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", F.col("l_linenumber").cast("bigint").alias("l_linenumber"), text.alias("picked"))
    return E.with_selected(line, "l_linenumber", "picked").drop("picked")


@drill("E0d_compose_key", "select l_orderkey || '_solution_' || l_linenumber as problem_solution_key, l_partkey from lineitem")
def _(t: Tables) -> DataFrame:
    return E.with_solution_key(t.lineitem, "l_orderkey", "l_linenumber").select("problem_solution_key", "l_partkey")


@drill("E0e_join_list", """
select p_partkey, case when p_size % 4 = 0 then 'NONE' else p_brand || ' | ' || p_type end as joined,
  p_brand || ':' || case when p_size % 5 = 0 then 'None' else p_size::varchar end || ' | ' || p_type || ':0' as pairs from part""")
def _(t: Tables) -> DataFrame:
    listed = F.when(F.col("p_size") % 4 != 0, F.array("p_brand", "p_type")).otherwise(F.array().cast("array<string>"))
    scored = F.array(
        F.struct(F.col("p_brand").alias("tag"), F.when(F.col("p_size") % 5 != 0, F.col("p_size")).alias("score")),
        F.struct(F.col("p_type").alias("tag"), F.lit(0).alias("score")),
    )
    df = E.with_joined(t.part.withColumn("listed", listed), "listed", "joined")
    return df.select("p_partkey", "joined", T.join_pairs(scored).alias("pairs"))


def _limit_sql(kind: str, strict: bool = False) -> str:
    num = "regexp_extract(lower(x), '([0-9]+(?:[.][0-9]+)?)', 1)::varchar"
    n = f"try_cast(nullif({num}, '') as double)"
    if kind == "ms":
        marks = "contains(lower(x), 'mili') or contains(lower(x), 'ms')" + (" or contains(lower(x), 'milli')" if strict else "")
        v, floor, default = f"case when {marks} then {n} else {n} * 1000 end", "0.1::double", "3000::double"
    elif kind == "s":
        v = f"case when contains(lower(x), 'mili') or contains(lower(x), 'ms') then {n} / 1000 else {n} end"
        floor, default = "0.0001::double", "3::double"
    else:
        v = f"""case when contains(lower(x), 'giga') or contains(lower(x), 'gb') then {n} * 1024
          when contains(lower(x), 'kilo') or contains(lower(x), 'kb') then {n} / 1024
          when contains(lower(x), 'mega') or contains(lower(x), 'mb') then {n} else {n} / 1048576 end"""
        floor, default = "0.0001::double", "256::double"
    return f"case when ({v}) > {floor} then {v} else {default} end"


LIMITS = f"with v as ({W.LIMITS}), x as (select id, time_limit as x from v), y as (select id, memory_limit as x from v)"


@drill("E0f_parse_time_limit", f"""{LIMITS}
select id, {_limit_sql('ms')} as ms, {_limit_sql('s')} as s, {_limit_sql('ms', True)} as strict_ms from x""")
def _(t: Tables) -> DataFrame:
    limit = F.col("time_limit")
    return t.view(W.LIMITS).select(
        "id", parse_time_limit(limit, "ms").alias("ms"), parse_time_limit(limit, "s").alias("s"),
        parse_time_limit(limit, "ms", strict_units=True).alias("strict_ms"),
    )


@drill("E0g_parse_memory_limit", f"{LIMITS} select id, {_limit_sql('mb')} as mb from y")
def _(t: Tables) -> DataFrame:
    return E.with_limits(t.view(W.LIMITS)).select("id", F.col("`memory_limit_parsed(mb)`").alias("mb"))


@drill("E0h_is_hidden", "select conv_id, turn, turn not in (1, 2) as is_hidden from conversations")
def _(t: Tables) -> DataFrame:
    return E.with_hidden(t.conversations.select("conv_id", "turn"), "turn")


@drill("E0i_fill_status", """
select doc_id, case when doc_id % 6 = 0 then 'none' when doc_id % 6 in (1, 2) then 'partial' else 'all' end as fill from documents""")
def _(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 6
    df = t.documents.select(
        "doc_id", F.when(k != 0, F.col("text")).otherwise("\t\n ").alias("a"),
        F.when(k > 1, F.col("lang")).alias("b"), F.when(k > 2, F.col("source")).otherwise("").alias("c"),
    )
    return E.with_fill_status(df, ["a", "b", "c"]).select("doc_id", "fill")


@drill("E0j_tri_state", """
select event_id, case event_id % 5 when 0 then 'TRUE' when 1 then 'FALSE' when 2 then 'TRUE' else 'ERROR' end as state from events""")
def _(t: Tables) -> DataFrame:
    k = F.col("event_id") % 5
    mixed = F.when(k == 0, (F.col("event_id") >= 0).cast("string")).when(k == 1, " False\n").when(k == 2, "tRuE").when(k == 3, F.col("event_type"))
    return E.with_tri_state(t.events.select("event_id", mixed.alias("told")), "told").drop("told")


@drill("E0k_keyword_filter", "select doc_id, n_chars from documents where contains(lower(text), 'ment')")
def _(t: Tables) -> DataFrame:
    return E.keyword_filter(t.documents, "text", "ment").select("doc_id", "n_chars")


LITERALS = [("The ", "A "), ("ment", "MENT"), ("MENTa", "enta"), ("\n", " / "), ("lang", "tongue")]
OVERRIDES = {4: [("A ", "One ")], 7: [("MENT", "ment"), ("e", "3")]}


def _fold_sql(col: str, pairs) -> str:
    for old, new in pairs:
        col = f"replace({col}, '{old}', '{new}')" if old != "\n" else f"replace({col}, chr(10), '{new}')"
    return col


def _override_sql(col: str) -> str:
    base = _fold_sql(col, LITERALS)
    whens = " ".join(f"when {k} then {_fold_sql(base, v)}" for k, v in OVERRIDES.items())
    return f"case doc_id {whens} else {base} end"


@drill("E0l_replace_literals", f"select doc_id, {_override_sql('text')} as text, {_override_sql('source')} as source from documents")
def _(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id", "text", "source")
    return E.replace_literals(df, ["text", "source", "absent"], LITERALS, OVERRIDES, "doc_id")


WORDS = {"the": "THE", "and": "und", "und": "AND", "le": "LE", "que": "$1\\"}


def _words_sql(col: str) -> str:
    # the pattern takes the letter after the word along: twice, so that neighbours are both found
    for old, new in WORDS.items():
        safe = new.replace("\\", "\\\\")
        once = rf"'(^|[^\pL\pM\pN_]){old}($|[^\pL\pM\pN_])', '\1{safe}\2', 'g'"
        col = f"regexp_replace(regexp_replace({col}, {once}), {once})"
    return col


@drill("E0m_replace_words", f"select doc_id, {_words_sql('text')} as text from documents")
def _(t: Tables) -> DataFrame:
    return E.replace_words(t.documents.select("doc_id", "text"), ["text"], WORDS)


@drill("E0n_preview_text", """
select doc_id, case when length(text) > 50 then left(replace(text, chr(10), ' '), 50) || '...' else replace(text, chr(10), ' ') end as preview
from documents""")
def _(t: Tables) -> DataFrame:
    return E.with_preview(t.documents, "text").select("doc_id", "preview")


@drill("E0o_error_class", f"""
with log as ({W.LOG})
select seq, case when error is null then null when contains(error, '429') then 'RATE_LIMIT' when contains(error, 'JSON') then 'JSON'
  when contains(error, 'KEY_WAIT') then 'KEY_TIMEOUT' else 'OTHER' end as error_class from log""")
def _(t: Tables) -> DataFrame:
    return E.with_error_class(t.view(W.LOG)).select("seq", "error_class")


@drill("E0p_clean_null_text", """
select doc_id, case when doc_id % 5 = 0 then '' else source end as source, n_chars::varchar as n_chars from documents""")
def _(t: Tables) -> DataFrame:
    df = t.documents.select("doc_id", F.when(F.col("doc_id") % 5 != 0, F.col("source")).alias("source"), "n_chars")
    return E.blank_nulls(df, ["source", "n_chars"])
