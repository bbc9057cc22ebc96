"""Joins, overlays, shard merge and judging of stored results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable.drills import views as W
from casetable.drills.base import Tables, drill
from casetable.operators import joins as J, judge as G, order as O, profile as P, review as R


@drill("E1_semi_by_id", "select doc_id, lang, n_chars from documents where doc_id in (select doc_id from labels where quality = 1)")
def _(t: Tables) -> DataFrame:
    return J.semi_by_id(t.documents, t.labels.where("quality = 1"), "doc_id").select("doc_id", "lang", "n_chars")


@drill("E2_resume_anti", "select doc_id, source from documents where doc_id not in (select doc_id from labels)")
def _(t: Tables) -> DataFrame:
    return J.pending(t.documents.select("doc_id", "source"), t.labels, ["doc_id"])


@drill("E2_resume_anti_retry", """
select doc_id, source from documents where doc_id not in (select doc_id from labels where quality = 1 and toxic = 0)""")
def _(t: Tables) -> DataFrame:
    status = F.when(F.col("quality") == 0, F.lit(None)).when(F.col("toxic") == 1, "ERROR").otherwise("true")
    done = t.labels.select("doc_id", status.alias("status"))
    return J.pending(t.documents.select("doc_id", "source"), done, ["doc_id"], "status", retry_errors=True)


@drill("E3_enrich_lookup", """
select o_orderkey, o_custkey, c_name, c_mktsegment from orders left join customer on c_custkey = o_custkey""")
def _(t: Tables) -> DataFrame:
    names = t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return J.enrich(t.orders.select("o_orderkey", "o_custkey"), names, ["o_custkey"])


def _overlay_rows(t: Tables) -> DataFrame:
    lang = F.when(F.col("quality") == 1, F.concat(F.lit("q"), F.col("toxic").cast("string")))
    return t.labels.select(
        "doc_id", lang.alias("lang"), F.when(F.col("toxic") == 1, F.lit(-1).cast("bigint")).alias("n_chars"), F.lit(1).alias("unknown")
    ).unionByName(t.labels.agg(F.max("doc_id").alias("doc_id")).select(  # a key the base lacks
        (F.col("doc_id") + 1000000).alias("doc_id"), F.lit("zz").alias("lang"), F.lit(0).cast("bigint").alias("n_chars"), F.lit(1).alias("unknown")))


@drill("E4_overlay_update", """
select d.doc_id, case when quality = 1 then 'q' || toxic else lang end as lang, source,
  case when toxic = 1 then -1 else n_chars end as n_chars from documents d left join labels l on l.doc_id = d.doc_id""")
def _(t: Tables) -> DataFrame:
    return J.overlay(t.documents.select("doc_id", "lang", "source", "n_chars"), _overlay_rows(t), ["doc_id"])


@drill("E5_overlay_replace", """
select d.doc_id, case when l.doc_id is null then lang when quality = 1 then 'q' || toxic end as lang, source,
  case when l.doc_id is null then n_chars when toxic = 1 then -1 end as n_chars from documents d left join labels l on l.doc_id = d.doc_id""")
def _(t: Tables) -> DataFrame:
    last = _overlay_rows(t).withColumn("row_no", F.lit(2))
    older = last.withColumns({"lang": F.lit("old"), "n_chars": F.lit(5).cast("bigint"), "row_no": F.lit(1)})
    base = t.documents.select("doc_id", "lang", "source", "n_chars")
    return J.overlay_replace(base, older.unionByName(last), ["doc_id"], ["lang", "n_chars"], "row_no")


SHARD_COLS = ["title", "body", "example"]


def _shard(t: Tables, rank: int) -> DataFrame:
    """Documents as a shard in which rows are blank, partly blank or broken by rule."""
    k = F.col("doc_id") % 12
    filled = k >= 9 - 3 * rank  # a later shard fills more
    cells = [F.when(filled, F.col("lang")), F.when(filled | ((k == 1) & F.lit(rank < 2)), F.concat(F.lit(f"s{rank} "), F.col("source"))),
             F.when(filled, F.col("n_chars").cast("string")).otherwise(" \n")]
    tags = F.when((F.col("doc_id") % 7 == 0) & F.lit(rank == 0), "['cut").otherwise("['a', 'b']")
    return t.documents.select("doc_id", F.lit(rank).alias("rank"), tags.alias("tags"), *[c.alias(n) for c, n in zip(cells, SHARD_COLS)])


def _merge(t: Tables) -> tuple[DataFrame, DataFrame]:
    shards = O.union_shards([_shard(t, r) for r in range(3)])
    return J.first_filled(shards, "doc_id", SHARD_COLS, ["tags"])


MERGED = """
with d as (select *, doc_id % 12 as k from documents),
o as (select *, case when doc_id % 7 = 0 then 'broken' when k = 1 then 'partial' when k < 3 then 'all_empty' end as reason,
  case when k >= 9 then 0 when k >= 6 then 1 else 2 end as rank from d)"""


@drill("E9_first_filled_rows", f"""{MERGED}
select doc_id, rank::bigint as rank, lang as title, 's' || rank || ' ' || source as body, n_chars::varchar as example from o where reason is null""")
def _(t: Tables) -> DataFrame:
    return _merge(t)[0].withColumn("rank", F.col("rank").cast("bigint")).drop("tags")


@drill("E9_first_filled_rejects", f"{MERGED} select doc_id, reason from o where reason is not null")
def _(t: Tables) -> DataFrame:
    return _merge(t)[1]


@drill("F29_merge_report", f"{MERGED} select coalesce(reason, 'kept') as reason, count(*) as n from o group by 1")
def _(t: Tables) -> DataFrame:
    return P.merge_counts(*_merge(t))


@drill("F29_merge_examples", f"""{MERGED},
p as (select reason, doc_id, row_number() over (partition by reason order by doc_id) as place from o where reason is not null)
select * from p where place <= 10""")
def _(t: Tables) -> DataFrame:
    return P.merge_examples(_merge(t)[1], "doc_id")


@drill("G3_union_shards", """
with d as (select *, doc_id % 12 as k from documents cross join (values (0::bigint), (1), (2)) s(r))
select doc_id, r as rank, case when doc_id % 7 = 0 and r = 0 then '[''cut' else '[''a'', ''b'']' end as tags,
  case when k >= 9 - 3 * r then lang end as title, case when k >= 9 - 3 * r or (k = 1 and r < 2) then 's' || r || ' ' || source end as body,
  case when k >= 9 - 3 * r then n_chars::varchar else ' ' || chr(10) end as example from d""")
def _(t: Tables) -> DataFrame:
    whole = O.union_shards([_shard(t, r) for r in range(3)])
    return whole.withColumn("rank", F.col("rank").cast("bigint"))


# --- judging -----------------------------------------------------------------------------

RESULTS = f"with r as ({W.RESULTS}), cases as (select distinct problem_id, testcase_order from r)"
PASSING = f"""{RESULTS}, total as (select problem_id, count(*) as total from cases group by problem_id),
judged as (select problem_id, solution_order, count(*) as case_count, bool_and(coalesce(validation, false)) as good from r group by 1, 2),
passing as (select j.problem_id, solution_order, case_count from judged j join total t on t.problem_id = j.problem_id
  where good and case_count = total),
firsts as (select problem_id, min(solution_order) as solution_order from passing group by problem_id)"""


def _cases(results: DataFrame) -> DataFrame:
    return results.select("problem_id", "testcase_order").distinct()


def _sols(results: DataFrame) -> DataFrame:
    code = F.concat(F.lit("code of "), F.col("solution_order").cast("string"))
    return results.select("problem_id", "solution_order").distinct().withColumn("solution", code)


@drill("E10_execution_grid", f"""{RESULTS},
s as (select distinct problem_id, solution_order from r where solution_order <= 3)
select s.problem_id, s.solution_order, c.testcase_order, 'code of ' || s.solution_order as solution
from s join cases c on c.problem_id = s.problem_id""")
def _(t: Tables) -> DataFrame:
    r = t.view(W.RESULTS)
    return J.execution_grid(_sols(r), _cases(r), 3)


@drill("F5_all_pass", f"{PASSING} select * from passing")
def _(t: Tables) -> DataFrame:
    r = t.view(W.RESULTS)
    return G.all_pass(r, _cases(r))


@drill("F5_all_pass_incomplete", f"{PASSING} select problem_id, solution_order, case_count from judged where good")
def _(t: Tables) -> DataFrame:
    return G.all_pass(t.view(W.RESULTS), require_complete=False)


@drill("F6_first_passing", f"{PASSING} select problem_id, solution_order, 'code of ' || solution_order as solution from firsts")
def _(t: Tables) -> DataFrame:
    r = t.view(W.RESULTS)
    return G.first_passing(r, _sols(r), _cases(r))


def validated(t: Tables) -> tuple[DataFrame, DataFrame]:
    r = t.view(W.RESULTS)
    cases = _cases(r).withColumn("validation", F.lit(None).cast("boolean"))
    return G.validated(t.view(W.PROBLEMS), cases, G.first_passing(r, _sols(r), cases))


@drill("F7_validated_problems", f"""{PASSING}, p as ({W.PROBLEMS})
select p.*, 'code of ' || solution_order as solution from p join firsts f on f.problem_id = p.id""")
def _(t: Tables) -> DataFrame:
    return validated(t)[0]


@drill("F7_validated_cases", f"""{PASSING}
select c.problem_id, c.testcase_order, f.solution_order as validation from cases c join firsts f on f.problem_id = c.problem_id""")
def _(t: Tables) -> DataFrame:
    return validated(t)[1]


@drill("F8_stop_at_failure", f"""{RESULTS},
w as (select *, coalesce(max(case when validation then 0 else 1 end) over (partition by problem_id, solution_order
  order by testcase_order rows between unbounded preceding and 1 preceding), 0) as failed from r)
select problem_id, solution_order, testcase_order, validation from w where failed = 0""")
def _(t: Tables) -> DataFrame:
    return G.until_first_failure(t.view(W.RESULTS)).select("problem_id", "solution_order", "testcase_order", "validation")


VERDICTS = f"""{RESULTS}, v as (select *, case when timed_out then 'TIMEOUT' when error then 'ERROR'
  when trim(actual_output) = trim(expected_output) then 'MATCH' else 'MISMATCH' end as result from r)"""


@drill("F9_verdicts", f"{VERDICTS} select problem_id, solution_order, testcase_order, result from v")
def _(t: Tables) -> DataFrame:
    return G.verdicts(t.view(W.RESULTS)).select("problem_id", "solution_order", "testcase_order", "result")


@drill("F10_pass_counts", f"""{VERDICTS}
select problem_id, count(*) filter (where result = 'MATCH') as passed, count(*) as total from v group by problem_id""")
def _(t: Tables) -> DataFrame:
    return G.pass_counts(G.verdicts(t.view(W.RESULTS)))


@drill("F11_error_counts", """
select l_orderkey as problem_id, count(*) as total, count(*) filter (where l_quantity <= 45 and l_discount < 0.09) as ok_count,
  count(*) filter (where l_quantity > 45 or l_discount >= 0.09) as error_count from lineitem group by l_orderkey""")
def _(t: Tables) -> DataFrame:
    cases = t.lineitem.select(
        F.col("l_orderkey").alias("problem_id"), F.when(F.col("l_quantity") > 45, "#ERROR").otherwise("in").alias("input"),
        F.when(F.col("l_discount") >= 0.09, "#ERROR").otherwise("out").alias("output"),
    )
    return G.error_counts(cases)


@drill("F11_status_counts", f"""{RESULTS}
select problem_id, solution_order, count(*) filter (where validation) as true_count,
  count(*) filter (where not validation) as false_count, count(*) filter (where validation is null) as error_count
from r group by problem_id, solution_order""")
def _(t: Tables) -> DataFrame:
    return G.status_counts(t.view(W.RESULTS), ["problem_id", "solution_order"], "validation")


@drill("F12_success_rate", f"""
with log as ({W.LOG})
select problem_id, count(*) as sent, count(*) filter (where ok) as answered, count(*) filter (where ok) / count(*) as rate,
  sum(call_elapsed_cs)::bigint / count(*) / 100.0::double as seconds_per_item from log group by problem_id""")
def _(t: Tables) -> DataFrame:
    return G.success_rate(t.view(W.LOG))


@drill("F13_zero_groups", f"with f as ({W.FLAGS}) select problem_id from f group by problem_id having sum(count) = 0")
def _(t: Tables) -> DataFrame:
    return G.zero_groups(t.view(W.FLAGS))


@drill("F13_zero_group_totals", f"""
with f as ({W.FLAGS}), g as (select problem_id, sum(count) as c from f group by problem_id)
select count(*) as groups, count(*) filter (where c = 0) as zero_groups from g""")
def _(t: Tables) -> DataFrame:
    return G.zero_group_totals(t.view(W.FLAGS))


# --- one problem -------------------------------------------------------------------------

PROBLEM = 7
_OWN = f"""
with c as (select l_orderkey as problem_id, l_partkey as testcase_order, min(l_quantity)::bigint as quantity,
    case min(l_returnflag) when 'A' then 'TRUE' when 'N' then 'FALSE' else 'ERROR' end as state
  from lineitem group by l_orderkey, l_partkey), o as (select * from c where problem_id = {PROBLEM})"""


def _review(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    cases = t.lineitem.groupBy(F.col("l_orderkey").alias("problem_id"), F.col("l_partkey").alias("testcase_order")).agg(
        F.min("l_quantity").cast("bigint").alias("quantity"), F.min("l_returnflag").alias("flag")
    )
    told = F.when(F.col("flag") == "A", "True").when(F.col("flag") == "N", " false ").otherwise("?")
    return R.review_split(t.view(W.PROBLEMS), cases.withColumn("range_validation", told).drop("flag"), f"{PROBLEM}.0")


@drill("J1_review_text", f"with p as ({W.PROBLEMS}) select * from p where id = {PROBLEM}")
def _(t: Tables) -> DataFrame:
    return _review(t)[0]


@drill("J1_review_counts", f"{_OWN} select state, count(*) as n from o group by state")
def _(t: Tables) -> DataFrame:
    return _review(t)[1]


@drill("J1_review_cases", f"""{_OWN}, n as (select *, row_number() over (partition by state order by testcase_order) as pos from o)
select testcase_order, quantity, state from n where pos <= 15""")
def _(t: Tables) -> DataFrame:
    return _review(t)[2].drop("range_validation")
