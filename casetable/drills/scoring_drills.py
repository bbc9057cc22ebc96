"""Replies to rows: parsing, alignment, score rows, recheck rows, contract."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable.drills import views as W
from casetable.drills.base import Tables, drill
from casetable.operators import joins as J, nested as N, scoring as S

TAGS = W.TAGS


def items(t: Tables) -> DataFrame:
    return S.parse_items(W.replies(t), W.BROAD)


def matched(t: Tables) -> DataFrame:
    return J.align_reply(W.requests(t), items(t))[0]


def _pivot(value: str) -> str:
    return ", ".join(f"max(case when g.tag = '{tag}' then g.{value} end) as \"{tag}\"" for tag in TAGS)


@drill("D10_score_vector", f"""{W.REPLY_CHECK}
select g.key, t.tag, t.s as score from good g join grid t on t.key = g.key""")
def _(t: Tables) -> DataFrame:
    df = N.with_score_map(N.with_scores(matched(t), "algorithm_scores", TAGS), "scores", TAGS)
    key = F.col("chunk_id") * 2 + F.col("solution_index")
    return df.select(key.alias("key"), F.explode("score_map").alias("tag", "score"))


@drill("D11_score_pivot", f"""{W.REPLY_CHECK}
select u.key, {_pivot('s')} from good u join grid g on g.key = u.key group by u.key""")
def _(t: Tables) -> DataFrame:
    key = (F.col("chunk_id") * 2 + F.col("solution_index")).alias("key")
    return N.score_pivot(N.with_scores(matched(t), "algorithm_scores", TAGS).select(key, "scores"), TAGS)


@drill("D12_strip_fence_parse", f"""
with d as (select doc_id // 10 as b, count(*) as n from documents group by 1)
select b as batch_id, {W.BATCH_REASON} as reason, case when {W.BATCH_REASON} is null then n end as n_values from d""")
def _(t: Tables) -> DataFrame:
    parsed = N.parse_reply(W.batches(t)[1], "reply", "array<string>", "n_items")
    n = F.when(F.col("parsed").isNotNull(), F.size("parsed")).cast("bigint")
    return parsed.select("batch_id", "reason", n.alias("n_values"))


@drill("E11_align_reply_rows", f"""{W.REPLY_CHECK}
select chunk_id, solution_index, 'about ' || key as solution_summary from good""")
def _(t: Tables) -> DataFrame:
    return matched(t).select("chunk_id", "solution_index", "solution_summary")


@drill("E11_align_reply_status", f"""{W.REPLY_CHECK}
select u.chunk_id, count(*) as asked, count(g.key) as parsed, count(*) = count(g.key) as ok
from users u left join good g on g.key = u.key group by u.chunk_id""")
def _(t: Tables) -> DataFrame:
    return J.align_reply(W.requests(t), items(t))[1]


@drill("E12_scatter_vector", f"""
with d as (select doc_id // 10 as b, doc_id, n_chars from documents)
select doc_id, case when {W.BATCH_REASON} is not null then 'ERROR'
  when doc_id % 9 <> 0 and n_chars > 500 then 'true' else 'false' end as range_validation from d""")
def _(t: Tables) -> DataFrame:
    return J.scatter_vector(*W.batches(t)).select("doc_id", "range_validation")


BROAD_ROWS = " union all ".join(
    f"select '{tag}' as broad, '{c}' as candidate, {i} as place"
    for tag, cs in W.BROAD.items() for i, c in enumerate(cs)
)
CANDIDATES = sorted({c for cs in W.BROAD.values() for c in cs})
_GIVEN = ", ".join(
    f"max(case when c.candidate = '{c}' and g.key % 13 <> 1 then case when m.key is not null then m.score2::varchar"
    + (" when g.key % 59 = 10 then '120' when g.key % 61 = 11 then '7.5'" if c == "GRAPH" else "")
    + f" when g.key % 6 = 0 then '0' end end) as \"{c}\""
    for c in CANDIDATES
)
RECHECK_CHECK = f"""{W.REPLY_CHECK}, cands as ({BROAD_ROWS}),
cand as (select u.key, c.broad, c.candidate, c.place, case when u.key % 13 = 1 then 0 when c.candidate <> 'GRAPH' then g.s2
    when u.key % 59 = 10 then 120 when u.key % 61 = 11 then 7 else 0 end as v
  from users u cross join cands c left join grid g on g.key = u.key and g.tag = c.candidate)
select g.chunk_id || '_solution_' || g.solution_index as problem_solution_key, g.chunk_id as id,
  'problem ' || g.chunk_id as title, 'solution_' || g.solution_index as solution_column, g.solution_index,
  b.tag as source_broad_tag, b.s as source_broad_score, {_GIVEN},
  arg_max(c.candidate, c.v * 100 - c.place) as recheck_best_candidate, max(c.v) as recheck_best_score,
  case when g.key % 13 = 1 then 'KEEP_ORIGINAL' when g.key % 41 = 0 then 'MAYBE'
    when b.raw >= 80 then 'LIKELY_SPECIFIC_ALGORITHM' when b.raw >= 60 then 'REVIEW_NEEDED' else 'KEEP_ORIGINAL' end as recheck_decision,
  case when g.key % 13 <> 1 and g.key % 3 <> 0 then 'because' else '' end as recheck_reason
from good g join grid b on b.key = g.key join tops on tops.key = g.key
join cand c on c.key = g.key and c.broad = b.tag left join m on m.key = g.key and m.tag = c.candidate
where b.s >= 60 or (tops.top = b.tag and g.key % 8 <> 5)
group by g.key, g.chunk_id, g.solution_index, b.tag, b.s, b.raw"""


@drill("F14_recheck_rows", RECHECK_CHECK)
def _(t: Tables) -> DataFrame:
    return S.recheck_rows(matched(t), TAGS, W.BROAD)


SCORE_CHECK = f"""{W.REPLY_CHECK},
thirds as (select key, string_agg(case when key % 53 = 9 and rk = 1 then 'BOGUS' else tag end || ':' || case when key % 37 = 0 then 'None' else score1::varchar end, ' | ' order by rk) as t3
  from m where rk <= case when key % 31 = 0 then 2 else 3 end group by key),
p as (select u.*, tops.top, tops.top_score, second, split_part(coalesce(second, ''), ' | ', 1) as s1, t3
  from good u join tops on tops.key = u.key left join seconds on seconds.key = u.key join thirds on thirds.key = u.key)
select p.chunk_id || '_solution_' || p.solution_index as problem_solution_key, p.chunk_id as id,
  'problem ' || p.chunk_id as title,
  case when p.chunk_id % 5 = 0 then 'none' else (p.chunk_id % 3)::varchar end as selected_submission_index,
  'solution_' || p.solution_index as solution_column, p.solution_index,
  p.chunk_id % 5 <> 0 and p.chunk_id % 3 = p.solution_index as is_selected_solution, true as solution_valid,
  case p.key % 3 when 0 then 'Python' when 1 then 'C++' else 'UNKNOWN' end as solution_language,
  case p.key % 3 when 0 then 2 when 1 then 3 else 1 end::bigint as solution_length,
  'about ' || p.key as solution_summary, {_pivot('s')},
  case when p.key % 8 = 5 then 'UNKNOWN' else p.top end as primary_algorithm,
  case when p.key % 8 = 5 then 0 else max(case when g.tag = p.top then g.s end) end as primary_score,
  coalesce(p.second, '') as secondary_algorithms, p.second is not null as is_composite,
  case when p.second is null then 'NONE' else p.top || ' | ' || p.s1 || case when p.key % 29 = 0 then ' | extra' else '' end end
    as composite_algorithm,
  p.t3 as top_3_algorithms, case when p.key % 5 = 1 then '' else 'line 1' end as code_evidence,
  'told' as time_complexity_reasoning, 'told' as classification_reason, 'told' as rejected_candidates,
  case when p.key % 23 = 0 then 'SURE' when p.key % 7 = 2 then 'LOW' else {W.level_sql('p.top_score')} end as confidence,
  'told' as uncertain_points, 'told' as compared_with_other_solutions
from p join grid g on g.key = p.key
group by p.key, p.chunk_id, p.solution_index, p.top, p.top_score, p.second, p.s1, p.t3"""


@drill("F15_score_rows", SCORE_CHECK)
def _(t: Tables) -> DataFrame:
    return N.score_pivot(S.score_rows(matched(t), TAGS), TAGS)


@drill("F32_contract_check", f"""{W.REPLY_CHECK},
tops3 as (select key, count(*) as n from m where rk <= 3 group by key),
i as (select s.key, s.copies, seconds.second is not null as two, tops3.n as n3 from sent s
  left join seconds on seconds.key = s.key left join tops3 on tops3.key = s.key),
r as (select key, copies, unnest([
  struct_pack(rule := 'field_missing', broken := key % 8 = 5 or (key % 7 = 2 and key % 23 <> 0) or key % 5 = 1 or key % 13 = 1),
  struct_pack(rule := 'field_type', broken := key % 11 = 3 or key % 19 = 5 or key % 10 = 1),
  struct_pack(rule := 'score_missing', broken := key % 4 <> 0),
  struct_pack(rule := 'score_type', broken := key % 5 = 0 or key % 7 = 0),
  struct_pack(rule := 'score_whole', broken := key % 47 = 8),
  struct_pack(rule := 'score_range', broken := key % 43 = 6),
  struct_pack(rule := 'tag_vocabulary', broken := two and key % 29 = 0),
  struct_pack(rule := 'top_three_size', broken := least(n3, case when key % 31 = 0 then 2 else 3 end) <> 3),
  struct_pack(rule := 'top_three_tag', broken := key % 53 = 9),
  struct_pack(rule := 'top_three_score', broken := key % 37 = 0),
  struct_pack(rule := 'confidence_list', broken := key % 23 = 0),
  struct_pack(rule := 'combination_size', broken := two and key % 29 = 0),
  struct_pack(rule := 'decision_list', broken := key % 13 <> 1 and key % 41 = 0),
  struct_pack(rule := 'candidate_missing', broken := key % 13 <> 1 and key % 6 <> 0),
  struct_pack(rule := 'candidate_type', broken := false),
  struct_pack(rule := 'candidate_whole', broken := key % 13 <> 1 and key % 59 <> 10 and key % 61 = 11),
  struct_pack(rule := 'candidate_range', broken := key % 13 <> 1 and key % 59 = 10),
  struct_pack(rule := 'reason_missing', broken := key % 13 <> 1 and key % 3 = 0)], recursive := true) from i)
select rule, coalesce(sum(copies) filter (where broken), 0)::bigint as violations from r group by rule
union all select 'unreadable', count(distinct chunk_id) from users where chunk_id % 13 = 0
union all select 'reply_length', count(*) from (select u.chunk_id from users u left join good g on g.key = u.key
  group by u.chunk_id having count(*) <> count(g.key))""")
def _(t: Tables) -> DataFrame:
    return S.contract_check(W.replies(t), J.align_reply(W.requests(t), items(t))[1], TAGS, W.BROAD)
