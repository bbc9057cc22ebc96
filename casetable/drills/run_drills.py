"""Two scoring runs compared; the small runs come from events, the large ones from line items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable.drills import views as W
from casetable.drills.base import Tables, drill
from casetable.functions.score_sets import q3_tags
from casetable.operators import compare as C, joins as J, order as O


def _run(t: Tables, n: int) -> DataFrame:
    """One run: the rows of a (key, tag) it scored at all."""
    runs = t.view(W.RUNS_LARGE)
    return runs.where(F.col(f"score{n}") > 0).select("key", "tag", F.col(f"score{n}").alias("score"))


RUN_CHECK = f"""
with runs as ({W.RUNS_LARGE}), r1 as (select key, tag, score1 as score from runs where score1 > 0),
r2 as (select key, tag, score2 as score from runs where score2 > 0)"""
SIDES = f"""{RUN_CHECK}, sides as (select coalesce(a.key, b.key) as key, coalesce(a.tag, b.tag) as tag,
  case when b.key is null then 'only_1' when a.key is null then 'only_2' else 'both' end as side
  from r1 a full join r2 b on a.key = b.key and a.tag = b.tag)"""


@drill("E6_key_coverage", f"{SIDES} select * from sides")
def _(t: Tables) -> DataFrame:
    return J.key_coverage(_run(t, 1), _run(t, 2), ["key", "tag"])


@drill("E6_key_coverage_counts", f"{SIDES} select side, count(*) as n from sides group by side")
def _(t: Tables) -> DataFrame:
    return J.coverage_counts(J.key_coverage(_run(t, 1), _run(t, 2), ["key", "tag"]))


def _rows(t: Tables, n: int) -> DataFrame:
    """One run with a key per row and not per tag: a key comes again with every tag it scored, in tag order."""
    runs = t.view(W.RUNS_LARGE)
    return runs.where(F.col(f"score{n}") > 0).select("key", "tag", F.col(f"score{n}").alias("score"), F.col("place").alias("row_no"))


@drill("E7_pair_runs", f"""{RUN_CHECK}, tags as (select * from {W.TAG_ROWS}),
b1 as (select key, arg_max(score, i) as score, arg_max(tag, i) as tag from r1 join tags using (tag) group by key),
b2 as (select key, arg_max(score, i) as score, arg_max(tag, i) as tag from r2 join tags using (tag) group by key)
select b1.key, b1.tag as tag1, b1.score as score1, b2.tag as tag2, b2.score as score2 from b1 join b2 on b1.key = b2.key""")
def _(t: Tables) -> DataFrame:
    return J.pair_runs(_rows(t, 1), _rows(t, 2), ["key"], "row_no")


@drill("E8_pair_runs_by_tag", f"""{RUN_CHECK}
select r1.key, r1.tag, r1.score as score1, r2.score as score2 from r1 join r2 on r1.key = r2.key and r1.tag = r2.tag""")
def _(t: Tables) -> DataFrame:
    """Every row comes twice, the first time with another score."""

    def twice(run: DataFrame) -> DataFrame:
        older = run.withColumns({"score": F.lit(-1).cast("bigint"), "row_no": F.lit(1)})
        return older.unionByName(run.withColumn("row_no", F.lit(2)))

    return J.pair_runs(twice(_run(t, 1)), twice(_run(t, 2)), ["key", "tag"], "row_no")


@drill("G4_key_intersect", f"{RUN_CHECK} select key, tag from r1 intersect select key, tag from r2")
def _(t: Tables) -> DataFrame:
    return O.key_intersect(_run(t, 1), _run(t, 2), ["key", "tag"])


@drill("G5_key_except", f"{RUN_CHECK} select key, tag from r1 except select key, tag from r2")
def _(t: Tables) -> DataFrame:
    return O.key_except(_run(t, 1), _run(t, 2), ["key", "tag"])


SMALL, LARGE = W.pairs_check("small"), W.pairs_check("large")


@drill("F16_agreement_rate", f"""{LARGE}
select count(*) as pairs, count(*) filter (where primary1 = primary2) as matches,
  count(*) filter (where primary1 = primary2) / count(*) as rate from pairs""")
def _(t: Tables) -> DataFrame:
    return C.agreement_rate(W.pairs(t, "large"))


@drill("F17_change_pairs", f"""{LARGE}
select primary1 as from_tag, primary2 as to_tag, count(*) as n from pairs where primary1 <> primary2
group by 1, 2 order by n desc, min(key) limit 15""")
def _(t: Tables) -> DataFrame:
    return C.change_pairs(W.pairs(t, "large"))


@drill("F18_crosstab", f"""{SMALL}
select l.level, count(*) filter (where confidence2 = 'HIGH') as "HIGH", count(*) filter (where confidence2 = 'MEDIUM') as "MEDIUM",
  count(*) filter (where confidence2 = 'LOW') as "LOW"
from (values ('HIGH'), ('MEDIUM'), ('LOW')) l(level) left join pairs on confidence1 = l.level group by l.level""")
def _(t: Tables) -> DataFrame:
    return C.crosstab(W.pairs(t, "small"))


@drill("F19_marginals", f"""{LARGE}
select 1::bigint as run, confidence1 as level, count(*) as n from pairs group by 2
union all select 2, confidence2, count(*) from pairs group by 2""")
def _(t: Tables) -> DataFrame:
    return C.marginals(W.pairs(t, "large"))


@drill("F20_tag_drift", f"""{LARGE}
select tag, sum(abs(s1 - s2))::bigint / count(*) as mean_diff from grid group by tag, i order by 2 desc, i limit 15""")
def _(t: Tables) -> DataFrame:
    return C.tag_drift(W.pairs(t, "large"), W.TAGS)


@drill("F20_tag_drift_overall", f"{LARGE} select sum(abs(s1 - s2))::bigint / count(*) as mean_diff from grid")
def _(t: Tables) -> DataFrame:
    return C.overall_drift(W.pairs(t, "large"), W.TAGS)


@drill("F21_row_diff", f"""{LARGE},
d as (select key, max(abs(s1 - s2)) as max_tag_diff, arg_max(tag, abs(s1 - s2) * 1000 - i) as max_tag_diff_tag,
  sum(abs(s1 - s2))::bigint / count(*) as avg_tag_diff from grid group by key)
select p.key, primary1, primary2, primary1 = primary2 as primary_match, confidence1, confidence2, max_tag_diff,
  max_tag_diff_tag, avg_tag_diff, coalesce(contains(note1, '{W.MARKER}'), false) as boilerplate1,
  coalesce(contains(note2, '{W.MARKER}'), false) as boilerplate2
from pairs p join d on d.key = p.key""")
def _(t: Tables) -> DataFrame:
    return C.row_diff(W.pairs(t, "large"), W.TAGS, W.MARKER)


@drill("F22_boilerplate_share", f"""{LARGE}
select 1::bigint as run, count(*) filter (where contains(note1, '{W.MARKER}')) as marked, count(*) as total,
  count(*) filter (where contains(note1, '{W.MARKER}')) / count(*) as share from pairs
union all select 2, count(*) filter (where contains(note2, '{W.MARKER}')), count(*),
  count(*) filter (where contains(note2, '{W.MARKER}')) / count(*) from pairs""")
def _(t: Tables) -> DataFrame:
    return C.marker_share(W.pairs(t, "large"), W.MARKER)


def sets_check(size: str) -> str:
    return f"""{W.pairs_check(size)},
cut as (select key, quantile_cont(s1::double, 0.75) filter (where s1 > 0) as q1,
  quantile_cont(s2::double, 0.75) filter (where s2 > 0) as q2 from grid group by key),
picked as (select g.key, g.tag, coalesce(s1 > 0 and s1 >= q1, false) as in1, coalesce(s2 > 0 and s2 >= q2, false) as in2
  from grid g join cut c on c.key = g.key),
sizes as (select key, count(*) filter (where in1) as n1, count(*) filter (where in2) as n2,
  count(*) filter (where in1 and in2) as nb, string_agg(tag, ',' order by tag) filter (where in1) as t1,
  string_agg(tag, ',' order by tag) filter (where in2) as t2 from picked group by key),
scored as (select s.*, p.primary1, p.primary2, case when n1 = 0 and n2 = 0 then 1.0::double when least(n1, n2) = 0 then 0.0::double
  else greatest(0.0::double, nb / least(n1, n2) - 0.1::double * (greatest(n1, n2) - nb)) end as set_score
  from sizes s join pairs p on p.key = s.key)"""


def _scored(t: Tables, size: str = "large") -> DataFrame:
    return C.with_q3_sets(W.pairs(t, size), W.TAGS)


for _size in ("small", "large"):

    @drill(f"F23_q3_tags_{_size}", f"{sets_check(_size)} select key, coalesce(t1, '') as tags1, coalesce(t2, '') as tags2 from scored")
    def _(t: Tables, size: str = _size) -> DataFrame:
        picked = W.pairs(t, size)
        return picked.select(
            "key", *[F.array_join(F.array_sort(q3_tags(F.col(f"scores{r}"), W.TAGS)), ",").alias(f"tags{r}") for r in (1, 2)]
        )

    @drill(f"F24_set_score_{_size}", f"{sets_check(_size)} select key, set_score from scored")
    def _(t: Tables, size: str = _size) -> DataFrame:
        return _scored(t, size).select("key", "set_score")


COUNTS = """count(*) filter (where set_score >= 0.999) as full_match,
  count(*) filter (where set_score < 0.999 and set_score > 0.001) as partial_match,
  count(*) filter (where set_score <= 0.001) as no_match"""
MEAN = "sum(set_score::decimal(18,12))::double / count(*)"


@drill("F25_set_summary", f"""{sets_check('large')}
select count(*) as pairs, {MEAN} as mean_score, {COUNTS}, sum(n1)::bigint / count(*) as mean_size1,
  sum(n2)::bigint / count(*) as mean_size2 from scored""")
def _(t: Tables) -> DataFrame:
    return C.set_summary(_scored(t))


@drill("F26_lowest_pairs", f"""{sets_check('large')}
select key, set_score, coalesce(t1, '') as tags1, coalesce(t2, '') as tags2 from scored where set_score < 1
order by set_score, key limit 7""")
def _(t: Tables) -> DataFrame:
    return C.lowest_pairs(_scored(t))


@drill("F27_metric_table", f"""{sets_check('large')},
one as (select count(*) as n, count(*) filter (where primary1 = primary2) as p, {COUNTS}, {MEAN} as mean from scored)
select 'full match, count' as metric, p::double as primary_only, full_match::double as q3_set from one
union all select 'full match, share', p / n, full_match / n from one
union all select 'partial match, count', null, partial_match from one
union all select 'partial match, share', null, partial_match / n from one
union all select 'no match, count', n - p, no_match from one
union all select 'no match, share', (n - p) / n, no_match / n from one
union all select 'mean score', p / n, mean from one""")
def _(t: Tables) -> DataFrame:
    return C.metric_table(_scored(t))


DECISION = (
    "case when {s} >= 80 then 'LIKELY_SPECIFIC_ALGORITHM' when {s} >= 40 then 'REVIEW_NEEDED' else 'KEEP_ORIGINAL' end"
)


def _rechecks(t: Tables, n: int) -> DataFrame:
    score = F.col("score")
    decision = F.when(score >= 80, "LIKELY_SPECIFIC_ALGORITHM").when(score >= 40, "REVIEW_NEEDED").otherwise("KEEP_ORIGINAL")
    return _run(t, n).select(
        "key", F.col("tag").alias("source_broad_tag"), decision.alias("recheck_decision"),
        F.concat(F.lit("c"), (score / 40).cast("int").cast("string")).alias("recheck_best_candidate"),
    )


SHIFT = f"""{RUN_CHECK}, p as (select r1.tag, {DECISION.format(s='r1.score')} as d1, {DECISION.format(s='r2.score')} as d2,
  r1.score // 40 = r2.score // 40 as same from r1 join r2 on r1.key = r2.key and r1.tag = r2.tag)"""


@drill("F28_decision_shift", f"""{SHIFT}
select count(*) as pairs, count(*) filter (where same) as same_candidate, count(*) filter (where same) / count(*) as candidate_rate,
  count(*) filter (where d1 = 'KEEP_ORIGINAL' and d2 <> 'KEEP_ORIGINAL') as escalated,
  count(*) filter (where d1 <> 'KEEP_ORIGINAL' and d2 = 'KEEP_ORIGINAL') as relaxed from p""")
def _(t: Tables) -> DataFrame:
    return C.decision_shift(J.pair_runs(_rechecks(t, 1), _rechecks(t, 2), ["key", "source_broad_tag"]))


@drill("F28_decision_crosstab", f"""{SHIFT}
select l.level, count(*) filter (where d2 = 'KEEP_ORIGINAL') as "KEEP_ORIGINAL",
  count(*) filter (where d2 = 'REVIEW_NEEDED') as "REVIEW_NEEDED",
  count(*) filter (where d2 = 'LIKELY_SPECIFIC_ALGORITHM') as "LIKELY_SPECIFIC_ALGORITHM"
from (values ('KEEP_ORIGINAL'), ('REVIEW_NEEDED'), ('LIKELY_SPECIFIC_ALGORITHM')) l(level) left join p on d1 = l.level group by l.level""")
def _(t: Tables) -> DataFrame:
    paired = J.pair_runs(_rechecks(t, 1), _rechecks(t, 2), ["key", "source_broad_tag"])
    levels = ["KEEP_ORIGINAL", "REVIEW_NEEDED", "LIKELY_SPECIFIC_ALGORITHM"]
    return C.crosstab(paired, "recheck_decision1", "recheck_decision2", levels)


@drill("F28_broad_tag_counts", f"{SHIFT} select tag as source_broad_tag, count(*) as n from p group by tag")
def _(t: Tables) -> DataFrame:
    return C.broad_tag_counts(J.pair_runs(_rechecks(t, 1), _rechecks(t, 2), ["key", "source_broad_tag"]))
