"""The end-to-end plans: one query for each table they write."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable.drills import run_drills as R, scoring_drills as S, views as W
from casetable.drills.base import CHECKS, Tables, check, drill
from casetable.operators.nested import score_pivot
from casetable.plans import comparison, scoring

# --- from problems to requests, and from replies to tables -----------------------------------


def _problems(t: Tables) -> DataFrame:
    """Problems with their solutions in numbered columns."""
    asked = W.requests(t)
    return asked.groupBy("id", "title", "selected_submission_index").agg(
        *[F.max(F.when(F.col("solution_index") == i, F.col("code"))).alias(f"solution_{i}") for i in (0, 1)]
    )


@drill("plan_requests", """
with u as (select distinct user_id as key from events), todo as (select key // 2 as id, key % 2 as n,
    case key % 3 when 0 then 'import sys' || chr(10) || 'print(1)' when 1 then '#include <x>' || chr(10) || 'int main()' else 'x' end as code
  from u where key % 4 <> 0)
select id || ':0' as chunk_id, count(*) as item_count,
  'problem ' || id || chr(10) || string_agg(n || ': ' || code, chr(10) order by n) || chr(10) || 'as JSON' as request from todo group by id""")
def _(t: Tables) -> DataFrame:
    """Every fourth solution is scored already."""
    done = t.events.where("user_id % 4 = 0").select(
        F.concat(F.floor(F.col("user_id") / 2).cast("string"), F.lit("_solution_"), (F.col("user_id") % 2).cast("string")).alias("problem_solution_key")
    ).distinct()
    item = F.concat(F.col("solution_index").cast("string"), F.lit(": "), F.col("code"))
    return scoring.plan_requests(_problems(t), done, 2, F.col("title"), item, F.lit("as JSON"))[1]


def _read(t: Tables) -> dict[str, DataFrame]:
    out = scoring.read_replies(W.requests(t), W.replies(t), W.TAGS, W.BROAD)
    out["rows"].unpersist()  # one table is read here
    return out


@drill("plan_scores", S.SCORE_CHECK)
def _(t: Tables) -> DataFrame:
    return score_pivot(_read(t)["scores"], W.TAGS)


@drill("plan_recheck", S.RECHECK_CHECK)
def _(t: Tables) -> DataFrame:
    return _read(t)["recheck"]


@drill("plan_status", CHECKS["E11_align_reply_status"])
def _(t: Tables) -> DataFrame:
    return _read(t)["status"]


# --- two runs compared -----------------------------------------------------------------------


def _run(t: Tables, n: int) -> DataFrame:
    """A run of the large pairs; each run lacks some keys of the other."""
    return W.pairs(t, "large").where(F.col("key") % 50 != n).select(
        F.col("key").alias("problem_solution_key"), F.col(f"primary{n}").alias("primary_algorithm"), F.col(f"confidence{n}").alias("confidence"),
        F.col(f"scores{n}").alias("scores"), F.col(f"note{n}").alias("compared_with_other_solutions"),
    )


def _compared(t: Tables, name: str) -> DataFrame:
    rechecks = [R._rechecks(t, n).withColumnRenamed("key", "problem_solution_key") for n in (1, 2)]
    tables, pairs = comparison.compare_runs(_run(t, 1), _run(t, 2), *rechecks, W.TAGS, W.MARKER)
    pairs.unpersist()  # one table is read here
    return tables[name]


_ALL, _BOTH = check(W.RUNS_LARGE), check(f"select * from ({W.RUNS_LARGE}) where key % 50 not in (1, 2)")
_LARGE, _SMALL = check(W.pairs_check("large")), check(W.pairs_check("small"))


def _same_as(key: str) -> str:
    """The check of a single step, over the keys that both runs have."""
    return CHECKS[key].replace(_SMALL, _LARGE).replace(f"with runs as ({_ALL})", f"with runs as ({_BOTH})")


for _name, _check in {
    "coverage": f"""{_LARGE}
        select case key % 50 when 1 then 'only_2' when 2 then 'only_1' else 'both' end as side, count(*) as n from pairs group by 1""",
    "agreement": _same_as("F16_agreement_rate"),
    "changes": _same_as("F17_change_pairs"),
    "confidence": _same_as("F18_crosstab"),
    "confidence_totals": _same_as("F19_marginals"),
    "drift": _same_as("F20_tag_drift"),
    "drift_overall": _same_as("F20_tag_drift_overall"),
    "boilerplate": _same_as("F22_boilerplate_share"),
    "rows": _same_as("F21_row_diff"),
    "sets": _same_as("F25_set_summary"),
    "lowest": _same_as("F26_lowest_pairs"),
    "recheck_coverage": CHECKS["E6_key_coverage_counts"],
    "recheck_shift": CHECKS["F28_decision_shift"],
    "recheck_decisions": CHECKS["F28_decision_crosstab"],
    "recheck_tags": CHECKS["F28_broad_tag_counts"],
    "metrics": _same_as("F27_metric_table"),
}.items():

    @drill(f"plan_compare_{_name}", _check)
    def _(t: Tables, name: str = _name) -> DataFrame:
        return _compared(t, name)
