"""Views that give the test tables the shape of a corpus, result grid, log and score runs.

The texts run unchanged in Spark and, for the checks, in the other engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable import vocab as V
from casetable.drills.base import Tables
from casetable.functions.score_sets import first_highest
from casetable.operators.scoring import recheck_field

PROBLEMS = "select o_orderkey as id, o_orderpriority as question, o_orderstatus as difficulty from {orders}"

# one result per (order, supplier class, line number): grouped, so that copies of a line and
# orders with very many lines are summed up before the shuffle
RESULTS = """
select problem_id, solution_order, testcase_order, has_r and has_o as error, timed_out,
  case when has_o then 'O' else 'F' end as expected_output,
  concat(' ', case when has_r then 'X' when has_o then 'O' else 'F' end, ' ') as actual_output,
  case when has_r then false when has_small then null else true end as validation
from (select l_orderkey as problem_id, cast(l_suppkey % 3 as bigint) + 1 as solution_order,
  cast(l_linenumber as bigint) as testcase_order, bool_or(l_returnflag = 'R') as has_r,
  bool_or(l_linestatus = 'O') as has_o, bool_or(l_quantity > 48) as timed_out, bool_or(l_quantity <= 2) as has_small
  from {lineitem} group by l_orderkey, l_suppkey % 3, l_linenumber) g"""

FLAG_NAMES = ["tag_a", "tag_r", "tag_o", "tag_big"]

FLAGS = """
select problem_id, solution_order, shard, tag_a, tag_r, tag_o, tag_big,
  cast(cast(tag_a as int) + cast(tag_r as int) + cast(tag_o as int) + cast(tag_big as int) as bigint) as count
from (select l_orderkey as problem_id, cast(l_linenumber as bigint) as solution_order,
  cast(min(l_suppkey % 2) as bigint) as shard,
  bool_or(l_returnflag = 'A') as tag_a, bool_or(l_returnflag = 'R') as tag_r,
  bool_or(l_linestatus = 'O') as tag_o, bool_or(l_quantity > 40) as tag_big
  from {lineitem} group by l_orderkey, l_linenumber) f"""

LOG = """
select concat('run', cast(user_id % 3 as string)) as run, event_id as seq, ts,
  case when event_type = 'signup' then 'start' else 'chunk_done' end as event,
  user_id as problem_id, event_type <> 'error' as ok,
  cast(round(value * 100) as bigint) as call_elapsed_cs,
  case when event_type <> 'error' then null
       when event_id % 4 = 0 then 'ClientError: 429 RESOURCE_EXHAUSTED'
       when event_id % 4 = 1 then 'JSON_DECODE_ERROR: line 1'
       when event_id % 4 = 2 then 'KEY_WAIT_TIMEOUT'
       else 'ServerError: 500' end as error,
  concat(cast(event_id % 5 as string), case when event_id % 3 = 0 then '' else ', 9' end) as indices,
  case when event_id % 6 <> 5 then concat(cast(event_id as string), '/', cast(event_id + user_id as string)) end as progress,
  case when event_id % 8 <> 7 then cast(event_id * 7 as bigint) end as total_elapsed_cs
from {events}"""

#: The scored tags with their places, as a table that both engines read.
TAG_ROWS = "(values " + ", ".join(f"('{tag}', {i})" for i, tag in enumerate(V.SCORE_TAGS)) + ") v(tag, i)"

# the last tag is given to nobody: replies use it for scores that break the rules
RUNS_SMALL = f"""
select user_id as key, v.tag as tag, v.i as place,
  cast(coalesce(max(case when ts < timestamp '2024-01-16 00:00:00' then (event_id * 37 + 11) % 101 end), 0) as bigint) as score1,
  cast(coalesce(max(case when ts >= timestamp '2024-01-16 00:00:00' then (event_id * 53 + 7) % 101 end), 0) as bigint) as score2
from {{events}} join {TAG_ROWS} on v.i = (event_id * 7 + user_id) % 119 group by user_id, v.tag, v.i"""

RUNS_LARGE = f"""
select l_partkey as key, v.tag as tag, v.i as place,
  cast(least(100, sum(case when l_suppkey % 2 = 0 then 20 + cast(l_quantity as bigint) else 0 end)) as bigint) as score1,
  cast(least(100, sum(case when l_suppkey % 2 = 1 then 20 + cast(l_quantity as bigint) else 0 end)) as bigint) as score2
from {{lineitem}} join {TAG_ROWS} on v.i = (l_orderkey * 7 + l_linenumber) % 120 group by l_partkey, v.tag, v.i"""

LIMITS = """
select p_partkey as id,
  case p_partkey % 6 when 1 then concat(cast(p_size as string), ' seconds')
    when 2 then concat(cast(p_size * 100 as string), ' ms')
    when 3 then concat(cast(p_size as string), '.5 s')
    when 4 then 'none'
    when 5 then concat(cast(p_size as string), ' milliseconds') end as time_limit,
  case p_partkey % 6 when 1 then concat(cast(p_size as string), ' megabytes')
    when 2 then concat(cast(p_size * 1024 as string), ' kb')
    when 3 then '1.5 gigabytes'
    when 4 then cast(p_size * 65536 as string)
    when 5 then 'unlimited' end as memory_limit
from {part}"""

TAGS = V.SCORE_TAGS
BROAD = V.BROAD_CANDIDATES
RUNS = {"small": RUNS_SMALL, "large": RUNS_LARGE}
MARKER = "no peer"


def level_sql(score: str) -> str:
    return f"case when {score} >= 90 then 'HIGH' when {score} >= 60 then 'MEDIUM' else 'LOW' end"


def _level(score):
    return F.when(score >= 90, "HIGH").when(score >= 60, "MEDIUM").otherwise("LOW")


def log(t: Tables) -> DataFrame:
    """The log with its index lists as lists."""
    held = t.view(LOG)
    lists = F.split("indices", ", ").cast("array<bigint>")
    return held.withColumn("solution_indices", lists).drop("indices")


def corpus(t: Tables) -> DataFrame:
    """A nested corpus, one problem per document: lines as inputs, comma parts as outputs,
    sentences as solutions. Every ninth cell is unreadable: no JSON,
    cut short, with text behind its end, or with one bad element."""
    text = F.col("text")
    packed = F.to_json(F.struct(F.split(text, "\n").alias("inputs"), F.split(text, ", ").alias("outputs")))
    form = F.floor(F.col("doc_id") / 9) % 4
    broken = (
        F.when(form == 0, "broken{").when(form == 1, F.substring(packed, 1, 25))
        .when(form == 2, F.concat(packed, F.lit(" as asked"))).otherwise('{"inputs":["a","b"],"outputs":["x", y]}')
    )
    return t.documents.select(
        F.col("doc_id").alias("id"),
        F.col("source").alias("question"),
        F.col("lang").alias("difficulty"),
        F.when(F.col("doc_id") % 9 == 4, broken).otherwise(packed).alias("input_output"),
        F.to_json(F.split(text, r"\. ")).alias("solutions"),
        F.col("n_chars").alias("others"),
    )


# list_inputs / list_outputs as a check: nothing is parsed there, the lists come from the text
CORPUS_CHECK = r"""
select doc_id as id, source as question, lang as difficulty, n_chars as others,
  case when doc_id % 9 = 4 then [] else string_split(text, chr(10)) end as inputs,
  case when doc_id % 9 = 4 then [] else string_split(text, ', ') end as outputs,
  string_split(text, '. ') as solutions
from documents"""


def pairs(t: Tables, size: str) -> DataFrame:
    """Two score runs side by side, one row per key, scores in tag order, 0 where absent."""
    tags = TAGS
    # a key has a row for each of its tags, so at most as many as there are tags
    scored = t.view(RUNS[size]).groupBy("key").agg(
        *[F.array_sort(F.collect_list(F.struct("place", F.col(f"score{r}").alias("score")))).alias(f"_{r}") for r in (1, 2)]
    )

    def dense(held):
        """The scores of all places; the entries are met in turn, as they are sorted by place."""

        def step(so_far, place):
            entry = F.get(held, so_far["at"])
            hit = F.coalesce(entry["place"] == place, F.lit(False))
            score = F.when(hit, entry["score"]).otherwise(F.lit(0).cast("bigint"))
            return F.struct(F.array_append(so_far["scores"], score).alias("scores"), (so_far["at"] + hit.cast("int")).alias("at"))

        none = F.struct(F.array().cast("array<bigint>").alias("scores"), F.lit(0).alias("at"))
        return F.aggregate(F.sequence(F.lit(0), F.lit(len(tags) - 1)), none, step)["scores"]

    arrays = scored.select("key", *[dense(F.col(f"_{r}")).alias(f"scores{r}") for r in (1, 2)])
    tops = arrays.withColumns({f"_top{r}": first_highest(F.col(f"scores{r}"), tags) for r in (1, 2)})
    return tops.select(
        "key", "scores1", "scores2",
        *[F.col(f"_top{r}.tag").alias(f"primary{r}") for r in (1, 2)],
        *[_level(F.col(f"_top{r}.score")).alias(f"confidence{r}") for r in (1, 2)],
        F.when(F.col("key") % 3 == 0, f"{MARKER} here").when(F.col("key") % 4 != 1, "compared").alias("note1"),
        F.when(F.col("key") % 5 == 0, f"there is {MARKER}").otherwise("compared").alias("note2"),
    )


def pairs_check(size: str) -> str:
    """CTEs ``grid`` (key, tag, i, s1, s2) and ``pairs``, for the checks."""
    return f"""
with runs as ({RUNS[size]}), tags as (select * from {TAG_ROWS}),
grid as (select k.key, t.tag, t.i, coalesce(r.score1, 0) as s1, coalesce(r.score2, 0) as s2
  from (select distinct key from runs) k cross join tags t left join runs r on r.key = k.key and r.tag = t.tag),
tops as (select key, arg_max(tag, s1 * 1000 - i) as primary1, arg_max(tag, s2 * 1000 - i) as primary2,
  max(s1) as top1, max(s2) as top2 from grid group by key),
pairs as (select key, primary1, primary2, {level_sql('top1')} as confidence1, {level_sql('top2')} as confidence2,
  case when key % 3 = 0 then '{MARKER} here' when key % 4 <> 1 then 'compared' end as note1,
  case when key % 5 = 0 then 'there is {MARKER}' else 'compared' end as note2 from tops)"""


def requests(t: Tables) -> DataFrame:
    """One requested solution per user; two users share a problem, which is also the chunk."""
    key, chunk = F.col("user_id"), F.floor(F.col("user_id") / 2).cast("bigint")
    return t.events.select("user_id").distinct().select(
        chunk.alias("chunk_id"), (key % 2).alias("solution_index"), chunk.alias("id"),
        F.concat(F.lit("problem "), chunk.cast("string")).alias("title"),
        F.when(chunk % 5 == 0, "none").otherwise((chunk % 3).cast("string")).alias("selected_submission_index"),
        F.when(key % 3 == 0, "import sys\nprint(1)").when(key % 3 == 1, "#include <x>\nint main()\n").otherwise("x").alias("code"),
    )


def _entry(tag, value):
    """A part of a JSON object."""
    return F.concat(F.lit('"'), tag, F.lit('":'), value)


def replies(t: Tables) -> DataFrame:
    """One reply text per chunk, with the faults that real replies have; each rule of the contract is broken by some.

    Numbers as text, nulls, fractions, values out of range, Markdown fences, missing and repeated items,
    unknown and unreadable indexes, cut texts, absent fields and candidates, and values outside the
    agreed lists. Lists stay short: a user has one row per tag, a chunk two users.
    """
    key = F.col("key")
    tagged = t.view(RUNS_SMALL).groupBy("key").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score1")).alias("neg"), "tag", "score1", "score2"))).alias("m")
    )
    top = F.col("m")[0]
    second = F.transform(
        F.filter("m", lambda x: (x["score1"] >= 60) & (x["tag"] != top["tag"])), lambda x: x["tag"]
    )
    more = tagged.withColumns({"top": top, "second": second})
    has_two = F.size("second") > 0

    def filled(entries, names, when):
        """The entries and, for some, the rest of the names with a score of 0."""
        rest = F.array_except(F.array(*[F.lit(n) for n in names]), F.transform("m", lambda x: x["tag"]))
        rest = F.when(when, rest).otherwise(F.array().cast("array<string>"))
        return F.concat(entries, F.transform(rest, lambda n: _entry(n, F.lit("0"))))

    def odd(name: str, *faults):
        """The entry of a name nobody has, for keys with a fault."""
        value = F
        for when, text in faults:
            value = value.when(when, F.array(F.lit(f'"{name}":{text}')))
        return value.otherwise(F.array().cast("array<string>"))

    def recheck(tag: str):
        own = F.coalesce(F.get(F.filter("m", lambda x: x["tag"] == tag), 0)["score1"], F.lit(0))
        told = F.when(key % 41 == 0, "MAYBE").when(own >= 80, "LIKELY_SPECIFIC_ALGORITHM").when(
            own >= 60, "REVIEW_NEEDED"
        ).otherwise("KEEP_ORIGINAL")
        graph = "GRAPH" in BROAD[tag]
        faults = [((key % 59 == 10), "120"), ((key % 61 == 11), "7.5")] if graph else []
        given = F.transform("m", lambda x: _entry(x["tag"], x["score2"].cast("string")))
        given = filled(given, [c for c in BROAD[tag] if c != "GRAPH"], key % 6 == 0)
        if graph:
            given = F.concat(given, odd("GRAPH", *faults, (key % 6 == 0, "0")))
        block = F.concat(
            F.lit(f'"{recheck_field(tag)}":{{"candidate_scores":{{'), F.array_join(given, ","), F.lit('},"recheck_decision":"'), told,
            F.lit('"'), F.when(key % 3 != 0, ',"recheck_reason":"because"').otherwise(""), F.lit("},"),
        )
        return F.when(key % 13 != 1, block).otherwise("")

    first_tag = F.when(key % 53 == 9, "BOGUS").otherwise(F.col("top.tag"))
    body = F.to_json(F.struct(
        F.when(key % 8 != 5, F.col("top.tag")).alias("primary_algorithm"),
        F.col("second").alias("secondary_algorithms"),
        has_two.alias("is_composite"),
        F.when(has_two & (key % 29 == 0), F.array(F.col("top.tag"), F.get("second", 0), F.lit("extra")))
        .when(has_two, F.array(F.col("top.tag"), F.get("second", 0)))
        .otherwise(F.array().cast("array<string>")).alias("composite_algorithm"),
        F.transform(
            F.slice("m", F.lit(1), F.when(key % 31 == 0, 2).otherwise(3)),
            lambda x, i: F.struct(F.when(i == 0, first_tag).otherwise(x["tag"]).alias("tag"), F.when(key % 37 != 0, x["score1"]).alias("score")),
        ).alias("top_3_algorithms"),
        F.when(key % 23 == 0, "SURE").when(key % 7 != 2, _level(F.col("top.score1"))).alias("confidence"),
        F.concat(F.lit("about "), key.cast("string")).alias("solution_summary"),
        F.when(key % 5 != 1, "line 1").alias("code_evidence"),
        *[F.lit("told").alias(f) for f in (
            "time_complexity_reasoning", "classification_reason", "rejected_candidates", "uncertain_points",
            "compared_with_other_solutions")],
    ))

    def score(x):
        quoted = F.concat(F.lit('"'), x["score1"].cast("string"), F.lit('"'))
        return _entry(x["tag"], F.when(key % 5 == 0, quoted).when(key % 7 == 0, "null").otherwise(x["score1"].cast("string")))

    scores = filled(F.transform("m", score), [tag for tag in TAGS if tag != "UNKNOWN"], key % 4 == 0)
    scores = F.concat(scores, odd("UNKNOWN", (key % 43 == 6, "150"), (key % 47 == 8, "85.5"), (key % 4 == 0, "0")))
    number = (key % 2).cast("string")
    index = F.when(key % 11 == 3, '"x"').when(key % 19 == 5, '"7"').when(key % 10 == 1, F.concat(F.lit('"'), number, F.lit('"'))).otherwise(number)
    item = F.concat(
        F.lit('{"solution_index":'), index, F.lit(',"algorithm_scores":{'), F.array_join(scores, ","), F.lit("},"),
        *[recheck(tag) for tag in BROAD], F.substring(body, 2, 1 << 30),
    )
    item = F.when(key % 29 == 7, F.concat(item, F.lit(","), item)).otherwise(item)
    chunked = more.select(F.floor(key / 2).cast("bigint").alias("chunk_id"), key, F.when(key % 17 != 0, item).alias("item"))
    whole = chunked.groupBy("chunk_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("item").isNotNull(), F.struct("key", "item")))).alias("items")
    )
    text = F.concat(
        F.lit('{"solutions":['), F.array_join(F.transform("items", lambda x: x["item"]), ","), F.lit("]}")
    )
    return whole.select(
        "chunk_id",
        F.when(F.col("chunk_id") % 13 == 0, F.substring(text, 1, 40))
        .when(F.col("chunk_id") % 3 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .otherwise(text).alias("reply"),
    )


# ``good`` items are those whose reply can be read and whose index is known; ``m`` their tags
REPLY_CHECK = f"""
with runs as ({RUNS_SMALL}),
users as (select distinct key, key // 2 as chunk_id, key % 2 as solution_index from runs),
sent as (select *, case when key % 29 = 7 then 2 else 1 end as copies from users where chunk_id % 13 <> 0 and key % 17 <> 0),
good as (select * from sent where key % 11 <> 3 and key % 19 <> 5),
tags as (select * from {TAG_ROWS}),
m as (select runs.*, row_number() over (partition by key order by score1 desc, tag) as rk,
  case when key % 5 <> 0 and key % 7 = 0 then 0 else score1 end as s from runs),
tops as (select key, tag as top, score1 as top_score from m where rk = 1),
seconds as (select key, string_agg(tag, ' | ' order by rk) as second, min(rk) as first_rk from m
  where rk > 1 and score1 >= 60 group by key),
grid as (select u.key, t.tag, t.i, case when t.tag <> 'UNKNOWN' then coalesce(m.s, 0) when u.key % 43 = 6 then 150
    when u.key % 47 = 8 then 85 else 0 end as s, coalesce(m.score1, 0) as raw, coalesce(m.score2, 0) as s2
  from users u cross join tags t left join m on m.key = u.key and m.tag = t.tag)"""


def batches(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Documents in batches of ten, and one list reply per batch, some of them faulty."""
    rows = t.documents.select(
        F.floor(F.col("doc_id") / 10).cast("bigint").alias("batch_id"), (F.col("doc_id") % 10).alias("item_no"),
        "doc_id", "n_chars",
    )
    value = F.when(F.col("doc_id") % 9 == 0, "1").when(F.col("n_chars") > 500, "true").otherwise("false")
    # ten ids make a batch, so the list is bounded
    told = rows.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("item_no", value.alias("v")))).alias("vs"),
        F.count(F.lit(1)).alias("n_items"),
    )
    b = F.col("batch_id")
    kept = F.slice("vs", F.lit(1), F.when(b % 7 == 0, F.col("n_items") - 1).otherwise(F.col("n_items")).cast("int"))
    text = F.concat(F.lit("["), F.array_join(F.transform(kept, lambda x: x["v"]), ", "), F.lit("]"))
    reply = (
        F.when(b % 13 == 2, "sorry").when(b % 11 == 1, "[]")
        .when(b % 3 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```"))).otherwise(text)
    )
    return rows, told.select("batch_id", "n_items", reply.alias("reply"))


BATCH_REASON = (
    "case when b % 13 = 2 then 'UNREADABLE' when b % 11 = 1 then 'EMPTY' when b % 7 = 0 then 'LENGTH' end"
)
