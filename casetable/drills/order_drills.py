"""Order, chunks, requests, logs and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable.drills import views as W
from casetable.drills.base import Tables, drill
from casetable.drills.io_drills import LOG_CHECK, log_lines
from casetable.operators import keys as K, order as O, profile as P, requests as Q
from casetable.sources.tables import parse_log
from casetable.streaming import log_streams as S

# --- sort, dedup, chunks -----------------------------------------------------------------


@drill("G1_sort_numeric", """
select c_custkey, case c_custkey % 4 when 0 then c_custkey::varchar when 1 then c_custkey || '.0' when 2 then 'x' end as id,
  row_number() over (order by case when c_custkey % 4 < 2 then c_custkey end nulls last, c_custkey) as position from customer""")
def _(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    text = F.when(key % 4 == 0, key.cast("string")).when(key % 4 == 1, F.concat(key.cast("string"), F.lit(".0"))).when(key % 4 == 2, "x")
    return K.number_rows(O.sort_numeric(t.customer.select("c_custkey", text.alias("id")), ["id", "c_custkey"]), "position")


FLAG_KEYS = ["problem_id", *W.FLAG_NAMES]
DEDUP = f"""
with f as ({W.FLAGS}), k as (select *, row_number() over (partition by {', '.join(FLAG_KEYS)} order by solution_order) as pos from f)"""


@drill("G2_dedup_first", f"{DEDUP} select problem_id, solution_order, {', '.join(W.FLAG_NAMES)}, count from k where pos = 1")
def _(t: Tables) -> DataFrame:
    return O.dedup_first(t.view(W.FLAGS).drop("shard"), FLAG_KEYS, "solution_order")


@drill("F30_dedup_report", f"""{DEDUP}
select count(*) as before, count(*) filter (where pos = 1) as after, count(*) filter (where pos > 1) as removed from k""")
def _(t: Tables) -> DataFrame:
    flags = t.view(W.FLAGS).drop("shard")
    return P.dedup_report(flags, FLAG_KEYS)


CHUNKS = """
with c as (select *, row_number() over (partition by conv_id order by turn) - 1 as pos from conversations),
k as (select conv_id, turn, role, text, pos // 2 as chunk_no, pos % 2 as item_no from c)"""


def _chunks(t: Tables) -> DataFrame:
    return O.chunk_rows(t.conversations, ["conv_id"], ["turn"], 2, width=100_000)


@drill("G6_chunk_rows", f"{CHUNKS} select conv_id, turn, chunk_no, item_no from k")
def _(t: Tables) -> DataFrame:
    return _chunks(t).select("conv_id", "turn", "chunk_no", "item_no")


@drill("G6_chunk_rows_by_range", """
with c as (select l_suppkey, l_orderkey, l_linenumber, l_partkey, l_extendedprice, row_number() over (partition by l_suppkey
  order by l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 as pos from lineitem)
select l_suppkey, l_orderkey, l_partkey, pos // 10 as chunk_no, pos % 10 as item_no from c""")
def _(t: Tables) -> DataFrame:
    """Few large groups without a whole-number order of their own."""
    chunked = O.chunk_rows(
        t.lineitem.select("l_suppkey", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"),
        ["l_suppkey"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], 10,
    )
    return chunked.select("l_suppkey", "l_orderkey", "l_partkey", "chunk_no", "item_no")


PLAN = [("system", 1), ("user", 3), ("assistant", 2)]


@drill("G7_renumber_typed", """
with plan(type, start, n) as (values ('system', 1, 1), ('user', 2, 3), ('assistant', 5, 2)),
k as (select conv_id, role, text, row_number() over (partition by conv_id, role order by turn) as pos from conversations),
kept as (select k.conv_id as problem_id, type, start + pos - 1 as testcase_order, text as input from k join plan on role = type where pos <= n),
ids as (select distinct conv_id from conversations)
select * from kept
union all select conv_id, type, unnest(range(start, start + n)), '#ERROR' from ids cross join plan
where not exists (select 1 from kept where kept.problem_id = ids.conv_id and kept.type = plan.type)""")
def _(t: Tables) -> DataFrame:
    items = t.conversations.select(
        F.col("conv_id").alias("problem_id"), F.col("role").alias("type"), F.col("turn").alias("item_no"), F.col("text").alias("input")
    )
    return O.renumber_typed(items, PLAN, items.select("problem_id").distinct())


@drill("H1_render_requests", f"""{CHUNKS}
select conv_id, chunk_no, count(*) as item_count,
  'conversation ' || conv_id || chr(10) || string_agg(role || ' at ' || turn || ' said: ' || text, chr(10) order by item_no)
    || chr(10) || 'answer as JSON' as request
from k group by conv_id, chunk_no""")
def _(t: Tables) -> DataFrame:
    item = F.concat(F.col("role"), F.lit(" at "), F.col("turn").cast("string"), F.lit(" said: "), F.col("text"))
    header = F.concat(F.lit("conversation "), F.col("conv_id").cast("string"))
    return Q.render_requests(_chunks(t), ["conv_id", "chunk_no"], "item_no", header, item, F.lit("answer as JSON"))


@drill("H2_sample_k_per_row", """
with n as (select n_name, row_number() over (order by n_name) - 1 as slot from (select distinct n_name from nation)),
p as (select min(x) as prime, (select count(*) from n) as m from range(2, 2000) r(x)
  where x >= (select count(*) from n) and not exists (select 1 from range(2, 50) d(d) where d < x and x % d = 0)),
s as (select s_suppkey, ('0x' || substr(md5('11:start:' || s_suppkey), 1, 8))::bigint % prime as start,
  ('0x' || substr(md5('11:stride:' || s_suppkey), 1, 8))::bigint % (prime - 1) + 1 as stride, prime, m from supplier cross join p),
v as (select s_suppkey, start, stride, prime, unnest(range(4 + prime - m)) as j from s),
k as (select s_suppkey, j, n_name, row_number() over (partition by s_suppkey order by j) as pos
  from v join n on n.slot = (start + j * stride) % prime)
select s_suppkey, string_agg(n_name, ',' order by j) as picked from k where pos <= 4 group by s_suppkey""")
def _(t: Tables) -> DataFrame:
    picked = Q.sample_k(t.supplier, t.nation, 4, 11, "s_suppkey", "n_name")
    return picked.select("s_suppkey", F.array_join("picked", ",").alias("picked"))


# --- logs --------------------------------------------------------------------------------

TOTALS = f"""
with log as ({W.LOG}), d as (select * from log where event = 'chunk_done'),
w as (select *, row_number() over o as done_so_far, (sum(ok::int) over o)::bigint as ok_so_far,
  (sum(call_elapsed_cs) over o)::bigint as elapsed_so_far from d
  window o as (partition by run order by ts, seq rows between unbounded preceding and current row))"""


@drill("G8_running_totals", f"{TOTALS} select run, seq, done_so_far, ok_so_far, elapsed_so_far from w")
def _(t: Tables) -> DataFrame:
    return O.running_totals(t.view(W.LOG)).select("run", "seq", "done_so_far", "ok_so_far", "elapsed_so_far")


EVERY = 10


def _every_sql(totals: str) -> str:
    return f"""{totals}
select run, (done_so_far - 1) // {EVERY} as group_no, max(done_so_far) as done_so_far, max(ok_so_far) as ok_so_far,
  count(*) filter (where ok) as ok_count, sum(call_elapsed_cs)::bigint / {EVERY} / 100.0::double as mean_s,
  max(progress) filter (where done_so_far % {EVERY} = 0) as progress,
  max(total_elapsed_cs) filter (where done_so_far % {EVERY} = 0) / 6000.0::double as elapsed_min,
  coalesce(string_agg(problem_id || '#[' || indices || ']', ', ' order by done_so_far) filter (where not ok), '') as failed
from w group by 1, 2 having count(*) = {EVERY}"""


@drill("G9_every_n_summary", _every_sql(TOTALS))
def _(t: Tables) -> DataFrame:
    return O.every_n_summary(W.log(t), EVERY)


@drill("F31_log_stats", f"""
with log as ({W.LOG}), d as (select *, epoch_us(ts) as us from log where event = 'chunk_done')
select run, count(*) as calls, count(*) filter (where ok) as ok_count, count(*) filter (where not ok) as failed,
  sum(call_elapsed_cs)::bigint / count(*) / 100.0::double as mean_s, max(call_elapsed_cs) / 100.0::double as max_s,
  (max(us) - min(us)) / 1000000.0::double as wall_s, count(*) * 60.0::double / ((max(us) - min(us)) / 1000000.0::double) as calls_per_minute
from d group by run""")
def _(t: Tables) -> DataFrame:
    return P.log_stats(t.view(W.LOG))


# --- live logs ---------------------------------------------------------------------------


def _replay(t: Tables, start, parts: int = 3) -> None:
    """The log arriving in parts: each is written, and the query started again from its checkpoint."""
    path = t.scratch("live")
    seq = F.coalesce(F.get_json_object("value", "$.seq"), F.regexp_extract("value", r"(\d+)$", 1)).cast("bigint")
    lines = log_lines(t).withColumn("seq", seq)
    size = t.events.agg(F.max("event_id")).scalar() + 1
    for i in range(parts):
        part = lines.where(F.floor(F.col("seq") * parts / size) == i)
        part.select("value").write.mode("append").text(path)
        start(parse_log(t.spark.readStream.text(path))).awaitTermination()


@drill("I1_stream_every_n", _every_sql(TOTALS))
def _(t: Tables) -> DataFrame:
    path, state = t.scratch("every"), t.scratch("every-state")
    _replay(t, lambda log: S.stream_every_n(log, path, state, EVERY))
    return t.spark.read.parquet(path)


@drill("I1_stream_passed", f"""{LOG_CHECK}
select event, seq, null::varchar as raw from kept where event <> 'chunk_done'
union all select null, null, 'Traceback at ' || seq from log where event = 'start' and seq % 7 = 0""")
def _(t: Tables) -> DataFrame:
    path, state = t.scratch("passed"), t.scratch("passed-state")
    _replay(t, lambda log: S.stream_passed(log, path, state))
    return t.spark.read.parquet(path).select("event", "seq", "raw")


@drill("I2_stream_append_once", f"""
with log as ({W.LOG}), d as (select problem_id, call_elapsed_cs, min(seq) as seq from log where event = 'chunk_done' group by 1, 2)
select * from d""")
def _(t: Tables) -> DataFrame:
    path = t.scratch("once")
    state, keys = t.scratch("once-state"), ["problem_id", "call_elapsed_cs"]
    _replay(t, lambda log: S.append_once(
        log.where("event = 'chunk_done'").select(*keys, "seq"), path, state, keys, "seq", buckets=16))
    return S.read_appended(t.spark, path).select(*keys, "seq")


@drill("I3_stream_running_totals", f"""
with log as ({W.LOG}) select run, count(*) as done, count(*) filter (where ok) as ok_count from log where event = 'chunk_done' group by run""")
def _(t: Tables) -> DataFrame:
    path, state = t.scratch("totals"), t.scratch("totals-state")
    _replay(t, lambda log: S.stream_totals(log, path, state))
    return S.read_totals(t.spark, path)
