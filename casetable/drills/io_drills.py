"""Sources and sinks: what is written must be read back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable import vocab as V
from casetable.drills import views as W
from casetable.drills.base import Tables, drill
from casetable.drills.scoring_drills import RECHECK_CHECK, SCORE_CHECK, matched
from casetable.operators.nested import score_pivot
from casetable.operators.scoring import recheck_rows, score_rows
from casetable.session import children
from casetable.sources import sinks, tables as S

TS_FORMAT = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
PART_SCHEMA = "id string, name string, size bigint"


def _part(t: Tables) -> DataFrame:
    name = F.concat(F.col("p_name"), F.lit('\n"'), F.col("p_brand"), F.lit('", '), F.col("p_type"))
    return t.part.select(F.col("p_partkey").cast("string").alias("id"), name.alias("name"), F.col("p_size").cast("bigint").alias("size"))


PART_CHECK = """
select cast(p_partkey as varchar) as id, p_name || chr(10) || '"' || p_brand || '", ' || p_type as name,
  cast(p_size as bigint) as size from part"""


@drill("A1_read_table_csv", PART_CHECK)
def _(t: Tables) -> DataFrame:
    path = t.scratch("csv")
    sinks.write_table(_part(t), path, fmt="csv")
    return S.read_csv(t.spark, path, PART_SCHEMA)


@drill("A2_read_nested_parquet", "select doc_id, source, text, n_chars from documents")
def _(t: Tables) -> DataFrame:
    return S.read_corpus(t.spark, f"{t.folder}/documents.parquet", ["doc_id", "source", "text", "n_chars", "absent"])


def _faulty_csv(t: Tables) -> tuple[DataFrame, DataFrame]:
    key = F.col("p_partkey")
    size = F.when(key % 17 == 8, "bad").otherwise(F.col("p_size").cast("string"))
    name = F.when(key % 11 == 5, "").when(
        key % 19 == 9, F.concat(F.lit('"say \\"'), F.col("p_name"), F.lit(', you\\" now"'))
    ).otherwise(F.col("p_name"))
    line = F.concat(
        F.when(key % 50 == 0, "x").otherwise(""), key.cast("string"),
        F.when(key % 3 == 0, ".0").otherwise(""), F.lit(","), size,
        F.when(key % 7 == 3, "").otherwise(F.concat(F.lit(","), name)),
        F.when((key % 13 == 6) & (key % 7 != 3), ",extra").otherwise(""),
    )
    path = t.scratch("tolerant")
    t.part.select(line).write.text(path)
    return S.read_csv_tolerant(t.spark, path, "id string, size bigint, name string", ["id"], header=False, escape="\\")


FAULTY_CHECK = r"""
with p as (
  select p_partkey as key, p_partkey % 7 = 3 as short, p_partkey % 13 = 6 and p_partkey % 7 <> 3 as long, p_partkey % 50 = 0 as unkeyed,
    p_partkey % 17 = 8 as misfit, p_size,
    case when p_partkey % 11 = 5 then null when p_partkey % 19 = 9 then 'say "' || p_name || ', you" now' else p_name end as name,
    case when p_partkey % 11 = 5 then '' when p_partkey % 19 = 9 then '"say \"' || p_name || ', you\" now"' else p_name end as cell
  from part
), r as (
  select *, case when unkeyed then 'x' else '' end || key || case when key % 3 = 0 then '.0' else '' end as id,
    case when misfit then 'bad' else p_size::varchar end as size,
    case when short then 'short' when long then 'long' when unkeyed then 'key' when misfit then 'type' end as reason from p
)"""


@drill("A3_read_csv_tolerant_good", FAULTY_CHECK + """
select key as id, cast(size as bigint) as size, name from r where reason is null""")
def _(t: Tables) -> DataFrame:
    return _faulty_csv(t)[0]


@drill("A3_read_csv_tolerant_rejected", FAULTY_CHECK + """
select id, size, case when not short then name end as name, reason,
  case when short then id || ',' || size when long then id || ',' || size || ',' || cell || ',extra' end as record
from r where reason is not null""")
def _(t: Tables) -> DataFrame:
    return _faulty_csv(t)[1]


@drill("A4_read_shards", """
select doc_id, source, case when doc_id % 4 < 2 then n_chars end as n_chars,
  case when doc_id % 4 = 3 then 5 else doc_id % 4 end as rank from documents""")
def _(t: Tables) -> DataFrame:
    path = t.scratch("shards")
    for i, rank in enumerate((0, 1, 2, 5)):  # shards 3 and 4 are missing
        cols = ["doc_id", "source"] + (["n_chars"] if i < 2 else [])
        sinks.write_table(t.documents.where(F.col("doc_id") % 4 == i).select(*cols), f"{path}/shard-{rank}")
    return S.read_shards(t.spark, f"{path}/shard-*", r"shard-(\d+)", "doc_id bigint, source string, n_chars bigint")


def log_lines(t: Tables) -> DataFrame:
    """The log as JSON lines; every seventh start event is a plain text line instead."""
    log = W.log(t)
    plain = (F.col("event") == "start") & (F.col("seq") % 7 == 0)
    fields = ["event", "run", "seq", "ts", "problem_id", "ok", "call_elapsed_cs", "error", "solution_indices", "progress", "total_elapsed_cs"]
    return log.select(
        F.when(plain, F.concat(F.lit("Traceback at "), F.col("seq").cast("string"))).otherwise(
            F.to_json(F.struct(*fields), {"timestampNTZFormat": TS_FORMAT})
        ).alias("value")
    )


LOG_CHECK = f"with log as ({W.LOG}), kept as (select * from log where event <> 'start' or seq % 7 <> 0)"


@drill("A5_read_event_log", f"""{LOG_CHECK}
select event, run, seq, problem_id, ok, call_elapsed_cs, error, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') as ts, null::varchar as raw,
  indices as solution_indices, progress, total_elapsed_cs from kept
union all select null, null, null, null, null, null, null, null, 'Traceback at ' || seq, null, null, null from log
where event = 'start' and seq % 7 = 0""")
def _(t: Tables) -> DataFrame:
    path = t.scratch("log")
    log_lines(t).write.text(path)
    indices = F.array_join(F.col("solution_indices").cast("array<string>"), ", ")
    return S.read_log(t.spark, path).withColumns({"ts": F.date_format("ts", TS_FORMAT), "solution_indices": indices})


@drill("A6_read_results", f"""
select problem_id, solution_order, testcase_order, error, timed_out, expected_output, actual_output, validation
from ({W.RESULTS})""")
def _(t: Tables) -> DataFrame:
    path = t.scratch("results")
    t.view(W.RESULTS).write.option("header", True).option("ignoreLeadingWhiteSpace", False).option(
        "ignoreTrailingWhiteSpace", False).csv(path)
    return S.read_results(t.spark, path)


@drill("A7_write_table", "select p_partkey, p_name, cast(p_size as bigint) as p_size from part")
def _(t: Tables) -> DataFrame:
    path = t.scratch("append")
    small = F.col("p_size") < 20
    part = t.part.select("p_partkey", "p_name", F.col("p_size").cast("bigint").alias("p_size"))
    for mode in ("overwrite", "overwrite"):  # the second write replaces the first
        sinks.write_table(part.where(small), path, mode, "csv")
    sinks.write_table(part.where(~small), path, "append", "csv")
    return S.read_csv(t.spark, path, "p_partkey bigint, p_name string, p_size bigint")


def _report(t: Tables) -> str:
    path, rows, tags = t.scratch("report"), matched(t).persist(), W.TAGS
    scores = score_pivot(score_rows(rows, tags), tags)
    sinks.write_report(
        scores, recheck_rows(rows, tags, W.BROAD), path, V.score_columns(tags), V.recheck_columns(W.BROAD)
    )
    rows.unpersist()
    return path


_BLANK = [c for c in V.PROBLEM_COLUMNS if c not in ("id", "title", "selected_submission_index")]


@drill("A8_write_report_scores", f"""select *, {', '.join(f"'' as {c}" for c in _BLANK)} from ({SCORE_CHECK})""")
def _(t: Tables) -> DataFrame:
    return t.spark.read.parquet(f"{_report(t)}/scores")


@drill("A8_write_report_recheck", RECHECK_CHECK)
def _(t: Tables) -> DataFrame:
    return t.spark.read.parquet(f"{_report(t)}/recheck")


@drill("A9_publish_snapshot", "select s_suppkey, s_name, s_acctbal, 3::bigint as version, 2::bigint as kept from supplier")
def _(t: Tables) -> DataFrame:
    path = t.scratch("snapshot")
    supplier = t.supplier.select("s_suppkey", "s_name", "s_acctbal")
    for version in (supplier.select("s_suppkey"), supplier.withColumn("s_name", F.upper("s_name")), supplier):
        newest = sinks.publish(version, path)
    kept = len(children(t.spark, path)) - 1  # beside the folder of the versions themselves
    return sinks.read_snapshot(t.spark, path).select(
        "*", F.lit(newest).cast("bigint").alias("version"), F.lit(kept).cast("bigint").alias("kept")
    )
