"""Ids, columns, nested cells and corpus profile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable.drills import views as W
from casetable.drills.base import Tables, drill
from casetable.functions.json_cells import is_list_literal, parse_io, parse_list
from casetable.operators import cleaning, columns as C, keys as K, nested as N, profile as P

NUMBERED = """
with o as (select *, row_number() over (order by o_orderdate, o_orderkey) as row_no from orders)"""


def _numbered(t: Tables) -> DataFrame:
    return K.assign_ids(t.orders, ["o_orderdate", "o_orderkey"], "row_no")


@drill("B1_assign_ids", f"{NUMBERED} select row_no, o_orderkey, o_custkey from o")
def _(t: Tables) -> DataFrame:
    return _numbered(t).select("row_no", "o_orderkey", "o_custkey")


@drill("B2_slice_range", f"{NUMBERED} select row_no, o_orderkey from o where row_no between 1251 and 1400")
def _(t: Tables) -> DataFrame:
    return K.slice_range(_numbered(t), 1251, 1400).select("row_no", "o_orderkey")


@drill("B3_preview", f"{NUMBERED} select row_no, o_orderkey, o_orderstatus from o order by row_no limit 10")
def _(t: Tables) -> DataFrame:
    return K.preview(_numbered(t), 10).select("row_no", "o_orderkey", "o_orderstatus")


@drill("B4_sample_after", f"""{NUMBERED}
select row_no, o_orderkey from o where row_no > 10000
order by md5('42:' || o_orderkey), o_orderkey limit 100""")
def _(t: Tables) -> DataFrame:
    return K.sample_after(_numbered(t), 10000, 100, 42, "o_orderkey").select("row_no", "o_orderkey")


def _text_keys(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    text = key.cast("string")
    return t.customer.select(
        "c_custkey",
        F.when(key % 4 == 0, text).when(key % 4 == 1, F.concat(text, F.lit(".0")))
        .when(key % 4 == 2, F.concat(F.lit("x"), text)).alias("id"),
    )


@drill("B5_canonical_id", "select c_custkey, case when c_custkey % 4 < 2 then c_custkey end as id from customer")
def _(t: Tables) -> DataFrame:
    return K.with_canonical_id(_text_keys(t), "id")


@drill("B6_digit_id_guard", "select c_custkey, cast(c_custkey as varchar) as id from customer where c_custkey % 4 = 0")
def _(t: Tables) -> DataFrame:
    return K.keep_digit_ids(_text_keys(t), "id")


@drill("B7_drop_null_id", "select c_custkey from customer where c_custkey % 4 <> 3")
def _(t: Tables) -> DataFrame:
    return K.drop_null_id(_text_keys(t), "id").select("c_custkey")


@drill("B8_id_quality", "select count(*) as checked, count(*) filter (where c_custkey % 4 > 1) as not_numeric from customer")
def _(t: Tables) -> DataFrame:
    return K.id_quality(_text_keys(t), "id")


@drill("B9_distinct_keys", "select distinct l_orderkey as problem_id from lineitem")
def _(t: Tables) -> DataFrame:
    return K.distinct_keys(t.lineitem, F.col("l_orderkey").alias("problem_id"))


def _with_layout(df: DataFrame) -> DataFrame:
    """The rows, and the order of the columns as a cell."""
    return df.withColumn("layout", F.lit(",".join(df.columns)))


@drill("C1_front_columns", """
select p_size, p_partkey, p_name, p_brand, p_type, p_retailprice,
  'p_size,p_partkey,p_name,p_brand,p_type,p_retailprice' as layout from part""")
def _(t: Tables) -> DataFrame:
    return _with_layout(C.front_columns(t.part, ["p_size", "absent", "p_partkey"]))


@drill("C2_insert_after", """
select p_partkey, p_name, length(p_name) as name_length, p_brand, p_type, p_size, p_retailprice,
  'p_partkey,p_name,name_length,p_brand,p_type,p_size,p_retailprice' as layout from part""")
def _(t: Tables) -> DataFrame:
    older = t.part.withColumn("name_length", F.lit(0)).withColumn("name_length_old", F.lit(0))
    return _with_layout(
        C.insert_after(older, "p_name", {"name_length": F.length("p_name").cast("bigint")}, ["name_length_old"])
    )


@drill("C3_drop_matching", "select s_suppkey, s_name, 's_suppkey,s_name' as layout from supplier")
def _(t: Tables) -> DataFrame:
    extra = t.supplier.select("s_suppkey", "s_name", F.col("s_acctbal").alias("Unnamed: 0"), F.lit(1).alias("Unnamed: 7"))
    return _with_layout(C.drop_prefix(extra, "Unnamed:"))


@drill("C4_rename_drop_add", """
select conv_id as problem_id, turn as testcase_order, role as input_text, text as expected_output,
  turn not in (1, 2) as is_hidden, null::boolean as is_deleted,
  'problem_id,testcase_order,input_text,expected_output,is_hidden,is_deleted' as layout from conversations""")
def _(t: Tables) -> DataFrame:
    cases = t.conversations.select(
        F.col("conv_id").alias("problem_id"), F.col("turn").alias("testcase_order"), F.col("role").alias("input"),
        F.col("text").alias("output"), F.lit(True).alias("validation"),
    )
    return _with_layout(C.to_public_cases(cases))


@drill("C5_ensure_columns", """
select s_suppkey, s_name, null::varchar as generated_title, null::bigint as rating,
  's_suppkey,s_name,generated_title,rating' as layout from supplier""")
def _(t: Tables) -> DataFrame:
    df = t.supplier.select("s_suppkey", "s_name")
    return _with_layout(C.ensure_columns(df, {"s_name": "string", "generated_title": "string", "rating": "bigint"}))


@drill("C6_blank_false", f"""
select problem_id, solution_order, count, {', '.join(f"case when {c} then 'True' else '' end as {c}" for c in W.FLAG_NAMES)}
from ({W.FLAGS})""")
def _(t: Tables) -> DataFrame:
    return C.blank_false(t.view(W.FLAGS).drop("shard"), W.FLAG_NAMES)


CORPUS = f"with c as ({W.CORPUS_CHECK})"
COUNTED = f"""{CORPUS}, n as (select id, question, difficulty, others, len(inputs) as count_input, len(outputs) as count_output,
  len(solutions) as count_solutions, len(inputs) = len(outputs) as count_same, inputs, outputs, solutions from c)"""


@drill("D1_parse_io", f"""{CORPUS}
select id, case when id % 9 <> 4 then array_to_string(inputs, '|') end as inputs,
  case when id % 9 <> 4 then array_to_string(outputs, '|') end as outputs from c""")
def _(t: Tables) -> DataFrame:
    io = W.corpus(t).select("id", parse_io(F.col("input_output")).alias("io"))
    return io.select("id", *[F.array_join(f"io.{c}", "|").alias(c) for c in ("inputs", "outputs")])


@drill("D2_count_io", f"{COUNTED} select id, count_input, count_output, count_same from n")
def _(t: Tables) -> DataFrame:
    return N.count_io(W.corpus(t)).select("id", "count_input", "count_output", "count_same")


CASES = f"""{CORPUS}, k as (select id, inputs, outputs, unnest(range(1, least(len(inputs), len(outputs)) + 1)) as i from c)
select id as problem_id, i as testcase_order, inputs[i] as input, outputs[i] as output, null::boolean as validation from k"""


@drill("D3_explode_cases", CASES)
def _(t: Tables) -> DataFrame:
    return N.explode_cases(W.corpus(t).select("id", parse_io(F.col("input_output")).alias("_io")))


SOLUTIONS = f"""{CORPUS}, k as (select id, solutions, unnest(range(1, len(solutions) + 1)) as i from c)
select id as problem_id, i as solution_order, solutions[i] as solution, null::boolean as validation from k"""


@drill("D4_explode_solutions", SOLUTIONS)
def _(t: Tables) -> DataFrame:
    return N.explode_solutions(W.corpus(t).select("id", parse_list(F.col("solutions")).alias("_solutions")))


@drill("D5_count_solutions", f"{COUNTED} select id, count_solutions from n")
def _(t: Tables) -> DataFrame:
    return N.count_solutions(W.corpus(t)).select("id", "count_solutions")


@drill("D6_split_corpus_problems", f"""{COUNTED}
select id, question, count_input as count_cases, count_solutions, difficulty, others,
  'id,question,count_cases,count_solutions,difficulty,others' as layout from n""")
def _(t: Tables) -> DataFrame:
    return _with_layout(N.split_corpus(W.corpus(t))[0])


@drill("D6_split_corpus_cases", CASES)
def _(t: Tables) -> DataFrame:
    return N.split_corpus(W.corpus(t))[1]


@drill("D6_split_corpus_solutions", SOLUTIONS)
def _(t: Tables) -> DataFrame:
    return N.split_corpus(W.corpus(t))[2]


@drill("D7_unpivot_solutions", """
select p_partkey as id, 1::bigint as solution_index, p_name as code from part
union all select p_partkey, 2, p_brand from part where p_size % 7 <> 0
union all select p_partkey, 3, p_type from part
union all select p_partkey, 4, cast(p_size as varchar) from part where p_size % 7 <> 0""")
def _(t: Tables) -> DataFrame:
    kept = F.col("p_size") % 7 != 0
    wide = t.part.select(
        F.col("p_partkey").alias("id"),
        F.concat(F.lit("\t "), F.col("p_name"), F.lit(" \n")).alias("solution_1"),
        F.when(kept, F.col("p_brand")).alias("solution_2"),
        F.col("p_type").alias("solution_3"),
        F.when(kept, F.col("p_size").cast("string")).otherwise(" \t\n").alias("solution_4"),
        F.lit("").alias("solution_5"),
    )
    return N.unpivot_solutions(wide, ["id"])


@drill("D8_list_literal_check", """
select doc_id as id, 'text' as kind, doc_id % 3 = 0 as is_list from documents
union all select event_id, 'props', event_id % 2 = 1 from events""")
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("doc_id") % 3 == 0, F.to_json(F.array("text", F.lit("x")))).when(
        (F.col("doc_id") % 3 == 1) & (F.col("doc_id") % 2 == 0), F.concat(F.to_json(F.array("text")), F.lit(" x]"))
    ).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("["), F.col("text"), F.lit("]"))).otherwise(F.col("text"))
    docs = t.documents.select(F.col("doc_id").alias("id"), F.lit("text").alias("kind"), text.alias("cell"))
    wrapped = F.when(F.col("event_id") % 2 == 1, F.concat(F.lit(" ["), F.col("props"), F.lit(", None, 'a']\n"))).otherwise(F.col("props"))
    events = t.events.select(F.col("event_id").alias("id"), F.lit("props").alias("kind"), wrapped.alias("cell"))
    return docs.unionByName(events).select("id", "kind", is_list_literal(F.col("cell")).alias("is_list"))


FLAG_WORDS = ["red", "blue", "hot", "cold", "widget", "bolt", "gear"]


def _flag_replies(t: Tables) -> DataFrame:
    first, last = F.split("p_name", " ")[0], F.split("p_name", " ")[1]
    flag = F.when(F.col("p_size") % 3 == 0, "true").when(F.col("p_size") % 3 == 1, '"yes"').otherwise("false")
    number = F.when(F.col("p_size") % 4 == 0, "null").otherwise(F.col("p_size").cast("string"))
    text = F.concat(
        F.lit('[{"solution_order": 9, "'), first, F.lit('": true, "unheard": true}, {"solution_order": '), number,
        F.lit(', "'), last, F.lit('": '), flag, F.lit(', "'), first, F.lit('": 0}]'),
    )
    return t.part.select(
        F.col("p_partkey").alias("problem_id"),
        F.when(F.col("p_partkey") % 5 == 0, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(F.col("p_partkey") % 11 == 0, "no list").otherwise(text).alias("reply"),
    )


def _flag_check(order: str) -> str:
    number = {"position": ("1", "2", "true"), "field": ("9", "p_size", "p_size % 4 <> 0")}[order]
    name = {"position": "algorithm_order", "field": "solution_order"}[order]
    first = ", ".join(f"w1 = '{w}' as {w}" for w in FLAG_WORDS)
    second = ", ".join(f"w2 = '{w}' and p_size % 3 <> 2 as {w}" for w in FLAG_WORDS)
    total = " + ".join(f"cast({w} as bigint)" for w in FLAG_WORDS)
    return f"""
with p as (select p_partkey as problem_id, p_size, split_part(p_name, ' ', 1) as w1, split_part(p_name, ' ', 2) as w2
  from part where p_partkey % 5 = 0 or p_partkey % 11 <> 0),
f as (select problem_id, {number[0]}::bigint as {name}, {first} from p
  union all select problem_id, {number[1]}::bigint, {second} from p where {number[2]})
select *, {total} as count from f"""


@drill("D9_flag_vector_position", _flag_check("position"))
def _(t: Tables) -> DataFrame:
    return N.flag_vector(_flag_replies(t), "problem_id", "reply", FLAG_WORDS)


@drill("D9_flag_vector_field", _flag_check("field"))
def _(t: Tables) -> DataFrame:
    return N.flag_vector(_flag_replies(t), "problem_id", "reply", FLAG_WORDS, "field", "solution_order")


def _totals_check(where: str = "true") -> str:
    return f"""{COUNTED}
select count(*) as problems, coalesce(sum(count_input), 0)::bigint as inputs, coalesce(sum(count_output), 0)::bigint as outputs,
  count(*) filter (where not count_same) as unequal,
  count(*) filter (where not count_same) / count(*) as unequal_share from n where {where}"""


def _describe_check(table: str, col: str, where: str = "true") -> str:
    return f"""
select avg({col}::double) as mean, min({col})::double as min, quantile_cont({col}::double, 0.25) as q1,
  quantile_cont({col}::double, 0.5) as median, quantile_cont({col}::double, 0.75) as q3, max({col})::double as max
from {table} where {where}"""


@drill("F1_corpus_totals", _totals_check())
def _(t: Tables) -> DataFrame:
    return P.corpus_totals(N.count_io(W.corpus(t)))


@drill("F2_describe_column", COUNTED + _describe_check("n", "count_input"))
def _(t: Tables) -> DataFrame:
    return P.describe(N.count_io(W.corpus(t)), "count_input")


@drill("F2_describe_column_lines", _describe_check("lineitem", "l_quantity"))
def _(t: Tables) -> DataFrame:
    return P.describe(t.lineitem, "l_quantity")


@drill("F3_range_filter_totals", _totals_check("count_input between 5 and 40"))
def _(t: Tables) -> DataFrame:
    return P.corpus_totals(P.range_filter(N.count_io(W.corpus(t)), "count_input", 5, 40))


@drill("F3_range_filter_stats", _describe_check("lineitem", "l_quantity", "l_quantity between 10 and 33"))
def _(t: Tables) -> DataFrame:
    return P.describe(P.range_filter(t.lineitem, "l_quantity", 10, 33), "l_quantity")


@drill("F3_range_filter_empty", _describe_check("lineitem", "l_quantity", "l_quantity between 900 and 990"))
def _(t: Tables) -> DataFrame:
    return P.describe(P.range_filter(t.lineitem, "l_quantity", 900, 990), "l_quantity")


@drill("F4_histogram", f"""{COUNTED}, lo as (select min(count_input) as low from n)
select (count_input - low) // 10 as bin_no, (min(low) + 10 * ((count_input - low) // 10))::double as bin_start,
  (min(low) + 10 * ((count_input - low) // 10) + 10)::double as bin_end, count(*) as n
from n, lo group by (count_input - low) // 10""")
def _(t: Tables) -> DataFrame:
    return P.histogram(N.count_io(W.corpus(t)), "count_input", 10)


@drill("F4_histogram_lines", """
with lo as (select min(l_quantity) as low from lineitem)
select floor((l_quantity - low) / 7)::bigint as bin_no, min(low) + 7 * floor((l_quantity - low) / 7) as bin_start,
  min(low) + 7 * floor((l_quantity - low) / 7) + 7 as bin_end, count(*) as n
from lineitem, lo group by floor((l_quantity - low) / 7)""")
def _(t: Tables) -> DataFrame:
    return P.histogram(t.lineitem, "l_quantity", 7)
