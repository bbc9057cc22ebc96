"""Chat formatting: tool calls linked to their results, ordered, validated and written canonically.

DataFrame functions only. Calls and results meet by a hash join on conversation and call id. Calls
are brought into an order in which each follows the calls it depends on: the given order where it
already is one, else by depth, found in rounds over the few conversations that need it. Arguments are
checked against the tool's fields, and events are written as JSON with sorted keys and no blanks.

No conversation is gathered into one row: a record is one event, and ``conv_id, depth, place``
put the events of a conversation in order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetable.llm.common import stored
from casetable.operators.joins import join_spread
from casetable.session import settle

#: Violations are named ``<rule>:<field>``.
RULES = ("required", "unknown", "type", "choice", "range")
_KEY = ["conv_id", "call_id"]


def tool_fields(schemas: DataFrame) -> DataFrame:
    """One row per tool from rows ``name, field, kind, required, choices, least, most``.

    ``kind`` is one of string, integer, number, boolean, object, array; a null rule does not apply.
    """
    rule = F.struct(
        "kind", "required", F.col("choices").cast("array<string>").alias("choices"),
        F.col("least").cast("double").alias("least"), F.col("most").cast("double").alias("most"),
    )
    # bounded: the fields of one tool
    return schemas.where("field is not null").groupBy("name").agg(
        F.map_from_entries(F.collect_list(F.struct("field", rule))).alias("fields")
    )


def kind_of(value: Column) -> Column:
    """The JSON type of a variant; a number without a fraction is an integer."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    return (
        F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array")
        .when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(number == F.floor(number), "integer").otherwise("number")
    )


def violations(fields: Column, arguments: Column) -> Column:
    """The broken rules of an argument map ``field -> variant``, sorted."""

    def broken(entry: Column) -> Column:
        name, value = entry["key"], entry["value"]
        rule = F.try_element_at(fields, name)
        kind, number, text = kind_of(value), F.try_variant_get(value, "$", "double"), F.try_variant_get(value, "$", "string")
        fits = (kind == rule["kind"]) | ((kind == "integer") & (rule["kind"] == "number"))
        outside = F.coalesce(number < rule["least"], F.lit(False)) | F.coalesce(number > rule["most"], F.lit(False))
        return F.when(rule.isNull(), F.concat(F.lit("unknown:"), name)).when(
            ~F.coalesce(fits, F.lit(True)), F.concat(F.lit("type:"), name)
        ).when(
            F.coalesce(~F.array_contains(rule["choices"], text), F.lit(False)), F.concat(F.lit("choice:"), name)
        ).when(kind.isin("integer", "number") & outside, F.concat(F.lit("range:"), name))

    wrong = F.filter(F.transform(F.map_entries(arguments), broken), lambda x: x.isNotNull())
    needed = F.filter(
        F.map_entries(fields),
        lambda e: F.coalesce(e["value"]["required"], F.lit(False)) & ~F.map_contains_key(arguments, e["key"]),
    )
    return F.array_sort(F.concat(wrong, F.transform(needed, lambda e: F.concat(F.lit("required:"), e["key"]))))


def call_depths(calls: DataFrame) -> DataFrame:
    """``conv_id, call_id, depth`` for calls of conversations whose given order breaks a dependency.

    Depth 0 depends on no call of the conversation; a call on or behind a cycle has a null depth. A
    round costs a join over what is left; there are as many rounds as the deepest such chain.
    """
    asked = calls.select("conv_id", "call_id", "place", F.explode(F.array_distinct("depends_on")).alias("on"))
    on = calls.select("conv_id", F.col("call_id").alias("on"), F.col("place").alias("on_place"))
    links = settle(asked.join(on, ["conv_id", "on"]))
    late = links.where("on_place >= place").select("conv_id").distinct()
    left = settle(calls.join(late, "conv_id", "left_semi").select(*_KEY))
    edges = settle(links.join(late, "conv_id", "left_semi").select(*_KEY, "on"))
    found = []
    while not left.isEmpty():
        ready = settle(left.join(edges.select(*_KEY), _KEY, "left_anti"))
        if ready.isEmpty():  # only cycles and what hangs on them are left
            found.append(left.withColumn("depth", F.lit(None).cast("int")))
            break
        found.append(ready.withColumn("depth", F.lit(len(found))))
        left = settle(left.join(ready, _KEY, "left_anti"))
        done = ready.select("conv_id", F.col("call_id").alias("on"))
        edges = settle(edges.join(done, ["conv_id", "on"], "left_anti").select(*_KEY, "on"))
    return reduce(DataFrame.unionByName, found) if found else left.withColumn("depth", F.lit(0))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row per call and per result that answers none.

    ``calls``: ``conv_id, call_id, place, name, arguments`` (JSON text), ``depends_on`` (call ids);
    ``results``: ``conv_id, call_id, place, content``. Returns ``conv_id, call_id, place, depth, name,
    status, violations, record``.

    Of calls with one id in a conversation the first by place counts, the rest are ``repeated``; of
    results with one id the first counts. ``status``: ``answered`` or ``open`` for good calls, ``invalid``
    for broken rules, ``unreadable`` for arguments that are no JSON object, ``unknown_tool``,
    ``orphan`` for a result without a call. Rows with a null conversation or call id link with nothing;
    dependencies on calls that do not exist are passed over. Empty tables give no rows of their
    kind. Other columns are not looked at.
    """
    calls = calls.select(
        "conv_id", "call_id", "place", "name", "arguments", F.coalesce("depends_on", F.array().cast("array<string>")).alias("depends_on")
    )
    linked = calls.where("conv_id is not null and call_id is not null")
    loose = calls.where("conv_id is null or call_id is null").withColumn("depth", F.lit(0)).withColumn("answer", F.lit(None).cast("string"))
    parts = ["place", "name", "arguments", "depends_on"]
    counted = linked.groupBy(*_KEY, *parts).agg(F.count("*").alias("n"))
    least = counted.groupBy(*_KEY).agg(F.min(F.struct(*parts)).alias("first"))
    first = stored(least.select(*_KEY, "first.*"), "calls")
    more = F.col("n") - F.struct(*parts).eqNullSafe(F.col("first")).cast("long")
    again = join_spread(counted, least, _KEY).withColumn("n", more).where("n > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), "n"))
    ).select(*_KEY, *parts)
    answers = results.where("conv_id is not null and call_id is not null").groupBy(*_KEY).agg(
        F.min(F.struct("place", "content")).alias("first")
    )
    depths = call_depths(first.select(*_KEY, "place", "depends_on"))
    placed = first.join(depths.withColumn("moved", F.lit(True)), _KEY, "left").withColumn(
        "depth", F.when(F.col("moved"), F.col("depth")).otherwise(0)
    ).drop("moved")
    met = placed.join(answers.select(*_KEY, F.coalesce("first.content", F.lit("")).alias("answer")), _KEY, "left")
    rows = met.withColumn("status", F.lit(None).cast("string")).unionByName(
        loose.withColumn("status", F.lit(None).cast("string"))
    ).unionByName(
        again.withColumns({"depth": F.lit(0), "answer": F.lit(None).cast("string"), "status": F.lit("repeated")})
    )

    read = F.try_parse_json(F.col("arguments"))
    rows = join_spread(rows.withColumn("variant", read), tool_fields(schemas), ["name"], "left")
    given = F.try_variant_get("variant", "$", "map<string,variant>")
    rows = rows.withColumn("given", F.when(F.schema_of_variant("variant").startswith("OBJECT"), given))
    broken = F.when(F.col("given").isNotNull() & F.col("fields").isNotNull(), violations(F.col("fields"), F.col("given")))
    rows = rows.withColumn("violations", F.coalesce(broken, F.array().cast("array<string>")))
    status = F.coalesce(
        "status",
        F.when(F.col("given").isNull(), "unreadable").when(F.col("fields").isNull(), "unknown_tool")
        .when(F.size("violations") > 0, "invalid").when(F.col("answer").isNull(), "open").otherwise("answered"),
    )
    record = canonical_record(F.col("call_id"), F.col("name"), F.col("variant"), F.col("answer"))
    out = rows.select("conv_id", "call_id", "place", "depth", "name", status.alias("status"), "violations", record.alias("record"))
    orphans = join_spread(results, first.select(*_KEY), _KEY, "left_anti").select(
        "conv_id", "call_id", "place", F.lit(0).alias("depth"), F.lit(None).cast("string").alias("name"),
        F.lit("orphan").alias("status"), F.array().cast("array<string>").alias("violations"),
        canonical_record(F.col("call_id"), F.lit(None).cast("string"), F.parse_json(F.lit("null")), F.col("content")).alias("record"),
    )
    return out.unionByName(orphans)


def canonical_record(call_id: Column, name: Column, arguments: Column, result: Column) -> Column:
    """Canonical JSON of an event: keys sorted at every level, no blanks, absent parts as null."""
    null = F.lit("null")
    return F.concat(
        F.lit('{"arguments":'), F.coalesce(F.to_json(arguments), null),
        F.lit(',"call_id":'), json_text(call_id), F.lit(',"name":'), json_text(name),
        F.lit(',"result":'), json_text(result), F.lit("}"),
    )


def json_text(value: Column) -> Column:
    """A JSON string, or null."""
    return F.regexp_replace(F.to_json(F.array(value)), r"^\[|\]$", "")
