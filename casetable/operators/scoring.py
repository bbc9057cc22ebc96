"""From reply text to score rows, recheck rows and contract checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetable import vocab as V
from casetable.functions.json_cells import strip_fence, truthy, variant_kind, whole_json
from casetable.functions.score_sets import first_highest, score_vector
from casetable.functions.text import (
    equals_number, first_match_label, join_list, join_pairs, line_count, solution_key,
)

# Text fields of a reply item.
TEXT_FIELDS = [
    "solution_summary", "code_evidence", "time_complexity_reasoning", "classification_reason",
    "rejected_candidates", "uncertain_points", "compared_with_other_solutions",
]
LIST_FIELDS = ["secondary_algorithms", "composite_algorithm"]


def recheck_field(tag: str) -> str:
    return f"{tag.lower()}_recheck"


def item_schema(broad: Mapping[str, Sequence[str]]) -> str:
    """Scalars stay text, so that numbers written as text and text in place of numbers survive."""
    block = "struct<candidate_scores:map<string,string>,recheck_decision:string,recheck_reason:string>"
    fields = [
        "solution_index:string", "algorithm_scores:map<string,string>", "primary_algorithm:string",
        *[f"{f}:array<string>" for f in LIST_FIELDS], "is_composite:string",
        "top_3_algorithms:array<struct<tag:string,score:string>>", "confidence:string",
        *[f"{f}:string" for f in TEXT_FIELDS],
        *[f"`{recheck_field(t)}`:{block}" for t in broad],
    ]
    return f"struct<{','.join(fields)}>"


def parse_items(
    replies: DataFrame, broad: Mapping[str, Sequence[str]] = V.BROAD_CANDIDATES,
    chunk: str = "chunk_id", reply: str = "reply", asked: str | None = None,
) -> DataFrame:
    """One row per reply item, ``item_no`` from 0. Where ``asked`` is 1 the reply may be the bare item itself."""
    item, text = item_schema(broad), strip_fence(F.col(reply))
    items = whole_json(text, f"struct<solutions:array<{item}>>", {})["solutions"]
    if asked is not None:
        items = F.when(F.col(asked) == 1, F.coalesce(items, F.array(whole_json(text, item, {})))).otherwise(items)
    return replies.select(chunk, F.posexplode(items).alias("item_no", "_item")).where(F.col("_item").isNotNull()).select(
        chunk, "item_no", "_item.*"
    )


def _or(col: str, default: str) -> Column:
    return F.coalesce(F.col(col), F.lit(default))


def score_rows(
    rows: DataFrame, tags: Sequence[str] = V.SCORE_TAGS,
    language_rules: Sequence[tuple[str, Sequence[str]]] = tuple(V.LANGUAGE_RULES),
) -> DataFrame:
    """The wide score row of each matched reply item.

    ``rows`` holds problem columns, ``solution_index``, ``code`` and the parsed item. Columns
    of the problem that are absent are left out; tag scores go into the array ``scores``.
    """
    scored = rows.withColumn("scores", score_vector(F.col("algorithm_scores"), tags))
    by_name = F.map_from_arrays(F.array(*[F.lit(t) for t in tags]), F.col("scores"))
    derived = {
        "problem_solution_key": solution_key(F.col("id"), F.col("solution_index")),
        "solution_column": F.concat(F.lit("solution_"), F.col("solution_index").cast("string")),
        "solution_index": F.col("solution_index"),
        "is_selected_solution": equals_number(F.col("solution_index"), F.col("selected_submission_index")),
        "solution_valid": F.lit(True),
        "solution_language": first_match_label(F.col("code"), language_rules),
        "solution_length": line_count(F.col("code")),
        "primary_algorithm": _or("primary_algorithm", "UNKNOWN"),
        "primary_score": F.coalesce(
            F.try_element_at(by_name, _or("primary_algorithm", "")), F.lit(0).cast("bigint")
        ),
        "secondary_algorithms": join_list(F.col("secondary_algorithms")),
        "is_composite": truthy(F.col("is_composite")),
        "composite_algorithm": join_list(F.col("composite_algorithm"), empty="NONE"),
        "top_3_algorithms": join_pairs(F.col("top_3_algorithms")),
        "confidence": _or("confidence", "LOW"),
        **{f: _or(f, "") for f in TEXT_FIELDS},
    }
    layout = ["problem_solution_key"] + [c for c in V.PROBLEM_COLUMNS if c in rows.columns]
    layout += [*V.SOLUTION_COLUMNS, "scores", *V.SUMMARY_COLUMNS]
    return scored.select(*[derived[c].alias(c) if c in derived else F.col(c) for c in layout])


def recheck_rows(
    rows: DataFrame, tags: Sequence[str] = V.SCORE_TAGS,
    broad: Mapping[str, Sequence[str]] = V.BROAD_CANDIDATES, floor: int = V.RECHECK_SCORE,
) -> DataFrame:
    """Per item and qualifying broad tag: best candidate, decision, and the candidates' scores.

    A broad tag qualifies as the primary tag or by its own score. Row-local: the broad tags
    are laid out as an array and exploded after the filter.
    """
    scored = rows.withColumn("scores", score_vector(F.col("algorithm_scores"), tags))
    place = {t: i for i, t in enumerate(tags)}

    def block(tag: str, candidates: Sequence[str]) -> Column:
        told = F.col(f"`{recheck_field(tag)}`")
        own = F.get(F.col("scores"), place[tag]) if tag in place else F.lit(0).cast("bigint")
        return F.struct(
            F.lit(tag).alias("source_broad_tag"),
            own.alias("source_broad_score"),
            first_highest(score_vector(told["candidate_scores"], candidates), candidates).alias("best"),
            told["candidate_scores"].alias("given"),
            F.array(*[F.lit(c) for c in candidates]).alias("allowed"),
            F.coalesce(told["recheck_decision"], F.lit("KEEP_ORIGINAL")).alias("recheck_decision"),
            F.coalesce(told["recheck_reason"], F.lit("")).alias("recheck_reason"),
        )

    blocks = F.filter(
        F.array(*[block(t, c) for t, c in broad.items()]),
        lambda b: (b["source_broad_score"] >= floor)
        | F.coalesce(F.col("primary_algorithm") == b["source_broad_tag"], F.lit(False)),
    )
    lead = [c for c in ("title",) if c in rows.columns]
    hits = scored.select("id", *lead, "solution_index", F.explode(blocks).alias("_b"))
    given = [
        F.when(F.array_contains("_b.allowed", t), F.try_element_at(F.col("_b.given"), F.lit(t))).alias(t)
        for t in V.recheck_tags(dict(broad))
    ]
    return hits.select(
        solution_key(F.col("id"), F.col("solution_index")).alias("problem_solution_key"),
        "id", *lead,
        F.concat(F.lit("solution_"), F.col("solution_index").cast("string")).alias("solution_column"),
        "solution_index", "_b.source_broad_tag", "_b.source_broad_score", *given,
        F.col("_b.best.tag").alias("recheck_best_candidate"),
        F.greatest(F.col("_b.best.score"), F.lit(0).cast("bigint")).alias("recheck_best_score"),
        "_b.recheck_decision", "_b.recheck_reason",
    )


def contract_check(
    replies: DataFrame, status: DataFrame, tags: Sequence[str] = V.SCORE_TAGS,
    broad: Mapping[str, Sequence[str]] = V.BROAD_CANDIDATES, reply: str = "reply", combination: int = 2,
) -> DataFrame:
    """Violations per rule of the reply contract, rules without any included.

    Replies are read as variants, which keep the type that each value was written with: a number as text is
    no number here. ``unreadable`` and ``reply_length`` count replies, the other rules the items that break
    them at least once. One pass over the replies.
    """
    items = replies.withColumn("_reply", F.try_parse_json(strip_fence(F.col(reply))))
    listed = F.try_variant_get("_reply", "$.solutions", "array<variant>")
    read = items.select(
        F.when(F.col("_reply").isNull() | listed.isNull(), 1).otherwise(0).alias("_bad"), F.posexplode_outer(listed).alias("_at", "_item")
    ).select("_bad", F.coalesce("_at", F.lit(0)).alias("_at"), F.try_variant_get("_item", "$", "map<string,variant>").alias("f"))

    def field(name: str) -> Column:
        return F.try_element_at("f", F.lit(name))

    def as_list(value: Column) -> Column:
        return F.coalesce(F.try_variant_get(value, "$", "array<variant>"), F.array().cast("array<variant>"))

    def as_map(value: Column) -> Column:
        return F.try_variant_get(value, "$", "map<string,variant>")

    def text(value: Column) -> Column:
        return F.when(variant_kind(value) == "text", F.try_variant_get(value, "$", "string"))

    allowed = F.array(*[F.lit(t) for t in tags])

    def foreign(values: Column) -> Column:
        """Texts that are no tags."""
        return F.size(F.array_except(F.filter(F.transform(values, text), lambda t: t.isNotNull()), allowed)) > 0

    def lacking(value: Column, names: Sequence[str]) -> Column:
        return value.isNotNull() & (F.size(F.array_except(F.array(*[F.lit(n) for n in names]), F.map_keys(value))) > 0)

    def not_a_number(v: Column) -> Column:
        return ~variant_kind(v).isin("whole", "fraction")

    def fraction(v: Column) -> Column:
        return variant_kind(v) == "fraction"

    def outside(v: Column) -> Column:
        return ~not_a_number(v) & ~F.try_variant_get(v, "$", "double").between(0, 100)

    def any_value(value: Column, rule) -> Column:
        return F.coalesce(F.exists(F.map_values(value), rule), F.lit(False))

    kinds = {
        "solution_index": "whole", "algorithm_scores": "object", "primary_algorithm": "text", "is_composite": "flag",
        "top_3_algorithms": "list", "confidence": "text", **{f: "list" for f in LIST_FIELDS}, **{f: "text" for f in TEXT_FIELDS},
        **{recheck_field(t): "object" for t in broad},
    }
    missing, mistyped = F.lit(False), F.lit(False)
    for name, kind in kinds.items():
        missing = missing | field(name).isNull()
        mistyped = mistyped | F.coalesce(variant_kind(field(name)) != kind, F.lit(False))
    scores, tops = as_map(field("algorithm_scores")), as_list(field("top_3_algorithms"))
    blocks = {t: as_map(field(recheck_field(t))) for t in broad}
    given = {t: as_map(F.try_element_at(b, F.lit("candidate_scores"))) for t, b in blocks.items()}

    def any_block(rule) -> Column:
        out = F.lit(False)
        for t in broad:
            out = out | F.coalesce(rule(t), F.lit(False))
        return out

    def listed_in(value: Column, choices: Sequence[str]) -> Column:
        return F.coalesce(~text(value).isin(*choices), F.lit(False))

    def score_of(entry: Column) -> Column:
        return F.try_variant_get(entry, "$.score", "variant")

    def candidates(rule):
        def held(t: str) -> Column:
            return F.exists(F.map_entries(given[t]), lambda e: e["key"].isin(*broad[t]) & rule(e["value"]))

        return any_block(held)

    item_rules = {
        "field_missing": missing,
        "field_type": mistyped,
        "score_missing": lacking(scores, tags),
        "score_type": any_value(scores, not_a_number),
        "score_whole": any_value(scores, fraction),
        "score_range": any_value(scores, outside),
        "tag_vocabulary": (F.size(F.array_except(F.coalesce(F.map_keys(scores), F.array().cast("array<string>")), allowed)) > 0)
        | foreign(F.array(field("primary_algorithm"))) | foreign(as_list(field("secondary_algorithms")))
        | foreign(as_list(field("composite_algorithm"))),
        "top_three_size": F.size(tops) != 3,
        "top_three_tag": foreign(F.transform(tops, lambda e: F.try_variant_get(e, "$.tag", "variant"))),
        "top_three_score": F.exists(tops, lambda e: F.coalesce(not_a_number(score_of(e)) | fraction(score_of(e)) | outside(score_of(e)), F.lit(True))),
        "confidence_list": listed_in(field("confidence"), V.CONFIDENCE_LEVELS),
        "combination_size": F.size(as_list(field("composite_algorithm"))) > combination,
        "decision_list": any_block(lambda t: listed_in(F.try_element_at(blocks[t], F.lit("recheck_decision")), V.DECISIONS)),
        "candidate_missing": any_block(lambda t: blocks[t].isNotNull() & F.coalesce(lacking(given[t], broad[t]), F.lit(True))),
        "candidate_type": candidates(not_a_number),
        "candidate_whole": candidates(fraction),
        "candidate_range": candidates(outside),
        "reason_missing": any_block(lambda t: blocks[t].isNotNull() & F.try_element_at(blocks[t], F.lit("recheck_reason")).isNull()),
    }

    def counted(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
        one = df.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in rules.items()])
        pairs = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])
        return one.select(F.inline(pairs))

    here = F.col("f").isNotNull()
    rules = {"unreadable": (F.col("_bad") == 1) & (F.col("_at") == 0), **{n: here & c for n, c in item_rules.items()}}
    return counted(read, rules).unionByName(counted(status, {"reply_length": ~F.col("ok")}))
