"""JSON, or near-JSON list and dict literals, held in text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from casetable.functions.text import let, strip_text

IO_SCHEMA = "struct<inputs:array<string>,outputs:array<string>>"
LIST_SCHEMA = "array<string>"
FLAGS_SCHEMA = "array<map<string,string>>"

# cells may hold numbers of very many digits, which are kept as text
LONG_CELLS = {"maxNumLen": str(2**31 - 1), "maxStringLen": str(2**31 - 1)}

# Fixed value: a Markdown fence around a reply.
FENCE = r"(?md)^```(?:json)?\s*|\s*```$"


def _as_json(col: Column) -> Column:
    """Bare literal names as JSON names; single quotes are read by the parser itself."""
    for old, new in (("None", "null"), ("True", "true"), ("False", "false")):
        col = F.regexp_replace(col, rf"(?<=[\[,:\s]){old}(?=\s*[\],}}])", new)
    return col


def whole_json(text: Column, schema: str, options=LONG_CELLS, strict: bool = False) -> Column:
    """The value of a text that is JSON from its first character to its last, else null.

    Spark stops reading behind the first value and keeps what it read before an error; as a part of
    a larger object the value only counts where what follows it is reached. With ``strict`` a
    part that does not have its declared type makes the whole text unreadable.
    """
    kind = f"struct<v:{schema},end:int" + (",_corrupt_record:string>" if strict else ">")
    read = F.from_json(F.concat(F.lit('{"v":'), text, F.lit(',"end":1}')), kind, options)

    def value(x: Column) -> Column:
        reached = x["end"].isNotNull()
        return F.when(reached & x["_corrupt_record"].isNull() if strict else reached, x["v"])

    return let(read, value)


def parse_as(col: Column, schema: str, opener: str, empty=lambda x: x.isNull()) -> Column:
    """The value of a JSON cell; a literal with None, True or False is tried where that is ``empty``.

    Text that does not start with ``opener`` is not parsed. The value is bound once: reading
    its fields one by one would parse the cell once per field.
    """
    text = strip_text(col)
    second = whole_json(_as_json(text), schema, strict=True)
    parsed = let(whole_json(text, schema, strict=True), lambda x: F.when(empty(x), second).otherwise(x))
    return F.when(text.startswith(opener), parsed)


def parse_io(col: Column) -> Column:
    """``inputs`` and ``outputs`` as text lists; both null when the cell is unreadable."""
    return parse_as(col, IO_SCHEMA, "{", lambda x: x["inputs"].isNull() & x["outputs"].isNull())


def parse_list(col: Column) -> Column:
    return parse_as(col, LIST_SCHEMA, "[")


def is_list_literal(col: Column) -> Column:
    text = strip_text(col)
    return F.coalesce(
        text.startswith("[") & text.endswith("]") & parse_list(col).isNotNull(), F.lit(False)
    )


def strip_fence(col: Column) -> Column:
    return F.regexp_replace(strip_text(col), FENCE, "")


def size_or_zero(col: Column) -> Column:
    return F.coalesce(F.size(col), F.lit(0)).cast("bigint")


def truthy(col: Column) -> Column:
    """A loosely typed flag as read from a string map: absent, null, false, 0 and empty are false."""
    text = F.lower(strip_text(col))
    return ~F.coalesce(text, F.lit("")).isin("", "false", "0", "0.0", "null", "none", "[]", "{}")


def variant_kind(value: Column) -> Column:
    """What a variant was written as: object, list, text, flag, null, whole or fraction; null for none.

    ``whole`` and ``fraction`` tell numbers apart by their value, so 5.0 is whole.
    """

    def kind(v: Column) -> Column:
        name = F.schema_of_variant(v)
        number = F.try_variant_get(v, "$", "double")
        return (
            F.when(v.isNull(), F.lit(None).cast("string"))
            .when(name.startswith("OBJECT"), "object").when(name.startswith("ARRAY"), "list").when(name == "STRING", "text")
            .when(name == "BOOLEAN", "flag").when(name == "VOID", "null")
            .when(number == F.floor(number), "whole").otherwise("fraction")
        )

    return let(value, kind)
