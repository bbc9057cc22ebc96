"""Exact dedup by deterministic block naming, with DataFrame functions only.

A text is cut into blocks of a fixed number of characters. Distinct blocks are sorted and get
their place in that order as an integer name; then adjacent names are paired, distinct pairs
are sorted and named in turn, until one name per text is left. Two texts of equal length in
blocks have the same last name exactly if they are equal.

Sorting whole blocks would move the text several times. Blocks are therefore sorted by a
64-bit key, and the one place the text is moved to, already reduced to distinct blocks per
task, proves that no two different blocks share a key. If some do, the keys are widened by
a further 64 bits and proven again, so names never rest on luck.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetable.llm.common import stored
from casetable.operators.joins import join_spread
from casetable.operators.keys import assign_ids
from casetable.session import settle

#: Runs of these become one space before texts are compared.
SPACE_RUN = r"[\x20\x09-\x0D]+"
BLOCK_CHARS = 32_768
_NONE = -1  # stands beside a last name without a neighbour


def block_key(block: Column, part: int) -> Column:
    """The ``part``-th 64 bits of the key by which blocks are sorted."""
    return F.xxhash64(block) if part == 0 else F.xxhash64(F.lit(f"part {part}"), block)


def one_space(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE_RUN, " ")


def cut_blocks(text: Column, chars: int) -> Column:
    """Blocks of ``chars`` characters, the last one shorter; an empty text is one empty block."""
    return F.when(F.length(text) <= chars, F.array(text)).otherwise(
        F.regexp_extract_all(text, F.lit(f"(?s).{{1,{chars}}}"), F.lit(0))
    )


def _told_apart(texts: DataFrame, chars: int, key: Callable[[Column, int], Column], width: int) -> DataFrame | None:
    """The distinct keys of ``width`` parts, or None if two different blocks share one."""
    block = F.col("block")
    distinct = (
        texts.select(F.explode(cut_blocks(F.col("norm"), chars)).alias("block"))
        .select(F.struct(*[key(block, i).alias(f"k{i}") for i in range(width)]).alias("key"), "block")
        .distinct()
    )
    keys = settle(distinct.groupBy("key").agg(F.count(F.lit(1)).alias("n_blocks")))
    return keys.select("key") if keys.where("n_blocks > 1").isEmpty() else None


def text_names(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block_chars: int = BLOCK_CHARS,
    key: Callable[[Column, int], Column] = block_key,
) -> DataFrame:
    """One row per input row: ``row``, ``doc_id``, ``text_sha256``, and the identity (``level``, ``name``).

    Rows are told apart by ``row``, so ids may be null or repeated.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), one_space(F.col(text_col)).alias("norm"))
    width = 1
    while (keys := _told_apart(texts, block_chars, key, width)) is None:
        width += 1

    def parts(block: Column) -> Column:
        return F.struct(*[key(block, i).alias(f"k{i}") for i in range(width)])

    rows = stored(
        texts.select(
            F.monotonically_increasing_id().alias("row"), "doc_id", F.sha2("norm", 256).alias("text_sha256"),
            F.transform(cut_blocks(F.col("norm"), block_chars), parts).alias("keys"),
        ),
        "blocks",
    )
    names = assign_ids(keys, ["key"], "name")
    placed = rows.select("row", F.size("keys").cast("bigint").alias("left"), F.posexplode("keys").alias("pos", "key"))
    named = placed.join(names, "key").select("row", "left", F.col("pos").cast("bigint").alias("pos"), "name")
    most = rows.agg(F.max(F.size("keys"))).first()[0] or 0

    done, level = named.where("left = 1").select("row", F.lit(0).alias("level"), "name"), 0
    if most > 1:
        named = settle(named.where("left > 1"))
    while most > 1:
        most, level = -(-most // 2), level + 1
        even = F.col("pos") % 2 == 0
        pairs = named.groupBy("row", "left", F.floor(F.col("pos") / 2).alias("pair")).agg(
            F.max(F.when(even, F.col("name"))).alias("first"),
            F.coalesce(F.max(F.when(~even, F.col("name"))), F.lit(_NONE)).alias("second"),
        )
        pair_names = assign_ids(pairs.select("first", "second").distinct(), ["first", "second"], "name")
        named = settle(
            pairs.join(pair_names, ["first", "second"]).select(
                "row", F.ceil(F.col("left") / 2).alias("left"), F.col("pair").alias("pos"), "name"
            )
        )
        done = done.unionByName(named.where("left = 1").select("row", F.lit(level).alias("level"), "name"))
        named = named.where("left > 1")
    return rows.select("row", "doc_id", "text_sha256").join(done, "row")


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, block_chars: int = BLOCK_CHARS,
    key: Callable[[Column, int], Column] = block_key,
) -> DataFrame:
    """Each row with the class of its text: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A null text counts as empty, and white space as one space. Of equal texts the row with the
    smallest id stays; a null id comes after all others, and of rows that share id and text one
    stays, whichever is read first. An empty table gives no rows. Other columns are not looked at.
    """
    named = text_names(docs, id_col, text_col, block_chars=block_chars, key=key)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "row"))
    groups = named.groupBy("level", "name").agg(
        first.alias("_first"), F.count(F.lit(1)).alias("group_size")
    )
    return join_spread(named, groups, ["level", "name"]).select(
        "doc_id",
        F.col("_first.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("_first.row")).alias("kept"),
        "text_sha256",
    )
