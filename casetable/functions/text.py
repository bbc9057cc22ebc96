"""Column expressions over text cells."""

from __future__ import annotations

import re
import zlib
from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Everything a full strip removes: Unicode blanks, tabs and line ends.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
MAX_EXACT = 9.2e18


def let(value: Column, body) -> Column:
    """Bind a value once and use it several times inside one expression."""
    return F.transform(F.array(value), body)[0]


def strip_text(col: Column) -> Column:
    return F.btrim(col, F.lit(BLANKS))


def is_blank(col: Column) -> Column:
    return col.isNull() | (strip_text(col) == "")


def blank_if_null(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def number_or_null(col: Column) -> Column:
    """Plain decimal text as a double; anything else, and anything too big for a long, is null."""
    text = strip_text(col.cast("string"))
    value = F.when(text.rlike(NUMBER), text.try_cast("double"))
    return F.when(F.abs(value) < MAX_EXACT, value)


def canonical_id(col: Column) -> Column:
    """Ids read as text: ``12`` and ``12.0`` are 12, other text is null."""
    text = strip_text(col.cast("string"))
    whole = F.regexp_extract(text, r"^([+-]?\d+)(\.0*)?$", 1).try_cast("bigint")
    return F.coalesce(whole, number_or_null(text).cast("bigint"))


def loose_int(col: Column) -> Column:
    """A loosely typed score as a whole number: cut to the integer part, true is 1, the rest 0."""
    text = F.lower(strip_text(col))
    return F.coalesce(
        F.when(text == "true", F.lit(1).cast("bigint")),
        text.try_cast("bigint"),
        number_or_null(text).cast("bigint"),
        F.lit(0).cast("bigint"),
    )


def has_all_digits(col: Column) -> Column:
    return F.coalesce(col.cast("string").rlike(r"^[0-9]+\z"), F.lit(False))


def first_match_label(
    col: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str = "UNKNOWN"
) -> Column:
    """The label of the first rule with a word in the text."""
    picked = F.lit(default)
    for label, words in reversed(rules):
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(col, F.lit(word))
        picked = F.when(hit, F.lit(label)).otherwise(picked)
    return picked


def line_count(col: Column) -> Column:
    return (F.length(col) - F.length(F.replace(col, F.lit("\n"), F.lit(""))) + 1).cast("bigint")


def equals_number(index: Column, text: Column) -> Column:
    """Does the index equal the whole number in the text; false when the text is none."""
    value = F.when(strip_text(text.cast("string")).rlike(r"^[+-]?\d+\z"), strip_text(text.cast("string")))
    return F.coalesce(index.cast("bigint") == value.try_cast("bigint"), F.lit(False))


def solution_key(problem: Column, solution: Column) -> Column:
    return F.concat(problem.cast("string"), F.lit("_solution_"), solution.cast("string"))


def join_list(col: Column, sep: str = " | ", empty: str = "") -> Column:
    joined = F.array_join(col, sep, "None")
    return F.when(F.coalesce(F.size(col), F.lit(0)) > 0, joined).otherwise(F.lit(empty))


def join_pairs(col: Column, left: str = "tag", right: str = "score", sep: str = " | ") -> Column:
    """``left:right`` of every struct; a missing part reads ``None``."""

    def pair(x: Column) -> Column:
        return F.concat(
            F.coalesce(x[left].cast("string"), F.lit("None")),
            F.lit(":"),
            F.coalesce(x[right].cast("string"), F.lit("None")),
        )

    return F.coalesce(F.array_join(F.transform(col, pair), sep), F.lit(""))


def contains_word(col: Column, word: str) -> Column:
    return F.coalesce(F.contains(F.lower(col), F.lit(word)), F.lit(False))


def fold_literals(col: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements, one after the other."""
    for old, new in pairs:
        col = F.replace(col, F.lit(old), F.lit(new))
    return col


def _replace_word(old: str, new: str):
    safe, pattern = new.replace("\\", "\\\\").replace("$", "\\$"), rf"(?U)\b{re.escape(old)}\b"

    def body(text: Column) -> Column:
        return F.when(F.contains(text, F.lit(old)), F.regexp_replace(text, pattern, safe)).otherwise(text)

    return body


def closed_words(words: Mapping[str, str]) -> dict[str, str] | None:
    """What each word becomes when all replacements have been made in turn, or None if a key is no single word.

    A replacement may hold words that are replaced later on; these are followed here, once.
    """
    if not all(re.fullmatch(r"\w+", old) for old in words):
        return None
    out, turn = {}, list(words.items())
    for at, (old, new) in enumerate(turn):
        for later, newer in turn[at + 1:]:
            new = re.sub(rf"\b{re.escape(later)}\b", lambda _: newer, new)
        out[old] = new
    return out


def _look_up(closed: Mapping[str, str], word: Column) -> Column:
    """The replacement of a word, or null: by its checksum a word falls to one of many small maps."""
    n = 1 << (2 * len(closed)).bit_length()
    parts: list[list[str]] = [[] for _ in range(n)]
    for old, new in closed.items():
        parts[zlib.crc32(old.encode()) % n] += [old, new]
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    maps = F.array(*[F.create_map(*[F.lit(x) for x in part]) if part else none for part in parts])
    return F.try_element_at(F.get(maps, F.pmod(F.crc32(word), F.lit(n)).cast("int")), word)


def replace_words(col: Column, words: Mapping[str, str]) -> Column:
    """Whole-word replacements, as if made one after the other; word edges follow Unicode letters.

    The text is read once, as runs of word characters and of others, and each word is looked up: the cost
    does not grow with the dictionary. Keys that are no single words are replaced one after the other.
    """
    if not words:
        return col
    closed = closed_words(words)
    if closed is None:
        for old, new in words.items():
            col = let(col, _replace_word(old, new))
        return col
    runs = F.regexp_extract_all(col, F.lit(r"(?U)(\w+|\W+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda w: F.coalesce(_look_up(closed, w), w)), "")


def preview_text(col: Column, n: int = 50) -> Column:
    flat = F.replace(col, F.lit("\n"), F.lit(" "))
    return F.when(F.length(flat) > n, F.concat(F.substring(flat, 1, n), F.lit("..."))).otherwise(flat)


def fill_status(cols: Sequence[Column]) -> Column:
    """``all``, ``none`` or ``partial``: how many of the cells hold text."""
    empty = sum((F.when(is_blank(c.cast("string")), 1).otherwise(0) for c in cols), F.lit(0))
    return F.when(empty == 0, "all").when(empty == len(cols), "none").otherwise("partial")


def tri_state(col: Column) -> Column:
    """TRUE or FALSE from a flag or text, ERROR for everything else and null."""
    text = F.upper(strip_text(col.cast("string")))
    return F.when(text == "TRUE", "TRUE").when(text == "FALSE", "FALSE").otherwise("ERROR")


def error_class(col: Column) -> Column:
    """RATE_LIMIT, JSON, KEY_TIMEOUT or OTHER; null stays null."""
    return (
        F.when(col.isNull(), F.lit(None).cast("string"))
        .when(col.startswith("JSON_DECODE_ERROR"), "JSON")
        .when(col == "KEY_WAIT_TIMEOUT", "KEY_TIMEOUT")
        .when(col.rlike("RESOURCE_EXHAUSTED|429") | F.contains(F.lower(col), F.lit("quota")), "RATE_LIMIT")
        .otherwise("OTHER")
    )


def is_hidden(order: Column, shown: Sequence[int] = (1, 2)) -> Column:
    return ~order.isin(*shown)
