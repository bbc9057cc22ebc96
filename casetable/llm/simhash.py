"""SimHash fingerprints of documents and the search for near ones, with DataFrame functions only.

The terms of a text are its distinct words. Each is hashed to 128 bits, and votes with its weight for
every bit that is set and against every bit that is not; the fingerprint holds the bits that won.
Terms weigh the more the fewer documents hold them, by counts over the whole table in a fixed number
of buckets.

Votes are added two bits to a number: bits ``i`` and ``i + 32`` of half a hash stand far enough
apart that their sums never meet, so 64 sums hold 128 counts. A document's words never leave the task
that reads its text.

Fingerprints within a Hamming radius agree in all but ``radius`` of any blocks that they are cut
into. There is a table for every choice of that many blocks, with these in front; what shares the
front of a table is compared there, in the first table only that two fingerprints share. Spark joins
the tables with themselves and splits a front that many fingerprints share.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetable.llm.common import stored
from casetable.llm.components import components
from casetable.operators.joins import join_spread
from casetable.operators.keys import assign_ids

BITS = 128
#: Buckets in which the documents of a term are counted.
BUCKETS = 1 << 16
#: What lies between words, once lower-cased.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
RADIUS = 3
_TWO_BITS = (1 << 32) + 1
_LOW = (1 << 32) - 1
HASHES = ("f1", "f2")


def terms(text: Column) -> Column:
    """The distinct words of a text; one of them may be empty."""
    return F.array_distinct(F.split(F.lower(text), BETWEEN))


def term_hashes(term: Column) -> tuple[Column, Column]:
    return F.xxhash64(term), F.xxhash64(F.lit("second"), term)


def bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("bucket"), term), F.lit(BUCKETS)).cast("int")


def _weight(docs: int, held_by: Column) -> Column:
    return (F.greatest(F.floor(F.log2(F.lit(float(max(docs, 1))) / held_by)), F.lit(0)) + 1).cast("bigint")


def term_weights(texts: DataFrame, text_col: str = "text") -> tuple[DataFrame, int]:
    """``bucket, weight`` for all buckets with a term, and the weight of any other: 1 and the whole part of log2 of all rows by those that hold it."""
    n = texts.count()
    words = texts.select(F.explode(terms(F.col(text_col))).alias("term")).where("term <> ''")
    held = words.groupBy(bucket(F.col("term")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    return stored(held.select("bucket", _weight(n, F.col("n")).alias("weight")), "term-weights"), max(n, 1).bit_length()


def fingerprints(rows: DataFrame, keys: Sequence[str], weights: tuple[DataFrame, int], text_col: str = "text") -> DataFrame:
    """``f1, f2`` for every key: the fingerprint of its text. Rows of one key must hold one text.

    A text without terms has a fingerprint of no set bits. No key may have terms of more than 2^31 weight.
    """
    table, other = weights
    words = rows.select(*keys, F.explode_outer(terms(F.col(text_col))).alias("term"))
    words = words.withColumn("bucket", bucket(F.col("term")))
    # bounded: one row a bucket
    weighed = words.join(F.broadcast(table), "bucket", "left").select(
        *keys, *[h.alias(n) for h, n in zip(term_hashes(F.col("term")), HASHES)],
        F.when(F.col("term") != "", F.coalesce("weight", F.lit(other).cast("bigint"))).otherwise(0).alias("weight"),
    )
    sums = [
        F.sum(F.shiftrightunsigned(F.col(h), i).bitwiseAND(F.lit(_TWO_BITS)) * F.col("weight")).alias(f"{h}_{i}")
        for h in HASHES for i in range(32)
    ]
    counted = weighed.groupBy(*keys).agg(F.sum("weight").alias("all"), *sums)

    def half(h: str) -> Column:
        out = F.lit(0).cast("bigint")
        for i in range(32):
            both = F.col(f"{h}_{i}")
            for at, votes in ((i, both.bitwiseAND(F.lit(_LOW))), (i + 32, F.shiftrightunsigned(both, 32))):
                bit = (1 << at) - (1 << 64) * (at == 63)
                out = out.bitwiseOR(F.when(2 * votes > F.col("all"), F.lit(bit).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return out

    return counted.select(*keys, *[half(h).alias(h) for h in HASHES])


def distance(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """In how many bits two fingerprints differ."""
    return F.bit_count(a[0].bitwiseXOR(b[0])) + F.bit_count(a[1].bitwiseXOR(b[1]))


def likeness(a: Sequence[Column], b: Sequence[Column]) -> Column:
    return F.lit(1.0) - distance(a, b) / F.lit(float(BITS))


def spelled(f1: Column, f2: Column) -> Column:
    """A fingerprint as 32 hexadecimal digits."""
    return F.lower(F.concat(F.lpad(F.hex(f1), 16, "0"), F.lpad(F.hex(f2), 16, "0")))


def _block(f: Sequence[Column], begin: int, end: int) -> Column:
    """Bits ``begin`` to ``end`` of a fingerprint as a number, counted from the lowest of its first half."""
    parts, at = [], 0
    for h, low in zip(f, (0, 64)):
        a, b = max(begin, low), min(end, low + 64)
        if a < b:
            bits = F.shiftrightunsigned(h, a - low)
            bits = bits if b - a == 64 else bits.bitwiseAND(F.lit((1 << (b - a)) - 1))
            parts.append(F.shiftleft(bits, at))
            at += b - a
    return parts[0] if len(parts) == 1 else parts[0].bitwiseOR(parts[1])


def within_radius(distinct: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """``a1, a2, b1, b2, distance``: every pair of different fingerprints ``f1, f2`` within the radius, once.

    Rows are to be distinct. More ``blocks`` than the radius and one make longer fronts, fewer to
    compare, and more tables; the pairs are the same.
    """
    blocks = blocks or max(radius + 1, 2)
    if not max(radius, 1) < blocks <= BITS:
        raise ValueError("blocks must be more than the radius, and two at least")  # a block's bits are one number
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    spans = list(zip(cuts, cuts[1:]))
    own = [_block([F.col(h) for h in HASHES], *s) for s in spans]
    tables = F.array(*[
        F.struct(
            F.lit(k).alias("table"), F.array(*[own[j] for j in chosen]).alias("front"),
            F.lit(sum(1 << j for j in chosen)).cast("bigint").alias("chosen"),
            F.lit((1 << chosen[-1]) - 1).cast("bigint").alias("before"),
        )
        for k, chosen in enumerate(combinations(range(blocks), blocks - radius))
    ])
    rows = distinct.select(*HASHES, F.inline(tables))
    left = rows.withColumnsRenamed({"f1": "a1", "f2": "a2"})
    right = rows.select("table", "front", F.col("f1").alias("b1"), F.col("f2").alias("b2"))
    a, b = [F.col("a1"), F.col("a2")], [F.col("b1"), F.col("b2")]
    agree = F.lit(0).cast("bigint")
    for j, span in enumerate(spans):
        same = _block(a, *span) == _block(b, *span)
        agree = agree.bitwiseOR(F.when(same, F.lit(1 << j).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
    first = agree.bitwiseAND(F.col("before")) == F.col("chosen").bitwiseAND(F.col("before"))
    ordered = (a[0] < b[0]) | ((a[0] == b[0]) & (a[1] < b[1]))
    near = distance(a, b) <= radius
    left, right = left.alias("l"), right.alias("r")
    meet = (F.col("l.table") == F.col("r.table")) & (F.col("l.front") == F.col("r.front"))
    return left.join(right, meet & ordered & near & first).select("a1", "a2", "b1", "b2", distance(a, b).alias("distance"))


def document_order(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The texts by key, and the keys in order: ``k1, k2, doc_id, n_chars, copies, place, n1, n2``.

    A key stands for an id with its text, by 128 hashed bits. ``n1, n2`` is the key of the next
    document, by falling id, then the first again; null counts as the largest id. Rows repeated whole
    have one place and are counted in ``copies``.
    """
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).select(
        F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64(F.lit("key"), F.col("doc_id").isNull(), "text", "doc_id").alias("k2"), "doc_id", "text"
    )
    keys = texts.groupBy("k1", "k2", "doc_id", F.char_length("text").cast("bigint").alias("n_chars")).agg(F.count(F.lit(1)).alias("copies"))
    order = [F.col("doc_id").isNull().alias("nameless"), "*"]
    placed = stored(assign_ids(keys.select(*order), ["nameless", "doc_id", "k1", "k2"], "place").drop("nameless"), "order")
    last = placed.agg(F.max("place")).first()[0]
    after = placed.select(
        F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.when(F.col("place") == last, 1).otherwise(F.col("place") + 1).alias("place")
    )
    return texts.drop("doc_id"), stored(placed.join(after, "place"), "next")


def edited_texts(texts: DataFrame, order: DataFrame) -> DataFrame:
    """``k1, k2, text, edited``: each text, and with its last half replaced by as much of the start of the next document."""
    wanted = order.select(
        F.col("n1").alias("k1"), F.col("n2").alias("k2"), F.col("k1").alias("to1"), F.col("k2").alias("to2"),
        F.floor(F.col("n_chars") / 2).cast("int").alias("many"),
    )
    starts = texts.join(wanted, ["k1", "k2"]).select(
        F.col("to1").alias("k1"), F.col("to2").alias("k2"), F.substr(F.col("text"), F.lit(1), F.col("many")).alias("start")
    )
    if not order.where("copies > 1").isEmpty():  # rows repeated whole; usually there are none
        starts = starts.dropDuplicates(["k1", "k2"])
    kept = F.char_length("text") - F.floor(F.char_length("text") / 2).cast("int")
    return texts.join(starts, ["k1", "k2"]).select(
        "k1", "k2", "text", F.concat(F.substr(F.col("text"), F.lit(1), kept), F.col("start")).alias("edited")
    )


def near_classes(prints: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """``f1, f2, class``: for each distinct fingerprint the smallest ``place`` that links within the radius reach."""
    distinct = stored(prints.groupBy(*HASHES).agg(F.min("place").alias("place")), "fingerprints")
    pairs = within_radius(distinct.select(*HASHES), radius, blocks)
    for side in ("a", "b"):
        named = distinct.select(F.col("f1").alias(f"{side}1"), F.col("f2").alias(f"{side}2"), F.col("place").alias(side))
        pairs = pairs.join(named, [f"{side}1", f"{side}2"])
    found = components(pairs.select("a", "b")).withColumnRenamed("node", "place")
    return distinct.join(found, "place", "left").select(*HASHES, F.coalesce("component", "place").alias("class"))


def fingerprint_documents(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, blocks: int | None = None
) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, near_id`` per row.

    The edited text is the document's with its last half replaced by the start of the next document, by
    falling id, the first after the last; ``near_edited`` and ``near_next`` are the shares of equal bits
    with the fingerprints of the edited and the next text. ``near_id`` is the smallest id that links
    between fingerprints within the radius reach, its own included.

    A null or empty text has a fingerprint of no set bits, as has any text without words. A null id
    counts as the largest. Rows repeated whole count as one document in the order and are returned
    each; rows of one id with other texts come by a hash of the text. A table of one document has
    itself as the next. An empty table gives no rows. Other columns are not looked at.
    """
    texts, order = document_order(docs, id_col, text_col)
    weights = term_weights(texts)
    both = edited_texts(texts, order).select(
        "k1", "k2", F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("edit", "text")
    )
    prints = stored(fingerprints(both, ["k1", "k2", "edited_sha256", "edit"], weights), "prints")
    own = prints.where("edit = 0").drop("edit").join(order, ["k1", "k2"])
    edited = prints.where("edit = 1").select("k1", "k2", F.col("f1").alias("e1"), F.col("f2").alias("e2"))
    after = prints.where("edit = 0").select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("f1").alias("x1"), F.col("f2").alias("x2"))
    classes = near_classes(own.select("place", *HASHES), radius, blocks)
    names = order.select(F.col("place").alias("class"), F.col("doc_id").alias("near_id"))
    rows = join_spread(own.join(edited, ["k1", "k2"]).join(after, ["n1", "n2"]), classes.join(names, "class"), list(HASHES))
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies")))
    f, e, x = ([F.col(c) for c in names] for names in (HASHES, ("e1", "e2"), ("x1", "x2")))
    return rows.select(
        "doc_id", "n_chars", "edited_sha256", spelled(*f).alias("fingerprint"), spelled(*e).alias("edited_fingerprint"),
        likeness(f, e).alias("near_edited"), likeness(f, x).alias("near_next"), "near_id",
    )
