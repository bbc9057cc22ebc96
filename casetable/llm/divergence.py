"""How far the sources of a language are from each other in the terms they use.

Each language keeps the terms that enough of its documents hold. The kept terms, sorted, get their
places as ordinals and are built into minimal acyclic transducers, one per run of bounded size. Texts
are then streamed through them a second time: what comes out are ordinals, counted per source, with
which everything after that works. Smoothed shares are compared by the triangular discrimination
(p-q)^2/(p+q), in whole numbers.

A vocabulary has no bound, so the transducers go to the tasks in blocks of bounded size, each with a
pass of its own over the texts; ordinary corpora need one. Shares are compared in blocks of
consecutive ordinals with all sources of a language, cut so that a block's table is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from casetable.llm.common import stored
from casetable.llm.spans import LOWER, SLICE_BYTES, as_binary, buffers, byte_class, gathered, runs
from casetable.llm.transducer import Transducer
from casetable.llm.words import text_slices
from casetable.operators.joins import join_spread
from casetable.operators.order import running

TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]"
MIN_DOCS = 10
TOP = 10
SCALE = 1_000_000_000
#: Bytes of terms in a transducer, and of packed transducers in a task at once.
RUN_BYTES = 1 << 20
HELD_BYTES = 64 << 20
#: Numbers in the table of one block of ordinals.
CELLS = 1 << 20


def _rows(docs: DataFrame, text_col: str, lang_col: str, source_col: str) -> DataFrame:
    def filled(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(""))

    return docs.select(filled(lang_col).alias("lang"), filled(source_col).alias("source"), filled(text_col).alias("text"))


def document_counts(rows: DataFrame) -> DataFrame:
    """``lang, term, docs``: in how many rows of a language each term comes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inside = byte_class(TERM)
        for batch in batches:
            at = 0
            for part in text_slices(batch.column(1), SLICE_BYTES):
                raw, offsets = buffers(part)
                start, stop, first = runs(raw, offsets, inside)
                langs = batch.column(0).slice(at, len(part)).dictionary_encode()
                at += len(part)
                if not len(start):
                    continue
                place, bounds = gathered(raw, start, stop)
                terms = as_binary(LOWER[raw[place]], bounds).dictionary_encode()
                lang_of = np.repeat(langs.indices.to_numpy().astype(np.int64), np.diff(first))
                doc_of = np.repeat(np.arange(len(part)), np.diff(first))
                n = len(terms.dictionary)
                once = np.unique(doc_of * n + terms.indices.to_numpy(), return_index=True)[1]
                pair, docs = np.unique(lang_of[once] * n + terms.indices.to_numpy()[once], return_counts=True)
                yield pa.RecordBatch.from_arrays([
                    langs.dictionary.take(pa.array(pair // n)).cast(pa.string()),
                    terms.dictionary.take(pa.array(pair % n)).cast(pa.binary()).cast(pa.string()), pa.array(docs),
                ], ["lang", "term", "docs"])

    found = rows.select("lang", "text").mapInArrow(count, "lang string, term string, docs long")
    return found.groupBy("lang", "term").agg(F.sum("docs").alias("docs"))


def vocabulary(rows: DataFrame, min_docs: int = MIN_DOCS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """``lang, term, ordinal, run``: kept terms with their place in byte order, from 0, and the transducer they are in."""
    kept = document_counts(rows).where(F.col("docs") >= min_docs).select("lang", "term")
    placed = running(kept, ["lang"], ["term"], {"bytes": F.octet_length("term").cast("bigint")}, position="place")
    before = F.col("bytes") - F.octet_length("term")
    return stored(
        placed.select("lang", "term", (F.col("place") - 1).alias("ordinal"), F.floor(before / run_bytes).cast("bigint").alias("run")),
        "vocabulary",
    )


_PACKED = "lang string, run long, base long, edges binary, targets binary, adds binary, finals binary, root long"


def transducers(words: DataFrame) -> DataFrame:
    """One packed transducer per language and run; ``base`` is the ordinal of its first term."""

    def build(group: pa.Table) -> pa.Table:
        group = group.sort_by("ordinal")
        packed = Transducer.build(group["term"].cast(pa.binary()).to_pylist()).pack()
        head = [group["lang"][0].as_py(), group["run"][0].as_py(), group["ordinal"][0].as_py()]
        names = [f.split()[0] for f in _PACKED.split(", ")]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
        return pa.table([pa.array([v], k) for v, k in zip([*head, *packed], kinds)], names)

    # a group's terms are bounded by the bytes of a run
    return words.groupBy("lang", "run").applyInArrow(build, _PACKED)


def _blocks(packed: DataFrame, held_bytes: int) -> Iterator[list]:
    """The transducers in blocks of bounded size."""
    size = sum((F.octet_length(c) for c in ("edges", "targets", "adds", "finals")), F.lit(0))
    block, held = [], 0
    for row in packed.withColumn("size", size).toLocalIterator():
        if block and held + row["size"] > held_bytes:
            yield block
            block, held = [], 0
        block.append(row)
        held += row["size"]
    if block:
        yield block


def recount(rows: DataFrame, packed: DataFrame, held_bytes: int = HELD_BYTES) -> DataFrame:
    """``lang, source, ordinal, n``: how often each kept term comes in a source, by streaming the texts through the transducers."""
    schema = "lang string, source string, ordinal long, n long"

    def passed(block: list) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast([tuple(r)[:8] for r in block])  # at most held_bytes, or one transducer

        def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            inside, machines = byte_class(TERM), {}
            for lang, _, base, *rest in shared.value:
                machines.setdefault(lang, []).append((base, Transducer.unpack(*map(bytes, rest[:4]), rest[4])))
            for batch in batches:
                at = 0
                for part in text_slices(batch.column(2), SLICE_BYTES):
                    raw, offsets = buffers(part)
                    raw = LOWER[raw]
                    start, stop, first = runs(raw, offsets, inside)
                    langs, sources = (batch.column(c).slice(at, len(part)).dictionary_encode() for c in (0, 1))
                    at += len(part)
                    lang_of = np.repeat(langs.indices.to_numpy(), np.diff(first))
                    source_of = np.repeat(sources.indices.to_numpy().astype(np.int64), np.diff(first))
                    for i, lang in enumerate(langs.dictionary.to_pylist()):
                        some = np.flatnonzero(lang_of == i)
                        for base, machine in machines.get(lang, []):
                            place = machine.ordinals(raw, start[some], stop[some])
                            hit = place >= 0
                            width = int(place.max(initial=0)) + 1
                            pair, n = np.unique(source_of[some[hit]] * width + place[hit], return_counts=True)
                            yield pa.RecordBatch.from_arrays([
                                pa.array([lang] * len(pair), pa.string()), sources.dictionary.take(pa.array(pair // width)).cast(pa.string()),
                                pa.array(pair % width + base), pa.array(n),
                            ], ["lang", "source", "ordinal", "n"])
                            some = some[~hit]

        return rows.mapInArrow(stream, schema)

    parts = [passed(block) for block in _blocks(packed, held_bytes)]
    empty = rows.sparkSession.createDataFrame([], schema)
    return reduce(DataFrame.unionByName, parts, empty).groupBy("lang", "source", "ordinal").agg(F.sum("n").alias("n"))


def shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / total) without overflow, for counts up to the total."""
    rest, out = counts.astype(np.int64), np.zeros(np.broadcast_shapes(counts.shape, total.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // total
        rest = rest % total
    return out + 1


def _compare(top: int):
    """The work on one block of ordinals: partial sums over all pairs of sources, and the block's best terms of each."""

    def compare(counts: pa.Table, groups: pa.Table) -> pa.Table:
        names = groups["source"].to_pylist()
        if not names:
            return _out([], [], [], [], [], [])
        lang, terms = groups["lang"][0].as_py(), groups["terms"][0].as_py()
        first, last = groups["first"][0].as_py(), groups["last"][0].as_py()
        spot = pc.index_in(counts["source"], value_set=groups["source"].combine_chunks()).to_numpy()
        table = np.zeros((len(names), last - first), np.int64)
        table[spot, counts["ordinal"].to_numpy() - first] = counts["n"].to_numpy()
        total = groups["total"].to_numpy() + 2 * terms
        p = shares(table + 2, total[:, None])
        in_lang = table.sum(axis=0)
        q = shares(in_lang + 2, np.array([groups["lang_total"][0].as_py() + 2 * terms]))
        source, part, other, ordinal, value = [], [], [], [], []
        for i, name in enumerate(names):
            gap = p - p[i]
            sums = (gap * gap // (p + p[i])).sum(axis=1)
            keep = np.arange(len(names)) != i
            source += [name] * (len(names) - 1)
            part += ["pair"] * (len(names) - 1)
            other += [n for n in names if n != name]
            ordinal += [None] * (len(names) - 1)
            value += sums[keep].tolist()
            at = np.flatnonzero((table[i] > 0) & (p[i] > q))
            gap = p[i, at] - q[at]
            f = gap * gap // (p[i, at] + q[at])
            best = np.lexsort((at, -f))[:top]
            source += [name] * len(best)
            part += ["term"] * len(best)
            other += [None] * len(best)
            ordinal += (at[best] + first).tolist()
            value += f[best].tolist()
        return _out([lang] * len(source), source, part, other, ordinal, value)

    def _out(*columns) -> pa.Table:
        kinds = [pa.string()] * 4 + [pa.int64()] * 2
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], ["lang", "source", "part", "other", "ordinal", "value"])

    return compare


def source_divergence(
    docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", min_docs: int = MIN_DOCS,
    top: int = TOP, run_bytes: int = RUN_BYTES, held_bytes: int = HELD_BYTES, cells: int = CELLS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``.

    ``part`` is ``pair``: ``item`` is each other source of the language, ``value`` the sum of
    (p-q)^2/(p+q), each floored, over the language's kept terms; or ``term``: the ``top`` kept terms that
    the source uses more than the language, with the same measure against the language's share. Ranks go
    by value from the largest, ties by the item in byte order. A share is
    1 + floor(10^9 * (n + 2) / (N + 2V)), whole-number arithmetic throughout.

    Null texts, languages and sources count as empty; only A-Z is lower-cased. A language without
    kept terms has pairs of value 0 and no terms; a language with one source has no pairs. Repeated
    rows count each. An empty table gives no rows. Other columns are not looked at.
    """
    rows = _rows(docs, text_col, lang_col, source_col)
    words = vocabulary(rows, min_docs, run_bytes)
    packed = stored(transducers(words), "transducers")
    counts = stored(recount(rows, packed, held_bytes), "recounts")
    totals = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = stored(
        rows.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").na.fill({"total": 0}), "groups"
    )
    sizes = words.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"))
    langs = groups.groupBy("lang").agg(F.sum("total").alias("lang_total"), F.count(F.lit(1)).alias("sources")).join(sizes, "lang")
    # consecutive ordinals of a language, so many that the table of a block has at most ``cells`` numbers
    langs = langs.withColumn("width", F.greatest(F.lit(1), F.floor(F.lit(cells) / F.col("sources"))).cast("bigint"))
    starts = F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("terms") - 1) / F.col("width")).cast("bigint")))
    blocks = langs.withColumn("block", starts).select(
        "lang", "block", "terms", "lang_total", (F.col("block") * F.col("width")).alias("first"),
        F.least("terms", (F.col("block") + 1) * F.col("width")).alias("last"),
    )
    right = groups.join(blocks, "lang")
    left = join_spread(counts, langs.select("lang", "width"), ["lang"]).withColumn("block", F.floor(F.col("ordinal") / F.col("width")).cast("bigint"))
    compared = stored(
        left.select("lang", "source", "ordinal", "n", "block").groupBy("lang", "block").cogroup(right.groupBy("lang", "block")).applyInArrow(
            _compare(top), "lang string, source string, part string, other string, ordinal long, value long"
        ),
        "compared",
    )

    pair = groups.select("lang", "source").join(groups.select("lang", F.col("source").alias("item")), "lang").where("source <> item")
    sums = compared.where("part = 'pair'").groupBy("lang", "source", F.col("other").alias("item")).agg(F.sum("value").alias("value"))
    pairs = pair.join(sums, ["lang", "source", "item"], "left").na.fill({"value": 0}).withColumn("part", F.lit("pair"))
    by_item = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = pairs.withColumn("rank", F.row_number().over(by_item))
    by_ordinal = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "ordinal")
    terms = compared.where("part = 'term'").withColumn("rank", F.row_number().over(by_ordinal)).where(F.col("rank") <= top)
    terms = terms.join(words.select("lang", "ordinal", F.col("term").alias("item")), ["lang", "ordinal"])
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pairs.select(*out).unionByName(terms.select(*out))
