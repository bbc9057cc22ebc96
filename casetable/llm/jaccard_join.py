"""Exact Jaccard self-join over word shingles by T-occurrence search.

A set can only be similar to another if it has few shingles that nobody else has. The steps:

1. Sets that are equal are one set. Of each set the shingles with the smallest hashes are
   counted over the whole corpus; a set of which too many are its own is linked with nothing.
   How many are looked at depends on the size of the set, as few as can prove it.
2. The remaining sets sort their shingles by frequency among themselves. Of any two similar
   sets the rarest fifth of each must share one, so these short lists join the sets into
   neighbourhoods outside of which no link is possible.
3. In a neighbourhood every set searches those before it (DivideSkip): its short inverted
   lists are merged on a heap that skips ahead, its long ones are only probed by binary search,
   and sets that reach the required overlap are linked. A search passes over sets that are
   already in the component found, so copies of one text are not compared all with all.

A neighbourhood of any size is cut into chunks of sets in order of size, and pairs of chunks
are searched apart. Shingles and sets are known by 64-bit hashes.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casetable.llm.common import stored
from casetable.llm.components import components
from casetable.llm.words import shingle_hashes, spread_bits, text_slices
from casetable.operators.joins import join_spread
from casetable.operators.keys import assign_ids

WORDS = 5
#: Similarity of at least NUM / DEN.
NUM, DEN = 4, 5
#: Sets in a chunk of a neighbourhood.
CHUNK = 512
#: Bits of the map of open texts, 4 MB; more open texts only let more others through.
FILTER_BITS = 25
#: The share of the long lists grows with this (a constant of the DivideSkip rule).
MU = 0.01


def needed(a, b):
    """The overlap at which sets of sizes a and b are similar."""
    return -(-NUM * (a + b) // (NUM + DEN))


def sample_limit(n: int) -> int:
    """Hashes below this are looked at in the first step, falling with the size of the set.

    A set is shown to be alone by more than a fifth of its shingles; half as many again are
    looked at, so that large sets that share up to a third with others are settled here too.
    """
    share = 1.5 * (DEN - NUM) / DEN + 1.5 / n**0.5
    return (1 << 64) - 1 if share >= 1 else int(share * 2.0**64)


def set_key(shingles: np.ndarray) -> int:
    return int(np.sum(spread_bits(shingles ^ np.uint64(0x9E3779B97F4A7C15)), dtype=np.uint64).astype(np.int64))


def _sets(batches: Iterator[pa.RecordBatch], words: int):
    """For each row of (.., text last): the row's first cells and its sorted distinct shingles."""
    for batch in batches:
        heads = [c.to_pylist() for c in batch.columns[:-1]]
        at = 0
        for texts in text_slices(batch.columns[-1]):
            for shingles in shingle_hashes(texts, words):
                yield [h[at] for h in heads], shingles
                at += 1


def _batches(rows: Iterator[tuple], schema: pa.Schema, cells: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Record batches of rows; a row's last cell may be an array, counted by its length."""
    held, count = [], 0

    def batch():
        columns = list(zip(*held)) or [[]] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    for row in rows:
        held.append(row)
        count += 1 + (len(row[-1]) if isinstance(row[-1], (list, np.ndarray)) else 0)
        if count >= cells:
            yield batch()
            held, count = [], 0
    yield batch()


def document_sets(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """``doc_id, text_key, n, set_key`` per row; the key of an empty set is null."""
    schema = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("n", pa.int64()), ("set_key", pa.int64())])

    def measure(batches):
        rows = ((d, k, len(s), set_key(s) if len(s) else None) for (d, k), s in _sets(batches, words))
        return _batches(rows, schema)

    return _keyed(docs, id_col, text_col).mapInArrow(measure, "doc_id long, text_key long, n long, set_key long")


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def looked_at(docs: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """``shingle, set_key, own`` for the smallest hashes of each set.

    ``own`` marks those that every set of a similar size sends as well.
    """
    schema = pa.schema([("set_key", pa.int64()), ("sure", pa.int32()), ("shingles", pa.list_(pa.int64()))])

    def send(batches):
        def rows():
            done: set[int] = set()  # equal sets of a task are sent once; forgotten from time to time
            for _, s in _sets(batches, words):
                if not len(s):
                    continue
                key = set_key(s)
                if key in done:
                    continue
                if len(done) >= 100_000:
                    done.clear()
                done.add(key)
                sent = s[:np.searchsorted(s, np.uint64(sample_limit(len(s))), "right")]
                sure = np.searchsorted(sent, np.uint64(sample_limit(len(s) * DEN // NUM + 1)), "right")
                yield key, int(sure), sent.view(np.int64)

        return _batches(rows(), schema)

    sent = _keyed(docs, id_col, text_col).select("text").mapInArrow(send, "set_key long, sure int, shingles array<long>")
    return sent.select("set_key", "sure", F.posexplode("shingles").alias("at", "shingle")).select(
        "shingle", "set_key", (F.col("at") < F.col("sure")).alias("own")
    )


def open_sets(sets: DataFrame, sent: DataFrame) -> DataFrame:
    """The sets that may have a partner: ``set_key, n, text_key``, one text for each set."""
    alone = (
        sent.groupBy("shingle")
        .agg(F.min("set_key").alias("set_key"), F.max("set_key").alias("last"), F.max("own").alias("own"))
        .where("own and set_key = last")
        .groupBy("set_key").agg(F.count(F.lit(1)).alias("alone"))
    )
    distinct = sets.where("set_key is not null").groupBy("set_key").agg(
        F.max("n").alias("n"), F.min("text_key").alias("text_key")
    )
    most = F.floor(F.col("n") * (DEN - NUM) / DEN)
    return distinct.join(alone, "set_key", "left").where(F.coalesce("alone", F.lit(0)) <= most).select(
        "set_key", "n", "text_key"
    )


def marked_bits(opened: DataFrame) -> np.ndarray:
    """A bit map of fixed size in which the bits of the open sets' text keys are set."""
    bit = F.pmod("text_key", F.lit(1 << FILTER_BITS))
    parts = opened.select(F.floor(bit / 32768).alias("part"), (bit % 32768).alias("bit")).groupBy("part").agg(
        F.bitmap_construct_agg("bit").alias("bits")
    )
    out = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    for r in parts.toLocalIterator():  # bounded: 2 ** FILTER_BITS bits in all
        out[r.part * 4096:(r.part + 1) * 4096] = np.frombuffer(bytes(r.bits), np.uint8)
    return out


def open_shingles(docs: DataFrame, opened: DataFrame, id_col: str, text_col: str, words: int = WORDS) -> DataFrame:
    """``set_key, n, shingles`` of the open sets, read from one of their texts.

    The bit map passes over most other texts where they are read, so that texts are not moved; those
    that it lets through by chance go in the join.
    """
    schema = pa.schema([("set_key", pa.int64()), ("n", pa.int64()), ("shingles", pa.list_(pa.int64()))])
    shared = docs.sparkSession.sparkContext.broadcast(marked_bits(opened))  # bounded by FILTER_BITS

    def build(batches):
        def wanted():
            for batch in batches:
                bit = batch.column(0).to_numpy() & ((1 << FILTER_BITS) - 1)
                yield batch.filter(pa.array((shared.value[bit >> 3] >> (bit & 7) & 1).astype(bool)))

        def rows():
            done: set[int] = set()
            for _, s in _sets(wanted(), words):
                if not len(s):
                    continue
                key = set_key(s)
                if key in done:
                    continue
                if len(done) >= 100_000:
                    done.clear()
                done.add(key)
                yield key, len(s), s.view(np.int64)

        return _batches(rows(), schema)

    texts = _keyed(docs, id_col, text_col).select("text_key", "text")
    read = texts.mapInArrow(build, "set_key long, n long, shingles array<long>")
    return read.join(opened.select("set_key"), "set_key", "left_semi").dropDuplicates(["set_key"])


def neighbourhoods(shingled: DataFrame) -> DataFrame:
    """``set_key, place``: sets that may be similar have the same place."""
    flat = shingled.select("set_key", "n", F.explode("shingles").alias("shingle"))
    common = flat.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    held = join_spread(flat, common, ["shingle"])
    lists = held.groupBy("set_key", "n").agg(F.array_sort(F.collect_list(F.struct("df", "shingle"))).alias("rare"))
    # the rarest fifth and one more, of which the set's own shingles, in no other set, come first
    short = F.floor(F.col("n") * (DEN - NUM) / DEN) + 1 - (F.col("n") - F.size("rare"))
    first = lists.where(short > 0).select("set_key", F.explode(F.slice("rare", 1, short.cast("int"))).alias("entry"))
    entries = stored(first.select("set_key", F.col("entry.shingle").alias("shingle")), "short")
    leaders = entries.groupBy("shingle").agg(F.min("set_key").alias("leader"))
    links = join_spread(entries, leaders, ["shingle"]).where("set_key <> leader").select("set_key", "leader").distinct()
    return components(links, "set_key", "leader").select(F.col("node").alias("set_key"), F.col("component").alias("place"))


def chunk_pairs(shingled: DataFrame, places: DataFrame, chunk: int) -> DataFrame:
    """Sets with the search task they belong to: ``place, low, high, chunk`` and the set."""
    ranked = assign_ids(shingled.select("set_key", "n").join(places, "set_key"), ["place", "n", "set_key"], "rank")
    firsts = ranked.groupBy("place").agg(F.min("rank").alias("first"))
    at = F.floor((F.col("rank") - F.col("first")) / chunk).cast("int")
    chunked = stored(join_spread(ranked, firsts, ["place"]).select("set_key", "place", "n", at.alias("chunk")), "chunks")
    spans = chunked.groupBy("place", "chunk").agg(F.min("n").alias("least"), F.max("n").alias("most"))
    low = spans.select("place", F.col("chunk").alias("low"), F.col("most").alias("low_most"))
    high = spans.select("place", F.col("chunk").alias("high"), F.col("least").alias("high_least"))
    pairs = low.join(high, "place").where(
        (F.col("low") <= F.col("high")) & (F.col("high_least") * NUM <= F.col("low_most") * DEN)
    ).select("place", "low", "high")
    sides = pairs.select("*", F.col("low").alias("chunk")).union(
        pairs.where("low <> high").select("*", F.col("high").alias("chunk"))
    )
    tasks = join_spread(chunked, sides.groupBy("place", "chunk").agg(
        F.collect_list(F.struct("low", "high")).alias("tasks")  # bounded: the chunks of one place
    ), ["place", "chunk"]).select("set_key", "place", "chunk", F.explode("tasks").alias("task"))
    return tasks.join(shingled, "set_key").select("place", "task.low", "task.high", "chunk", "set_key", "n", "shingles")


def merge_skip(lists: Sequence[Sequence[int]], starts: Sequence[int], times: int) -> Iterator[tuple[int, int]]:
    """Values found in at least ``times`` of the sorted lists, with their count.

    The smallest values stand on a heap; where one comes too rarely, the lists that could not
    make up the count jump over everything before the next value that still can.
    """
    heap = [(values[at], i) for i, (values, at) in enumerate(zip(lists, starts)) if at < len(values)]
    heapq.heapify(heap)
    place = list(starts)
    while len(heap) >= times:
        value = heap[0][0]
        out = []
        while heap and heap[0][0] == value:
            out.append(heapq.heappop(heap)[1])
        if len(out) >= times:
            yield value, len(out)
            onward = value + 1
        else:
            while heap and len(out) < times - 1:
                out.append(heapq.heappop(heap)[1])
            if not heap:
                return
            onward = heap[0][0]
        for i in out:
            at = bisect_left(lists[i], onward, place[i])
            place[i] = at
            if at < len(lists[i]):
                heapq.heappush(heap, (lists[i][at], i))


class Search:
    """An inverted index over sets that come in order of size, and the components found so far."""

    def __init__(self):
        self.sizes: list[int] = []
        self.lists: dict[int, list[int]] = {}
        self.parent: list[int] = []

    def root(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def reaches(self, i: int, shingles: Sequence[int], least: int) -> bool:
        """Whether set i holds at least ``least`` of the shingles; stops as soon as it cannot."""
        missing = len(shingles) - least
        for s in shingles:
            values = self.lists.get(s, ())
            at = bisect_left(values, i)
            if at == len(values) or values[at] != i:
                missing -= 1
                if missing < 0:
                    return False
        return True

    def partners(self, shingles: Sequence[int]) -> Iterator[int]:
        """For each component with a similar set, one such set."""
        n = len(shingles)
        smallest = -(-NUM * n // DEN)
        first = bisect_left(self.sizes, smallest)
        if first == len(self.sizes):
            return
        lists = sorted((v for v in map(self.lists.get, shingles) if v and v[-1] >= first), key=len)
        times = smallest  # the least overlap with any set that is large enough
        if len(lists) < times:
            return
        found: set[int] = set()
        # sets before this one that are likely partners, tried first: they settle whole components
        for i in dict.fromkeys((lists[0][-1], lists[len(lists) // 2][-1])):
            if self.reaches(i, shingles, needed(n, self.sizes[i])):
                found.add(self.root(i))
                yield i
        if found:
            roots = {}
            kept = []
            for values in lists:
                rest = []
                for i in values[bisect_left(values, first):]:
                    if i not in roots:
                        roots[i] = self.root(i)
                    if roots[i] not in found:
                        rest.append(i)
                if rest:
                    kept.append(rest)
            lists = sorted(kept, key=len)
            if len(lists) < times:
                return
        aside = min(times - 1, int(times / (MU * np.log2(max(2, len(lists[-1]))) + 1)))
        short, long = lists[:len(lists) - aside], lists[len(lists) - aside:]
        for i, count in merge_skip(short, [bisect_left(v, first) for v in short], times - aside):
            if self.root(i) in found:
                continue
            least = needed(n, self.sizes[i])
            left = len(long)
            for values in long:
                if count >= least or count + left < least:
                    break
                at = bisect_left(values, i)
                count += at < len(values) and values[at] == i
                left -= 1
            if count >= least:
                found.add(self.root(i))
                yield i

    def add(self, shingles: Sequence[int], listed: bool = True) -> int:
        i = len(self.sizes)
        self.sizes.append(len(shingles))
        self.parent.append(i)
        if listed:
            for s in shingles:
                self.lists.setdefault(s, []).append(i)
        return i


def search_links(keys: Sequence[int], sets: Sequence[Sequence[int]], split: int | None) -> Iterator[tuple[int, int]]:
    """Links that join the similar sets, which come in order of size.

    With ``split``, only links between the sets before and from that place on are looked for.
    """
    search = Search()
    for i, shingles in enumerate(sets):
        across = split is not None and i >= split
        links = [] if split is not None and not across else list(search.partners(shingles))
        if across:  # not listed: later sets of this side are not looked for
            for j in links:
                search.parent[search.root(j)] = search.root(links[0])
        else:
            me = search.add(shingles)
            for j in links:
                search.parent[search.root(j)] = me
        for j in links:
            yield keys[i], keys[j]


def similar_links(tasks: DataFrame) -> DataFrame:
    """``a, b``: links between sets, enough to join every component."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(group: pa.Table) -> pa.Table:
        rows = group.select(["chunk", "n", "set_key", "low", "high", "shingles"]).sort_by(
            [("chunk", "ascending"), ("n", "ascending"), ("set_key", "ascending")]
        ).combine_chunks()
        keys, chunks = rows["set_key"].to_pylist(), rows["chunk"].to_pylist()
        low, high = rows["low"][0].as_py(), rows["high"][0].as_py()
        split = bisect_left(chunks, high) if low != high else None
        found = list(search_links(keys, rows["shingles"].to_pylist(), split))
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in (zip(*found) if found else ([], []))], schema=schema)

    return tasks.groupBy("place", "low", "high").applyInArrow(run, "a long, b long")


def similar_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, chunk: int = CHUNK
) -> DataFrame:
    """``doc_id, text_key, n, component`` per row: equal components are linked; a text without words has none."""
    sets = stored(document_sets(docs, id_col, text_col, words), "sets")
    opened = stored(open_sets(sets, looked_at(docs, id_col, text_col, words)), "open")
    shingled = stored(open_shingles(docs, opened, id_col, text_col, words), "shingles")
    tasks = chunk_pairs(shingled, neighbourhoods(shingled), chunk)
    linked = components(stored(similar_links(tasks), "links"))
    return join_spread(sets, linked.withColumnRenamed("node", "set_key"), ["set_key"], "left").select(
        "doc_id", "text_key", "n", F.coalesce("component", "set_key").alias("component")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, chunk: int = CHUNK) -> DataFrame:
    """The rows without those that are similar to a kept one: of each group the row with the smallest id stays.

    A row is known by its id and its text, so rows that share an id are told apart; of rows repeated
    whole one stays. A null id comes after all others, ties go by a hash of the text. Texts without words
    all stay.
    """
    classes = stored(similar_classes(docs, id_col, text_col, words=words, chunk=chunk).where("component is not null"), "classes")
    row = F.struct(F.col("doc_id").isNull().alias("late"), "doc_id", "text_key")
    firsts = classes.groupBy("component").agg(F.min(row).alias("first"))
    gone = join_spread(classes, firsts, ["component"]).where(row != F.col("first")).select(
        F.col("doc_id").alias("_gone_id"), F.col("text_key").alias("_gone_text")
    )
    gone = stored(gone.distinct(), "near")  # written first: Spark then knows the size, and broadcasts only few
    if not classes.groupBy("doc_id", "text_key").count().where("count > 1").isEmpty():  # rows repeated whole; usually there are none
        wordy = F.coalesce(F.col(text_col).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
        docs = docs.where(wordy).dropDuplicates([id_col, text_col]).unionByName(docs.where(~wordy))
    same = F.col(id_col).cast("bigint").eqNullSafe(F.col("_gone_id")) & (
        F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("_gone_text")
    )
    return docs.join(gone, same, "left_anti")


def jaccard_join(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = WORDS, chunk: int = CHUNK
) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row: the smallest id that similar texts reach.

    Texts are lower-cased in A-Z and cut at ASCII white space; one with fewer words than a shingle
    has its whole word sequence as its one shingle. A null, empty or blank text has no shingle and
    is linked with nothing, not even with another such text. Rows with repeated ids are rows of
    their own; a null id is never a component's id unless all its ids are null. An empty table
    gives no rows. Other columns are not looked at.
    """
    joined = similar_classes(docs, id_col, text_col, words=words, chunk=chunk)
    firsts = joined.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return join_spread(joined, firsts, ["component"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )
