"""Request tables: rendered text per chunk of rows, and sampled extras per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casetable.operators.joins import join_spread
from casetable.operators.keys import assign_ids


def render_requests(
    chunks: DataFrame, keys: Sequence[str], item_no: str, header: Column, item: Column,
    footer: Column | None = None, sep: str = "\n",
) -> DataFrame:
    """One request per chunk: header, the items in order, and a footer.

    ``keys`` name a chunk, whose size the chunking step bounds; ``header`` must be the same
    for all rows of a chunk. ``item_count`` tells how many items went in.
    """
    lines = F.array_sort(F.collect_list(F.struct(F.col(item_no).alias("_at"), item.alias("_text"))))
    one = chunks.groupBy(*keys).agg(
        F.min(header).alias("_header"), lines.alias("_lines"), F.count(F.lit(1)).alias("item_count")
    )
    body = F.array_join(F.transform("_lines", lambda x: x["_text"]), sep)
    parts = [F.col("_header"), body] + ([footer] if footer is not None else [])
    return one.select(*keys, "item_count", F.concat_ws(sep, *parts).alias("request"))


def next_prime(n: int) -> int:
    """The smallest prime that is not below n."""
    n = max(n, 2)
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def _lot(seed: int, key: Column, what: str) -> Column:
    """A whole number below 2^32 from seed and key."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{what}:"), key.cast("string"))), 1, 8), 16, 10).cast("bigint")


def sample_k(df: DataFrame, items: DataFrame, k: int, seed: int, key: str, item: str, name: str = "picked") -> DataFrame:
    """Add ``k`` different items per row, all if there are fewer, repeatable by seed and key.

    The items are numbered. A row visits the numbers below a prime in steps of its own stride from its
    own start, which is a permutation of them; the first ``k`` that are numbers of items are its sample.
    Only those slots meet the items, in a join by number: no row meets all items, and the driver learns
    nothing but how many there are. Rows with equal keys have equal samples; a null key has none.
    """
    numbered = assign_ids(items.select(F.col(item).alias("_item")).where("_item is not null").distinct(), ["_item"], "_no")
    n = numbered.count()
    prime = next_prime(n)
    start, stride = _lot(seed, F.col("_key"), "start") % prime, _lot(seed, F.col("_key"), "stride") % max(prime - 1, 1) + 1
    # numbers between the items and the prime are passed over; there are few, as primes lie close
    visited = F.transform(F.sequence(F.lit(0), F.lit(k + prime - n - 1)), lambda j: (F.col("_start") + j * F.col("_stride")) % prime)
    slots = F.slice(F.filter(F.array_distinct(visited), lambda s: s < n), 1, k)
    keyed = df.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    keyed = keyed.select("_key", start.alias("_start"), stride.alias("_stride"))
    wanted = keyed.select("_key", F.posexplode(slots).alias("_at", "_slot"))
    met = wanted.join(numbered.select((F.col("_no") - 1).alias("_slot"), "_item"), "_slot")
    picked = met.groupBy("_key").agg(  # k items at most
        F.transform(F.array_sort(F.collect_list(F.struct("_at", "_item"))), lambda x: x["_item"]).alias(name)
    )
    joined = join_spread(df, picked.withColumnRenamed("_key", key), [key], "left")
    empty = F.array().cast(picked.schema[name].dataType)
    return joined.withColumn(name, F.coalesce(name, empty))
