"""Live logs: every-n summaries, append-once sinks, running totals.

What a stream has to remember is keyed state in the state store, so a micro-batch reads nothing but
its own rows, and a query that is started again goes on where it stopped. Every function takes the
``trigger`` of ``DataStreamWriter``: ``{"availableNow": True}`` reads what is there and ends,
``{"processingTime": "10 seconds"}`` goes on for ever.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from casetable.operators.order import SUMMARY_SCHEMA
from casetable.session import children, remove

BATCH = "batch_id"
ALL_THERE_IS: Mapping = {"availableNow": True}
#: State that may outgrow the memory, of which a batch writes only what it changed.
_STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}
#: How long a run's state is kept after its ``done`` event.
KEEP_RUN_MS = 24 * 3600 * 1000
#: Groups into which the keys of an append-once sink are hashed.
BUCKETS = 256


def _to_files(rows: DataFrame, path: str, checkpoint: str, trigger: Mapping, settings: Mapping = {}) -> StreamingQuery:
    """Append to a file sink, whose own log lists the files of finished batches: each row counts once.

    A query takes the session's settings along when it starts, so they are put back at once.
    """
    conf = rows.sparkSession.conf
    before = {name: conf.get(name, None) for name in settings}
    for name, value in settings.items():
        conf.set(name, value)
    try:
        return (
            rows.writeStream.format("parquet").outputMode("append").option("path", path)
            .option("checkpointLocation", checkpoint).trigger(**trigger).start()
        )
    finally:
        for name, value in before.items():
            conf.unset(name) if value is None else conf.set(name, value)


def _stateful(trigger: Mapping) -> dict[str, str]:
    """Settings of a query with state. Timers ask for batches without rows for ever; one that is to end makes none."""
    return {**_STATE_STORE, "spark.sql.streaming.noDataMicroBatches.enabled": str("processingTime" in trigger).lower()}


# --- every n ---------------------------------------------------------------------------------

_OPEN = ["problem_id", "ok", "call_elapsed_cs", "solution_indices", "progress", "total_elapsed_cs"]


class EveryN(StatefulProcessor):
    """Totals of a run, and the fewer than n events that make no group yet."""

    def __init__(self, n: int, run: str, order: Sequence[str], keep_ms: int):
        self.n, self.run, self.order, self.keep_ms = n, run, list(order), keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.totals = handle.getValueState("totals", "done bigint, ok bigint")
        self.open = handle.getListState(
            "open",
            "problem_id bigint, ok boolean, call_elapsed_cs bigint, solution_indices array<bigint>, progress string, total_elapsed_cs bigint",
        )

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)  # a run's events of one micro-batch
        ended = (batch["event"] == "done").any()
        events = batch[batch["event"] == "chunk_done"].sort_values(self.order)
        done, good = self.totals.get() or (0, 0)
        held = [tuple(row) for row in self.open.get()] if self.open.exists() else []
        first = done - len(held)  # events before the open group
        held += list(events[_OPEN].itertuples(index=False, name=None))
        good -= sum(bool(row[1]) for row in held[:done - first])
        out = []
        for at in range(0, len(held) - self.n + 1, self.n):
            group = held[at:at + self.n]
            ok = sum(bool(row[1]) for row in group)
            good += ok
            out.append((
                key[0], (first + at) // self.n, first + at + self.n, good, ok, sum(int(row[2]) for row in group) / self.n / 100.0,
                group[-1][4], None if pd.isna(group[-1][5]) else int(group[-1][5]) / 6000.0, ", ".join(map(_failed, (r for r in group if not r[1]))),
            ))
        rest = held[len(held) // self.n * self.n:]
        self.totals.update((first + len(held), good + sum(bool(row[1]) for row in rest)))
        if rest:
            self.open.put([_plain(row) for row in rest])
        else:
            self.open.clear()
        if ended:  # what comes late still counts; then the run is forgotten
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.keep_ms)
        names = [self.run, *[f.split()[0] for f in SUMMARY_SCHEMA.split(", ")]]
        yield pd.DataFrame(out, columns=names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.totals.clear()
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def _plain(row: tuple) -> tuple:
    """An event as state: plain Python values."""
    problem, ok, spent, indices, progress, elapsed = row
    return (
        None if pd.isna(problem) else int(problem), None if ok is None else bool(ok), int(spent),
        None if indices is None else [int(i) for i in indices], progress, None if pd.isna(elapsed) else int(elapsed),
    )


def _failed(row: tuple) -> str:
    """``problem#[indices]``, empty where a part is missing."""
    problem, _, _, indices, _, _ = row
    if pd.isna(problem) or indices is None:
        return ""
    return f"{int(problem)}#[{', '.join(str(int(i)) for i in indices)}]"


def stream_every_n(
    stream: DataFrame, path: str, checkpoint: str, n: int, run: str = "run", order: Sequence[str] = ("ts", "seq"),
    trigger: Mapping = ALL_THERE_IS, keep_ms: int = KEEP_RUN_MS,
) -> StreamingQuery:
    """``every_n_summary`` over a live log, appended to ``path`` as groups fill up.

    The state of a run is two totals and fewer than ``n`` events, whatever the length of the log. Events
    of a run are ordered inside a micro-batch, which the source bounds (``maxFilesPerTrigger``,
    ``maxOffsetsPerTrigger``). A timer drops a run ``keep_ms`` after its ``done`` event. ``path`` and
    ``checkpoint`` belong together: begin with new ones for both. Null flags count as failed.
    """
    events = stream.where(F.col("event").isin("chunk_done", "done")).select(
        run, "event", *order, "problem_id", F.coalesce("ok", F.lit(False)).alias("ok"),
        F.coalesce("call_elapsed_cs", F.lit(0)).alias("call_elapsed_cs"), "solution_indices", "progress", "total_elapsed_cs",
    )
    key = events.schema[run].dataType.simpleString()
    rows = events.groupBy(run).transformWithStateInPandas(
        EveryN(n, run, order, keep_ms), f"`{run}` {key}, {SUMMARY_SCHEMA}", "append", "ProcessingTime"
    )
    return _to_files(rows, path, checkpoint, trigger, _stateful(trigger))


def stream_passed(stream: DataFrame, path: str, checkpoint: str, trigger: Mapping = ALL_THERE_IS) -> StreamingQuery:
    """All other lines of a live log, at once: ``start``, ``done`` and what is no event."""
    return _to_files(stream.where(F.col("event").isNull() | (F.col("event") != "chunk_done")), path, checkpoint, trigger)


# --- append once -----------------------------------------------------------------------------


class FirstOfKey(StatefulProcessor):
    """Lets the first row of every key pass. A group is a bucket of keys; those seen are in a map."""

    def __init__(self, order: str, columns: Sequence[str]):
        self.order, self.columns = order, list(columns)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", "key string", "yes boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        # of one key in a micro-batch the lowest order, nulls last
        batch = pd.concat(list(rows), ignore_index=True).sort_values([self.order, "tie__"], na_position="last")
        batch = batch.drop_duplicates("key__")
        fresh = [not self.seen.containsKey((k,)) for k in batch["key__"]]
        batch = batch[fresh]
        for k in batch["key__"]:
            self.seen.updateValue((k,), (True,))
        yield batch[self.columns]

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for k in initialState["key__"]:
            self.seen.updateValue((k,), (True,))

    def close(self) -> None:
        pass


def _keyed(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    """The keys as one text in which null and empty differ, and the bucket of that text.

    The processor is handed columns by name only if the names do not begin with an underscore.
    """
    text = F.to_json(F.array(*[F.col(k).cast("string") for k in keys]))
    return df.withColumn("key__", text).withColumn("bucket__", F.pmod(F.xxhash64("key__"), F.lit(buckets)).cast("int"))


def append_once(
    stream: DataFrame, path: str, checkpoint: str, keys: Sequence[str], order: str, trigger: Mapping = ALL_THERE_IS,
    buckets: int = BUCKETS,
) -> StreamingQuery:
    """Append rows whose key is not in the table yet; of equal keys in one batch the lowest order.

    The keys seen are in the state store: a batch reads no stored table, and costs the same however much
    is stored. A query with a new checkpoint reads the keys of the table once, as its first state.
    Each checkpoint writes to a folder of its own below ``path``; ``read_appended`` gives the whole
    table. One query at a time. ``buckets`` are the tasks that can share a batch, and stay as they
    are for the life of a checkpoint.
    """
    spark = stream.sparkSession
    own = f"{path}/writer={hashlib.md5(checkpoint.encode()).hexdigest()}"
    tie = F.to_json(F.struct(*[c for c in stream.columns]))
    rows = _keyed(stream, keys, buckets).withColumn("tie__", tie)
    held = [p for p in children(spark, path) if not p.endswith(own.rsplit("/", 1)[1])]
    seed = None
    if held:
        known = read_appended(spark, path, skip=own).select(*keys)
        seed = _keyed(known, keys, buckets).select("bucket__", "key__").distinct().groupBy("bucket__")
    fresh = rows.groupBy("bucket__").transformWithStateInPandas(
        FirstOfKey(order, stream.columns), stream.schema, "append", "None", initialState=seed
    )
    return _to_files(fresh, own, checkpoint, trigger, _stateful(trigger))


def read_appended(spark: SparkSession, path: str, skip: str | None = None) -> DataFrame:
    """The rows of all writers of an append-once table, by the logs of their finished batches."""
    parts = [spark.read.parquet(p) for p in children(spark, path) if skip is None or p.rsplit("/", 1)[1] != skip.rsplit("/", 1)[1]]
    if not parts:
        raise ValueError(f"nothing was appended to {path}")
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


# --- running totals --------------------------------------------------------------------------


def stream_totals(
    stream: DataFrame, path: str, checkpoint: str, run: str = "run", trigger: Mapping = ALL_THERE_IS
) -> StreamingQuery:
    """Finished and good events per run so far; ``read_totals`` gives the newest.

    A batch writes all totals to a folder of its own; all but the last two are then removed.
    """
    totals = (
        stream.where(F.col("event") == "chunk_done").groupBy(run)
        .agg(F.count(F.lit(1)).alias("done"), F.count_if(F.col("ok")).alias("ok_count"))
    )

    def each(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        for old in children(batch.sparkSession, path):
            number = old.rsplit(f"{BATCH}=", 1)[-1]
            if number.isdigit() and int(number) < batch_id - 1:
                remove(batch.sparkSession, old)

    return (
        totals.writeStream.outputMode("complete").foreachBatch(each)
        .option("checkpointLocation", checkpoint).trigger(**trigger).start()
    )


def read_totals(spark: SparkSession, path: str) -> DataFrame:
    """The totals of the newest finished batch."""
    newest = max((p for p in children(spark, path, finished=True)), key=lambda p: int(p.rsplit("=", 1)[1]))
    return spark.read.parquet(newest)
