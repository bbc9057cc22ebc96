"""Reading tables, shards, logs and stored results."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from casetable.functions.text import canonical_id
from casetable.operators.joins import join_spread
from casetable.session import settle

CORRUPT = "_corrupt_record"

LOG_SCHEMA = (
    "event string, run string, seq bigint, ts timestamp_ntz, problem_id bigint, ok boolean, "
    "call_elapsed_cs bigint, error string, solution_indices array<bigint>, progress string, total_elapsed_cs bigint"
)
RESULT_SCHEMA = (
    "problem_id bigint, solution_order bigint, testcase_order bigint, error boolean, "
    "timed_out boolean, expected_output string, actual_output string, validation boolean"
)


def _quoted(escape: str) -> str:
    """What may stand between the quotes of a cell, as a pattern that never steps back."""
    if escape == '"':
        return r'[^"]*+(?:""[^"]*+)*+'
    return rf'[^"{re.escape(escape)}]*+(?:{re.escape(escape)}.[^"{re.escape(escape)}]*+)*+'


def _ends_inside(line: Column, escape: str) -> Column:
    """Whether a line that begins outside quotes ends inside of some: its last cell has none that closes it."""
    inner = _quoted(escape)
    cells = rf'(?:(?:[ \t]*"{inner}"[^,]*+|[^,"][^,]*+|),)*+'
    return line.rlike(rf'(?s)\A{cells}[ \t]*"{inner}\z').cast("int")


def _ends_inside_again(line: Column, escape: str) -> Column:
    """The same for a line that begins inside quotes."""
    closed = F.regexp_replace(line, rf'(?s)\A{_quoted(escape)}"[^,]*+', "closed")
    stays = line.rlike(rf"(?s)\A{_quoted(escape)}\z")
    return F.when(stays, 1).otherwise(_ends_inside(closed, escape))


def csv_records(spark: SparkSession, path: str, escape: str = '"') -> DataFrame:
    """The records of CSV files as text, ``record``, with ``first`` for the first of a file.

    Cells may hold line ends, and yet a file is read in as many tasks as it has splits. Each line maps
    the state before it, outside or inside quotes, to the state behind it. Lines of a split are put together
    first, then the splits of a file, one row each; a line's own state follows from both. Lines
    outside quotes at both ends are records; other lines are joined up to the one that closes the
    quotes, inside their split as far as it goes, and only what crosses a border is moved once more.

    A record ends with a line feed, a carriage return before it is dropped. Blank lines are left out.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
    )
    quoted = F.contains("value", F.lit('"'))
    lines = lines.withColumns({
        "_out": F.when(quoted, _ends_inside(F.col("value"), escape)).otherwise(0),
        "_in": F.when(quoted, _ends_inside_again(F.col("value"), escape)).otherwise(1),
    })
    fixed = F.col("_out") == F.col("_in")  # behind such a line the state is known; others keep or turn it
    here = W.partitionBy("file", "split").orderBy("at")
    upto = here.rowsBetween(W.unboundedPreceding, W.currentRow)
    lines = lines.withColumns({
        "_known": F.when(fixed, F.col("_out")), "_turns": F.sum(F.when(~fixed & (F.col("_out") == 1), 1).otherwise(0)).over(upto),
    }).withColumn("_turns_known", F.last(F.when(fixed, F.col("_turns")), ignorenulls=True).over(upto)).withColumns({
        "_known": F.last("_known", ignorenulls=True).over(upto),
        "_turned": (F.col("_turns") - F.coalesce("_turns_known", F.lit(0))) % 2,
    })
    # what a split's first lines do to the state, up to each line; settled, as splits may be cut otherwise when read again
    lines = settle(lines.select(
        "file", "split", "at", "value", F.col("_out").alias("opens"),
        F.lag("_known").over(here).alias("known"), F.coalesce(F.lag("_turned").over(here), F.lit(0)).alias("turned"),
        F.struct("_known", "_turned").alias("after"), F.row_number().over(here).alias("line"),
    ))

    def behind(known: Column, turned: Column, state: Column) -> Column:
        return F.coalesce(known, state).bitwiseXOR(turned.cast("int"))

    ends = lines.groupBy("file", "split").agg(F.max("at").alias("at")).join(lines, ["file", "split", "at"])
    # one row a split; its state goes from split to split of a file
    splits = ends.select("file", "split", F.col("after._known").alias("known"), F.col("after._turned").alias("turned"))
    in_file = W.partitionBy("file").orderBy("split")
    so_far = in_file.rowsBetween(W.unboundedPreceding, W.currentRow)
    splits = splits.withColumn("turns", F.sum("turned").over(so_far)).withColumns({
        "fixed": F.last("known", ignorenulls=True).over(so_far),
        "turns_fixed": F.last(F.when(F.col("known").isNotNull(), F.col("turns") - F.col("turned")), ignorenulls=True).over(so_far),
    }).withColumn("state", F.coalesce("fixed", F.lit(0)).bitwiseXOR(((F.col("turns") - F.coalesce("turns_fixed", F.lit(0))) % 2).cast("int")))
    starts = splits.select("file", "split", F.coalesce(F.lag("state").over(in_file), F.lit(0)).alias("state"))

    placed = join_spread(lines, starts, ["file", "split"]).withColumn("inside", behind(F.col("known"), F.col("turned"), F.col("state")))
    starts_record = F.col("inside") == 0
    first = (F.col("split") == 0) & (F.col("line") == 1)
    whole = placed.where(starts_record & (F.col("opens") == 0)).select(F.col("value").alias("record"), first.alias("first"))

    # pieces of longer records inside a split; a piece without a start belongs to the last one of an earlier split
    parts = placed.where(~starts_record | (F.col("opens") == 1))
    parts = parts.withColumn("start", F.max(F.when(starts_record, F.col("at"))).over(upto))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]), "\n")
    pieces = settle(parts.groupBy("file", "split", "start").agg(text.alias("text"), F.max(first).alias("first")))
    last_start = pieces.groupBy("file", "split").agg(F.max("start").alias("last"))
    owners = last_start.select(
        "file", "split",
        F.last("last", ignorenulls=True).over(in_file.rowsBetween(W.unboundedPreceding, -1)).alias("owner"),
    )
    owned = pieces.join(owners, ["file", "split"]).withColumn("owner", F.coalesce("start", "owner"))
    cells = F.array_sort(F.collect_list(F.struct("split", F.coalesce("start", F.lit(-1)).alias("start"), "text")))
    longer = owned.groupBy("file", "owner").agg(
        F.array_join(F.transform(cells, lambda x: x["text"]), "\n").alias("record"), F.max("first").alias("first")
    ).select("record", "first")
    out = whole.unionByName(longer).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    bom = F.when(F.col("first"), F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record"))
    return out.withColumn("record", bom).where((F.col("record") != "") | F.col("first"))


def _csv(
    spark: SparkSession, path: str, schema: T.StructType, header: bool, escape: str, line_ends: bool, corrupt: str | None = None
) -> DataFrame:
    options = {"escape": escape, "encoding": "UTF-8"}
    if corrupt is not None:
        options |= {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": corrupt}
    if not line_ends:
        return spark.read.schema(schema).options(header=header, **options).csv(path)
    records = csv_records(spark, path, escape)
    if header:
        records = records.where(~F.col("first"))
    records = records.where("record <> ''")
    cells = F.from_csv("record", ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields), {**options, "multiLine": "true"})
    return records.select(cells.alias("cells")).select("cells.*")


def read_csv(spark: SparkSession, path: str, schema: str | T.StructType, line_ends: bool = True) -> DataFrame:
    """CSV with a header, quoted line ends and doubled quotes, read in as many tasks as the files have splits.

    Without ``line_ends`` in cells every line is a record, and nothing has to be put together.
    """
    return _csv(spark, path, _struct(schema), True, '"', line_ends)


def _struct(schema: str | T.StructType) -> T.StructType:
    return T._parse_datatype_string(schema) if isinstance(schema, str) else schema


def cell_count(record: Column, escape: str = '"') -> Column:
    """The number of cells in the text of a CSV record."""
    inner = r'(?:[^"]|"")*' if escape == '"' else rf'(?:[^"{re.escape(escape)}]|{re.escape(escape)}.)*'
    bare = F.regexp_replace(record, rf'(?s)(^|,)\s*"{inner}"', "$1")
    return F.length(bare) - F.length(F.translate(bare, ",", "")) + 1


def read_csv_tolerant(
    spark: SparkSession, path: str, schema: str | T.StructType, key_cols: Sequence[str], header: bool = True,
    escape: str = '"',
) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected rows as text with a ``reason``.

    Reasons: ``short`` or ``long`` for another number of cells than columns, ``key`` where a key is
    no number in the long range, ``type`` where a cell does not have its declared type. Keys are
    declared as text in ``schema`` and come back as whole numbers. An empty cell is null.
    ``record`` holds the whole text of rows that are short or long.
    """
    fields = _struct(schema).fields
    texts = T.StructType([T.StructField(f.name, T.StringType()) for f in fields] + [T.StructField(CORRUPT, T.StringType())])
    raw = _csv(spark, path, texts, header, escape, True, CORRUPT)
    typed = {
        f.name: canonical_id(F.col(f.name)) if f.name in key_cols else F.col(f.name).try_cast(f.dataType) for f in fields
    }
    unkeyed, misfit = F.lit(False), F.lit(False)
    for name, value in typed.items():
        if name in key_cols:
            unkeyed = unkeyed | value.isNull()
        else:
            misfit = misfit | (F.col(name).isNotNull() & value.isNull())
    cells = cell_count(F.col(CORRUPT), escape)
    reason = F.when(cells < len(fields), "short").when(cells > len(fields), "long").when(unkeyed, "key").when(misfit, "type")
    marked = raw.withColumn("reason", reason)
    good = marked.where(F.col("reason").isNull()).select(*[v.alias(n) for n, v in typed.items()])
    record = F.rtrim(F.col(CORRUPT), F.lit("\r\n")).alias("record")
    return good, marked.where(F.col("reason").isNotNull()).select(*typed, "reason", record)


def read_corpus(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet corpus; named columns that are absent are left out."""
    df = spark.read.parquet(path)
    return df if columns is None else df.select(*[c for c in columns if c in df.columns])


def read_shards(
    spark: SparkSession, glob: str, rank_regex: str, schema: str | None = None, fmt: str = "parquet"
) -> DataFrame:
    """All shards that match the glob as one table, with the ``rank`` taken from their path.

    One scan, however many shards there are; columns missing from a shard are null.
    """
    if fmt == "parquet":
        reader = spark.read.option("mergeSchema", schema is None)
        df = (reader.schema(schema) if schema else reader).parquet(glob)
    else:
        df = read_csv(spark, glob, schema)
    rank = F.regexp_extract(F.col("_metadata.file_path"), rank_regex, 1).try_cast("bigint")
    return df.select("*", rank.alias("rank"))


def parse_log(lines: DataFrame, schema: str = LOG_SCHEMA) -> DataFrame:
    """Log lines as columns; lines that are no JSON objects keep their ``raw`` text only."""
    event = F.from_json("value", schema)
    held = lines.where(F.length("value") > 0).select("value", event.alias("_e"))
    parsed = F.col("value").startswith("{") & F.col("_e.event").isNotNull()
    names = [f.name for f in T._parse_datatype_string(schema).fields]
    return held.select(
        *[F.when(parsed, F.col(f"_e.{n}")).alias(n) for n in names],
        F.when(~parsed, F.col("value")).alias("raw"),
    )


def read_log(spark: SparkSession, path: str, schema: str = LOG_SCHEMA, stream: bool = False) -> DataFrame:
    """A JSON-lines log, as a table or as a stream."""
    reader = spark.readStream if stream else spark.read
    return parse_log(reader.text(path), schema)


def read_results(spark: SparkSession, path: str, schema: str = RESULT_SCHEMA) -> DataFrame:
    """A folder of per-solution result files as one table: no listing, no loop over files."""
    return read_csv(spark, path, schema)
