"""Session defaults, the shared scratch folder and lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def local_session(app: str = "casetable", cpus: str | int = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks. On a cluster use the session you are given."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("CASETABLE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as named by the session.

    Only a local session that names none (tests) is given a temporary folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("name a folder that all executors reach in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="casetable-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def scratch(spark: SparkSession, label: str) -> str:
    """A new, not yet existing path in the shared folder."""
    return f"{shared_dir(spark)}/casetable-{label}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """Write the rows to the reliable checkpoint folder and go on from there.

    Used where a later step depends on which partition a row is in: the rows of a
    partition then stay the same when executors are lost.
    """
    spark = df.sparkSession
    base = shared_dir(spark)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint(eager=True)


#: Bytes that a block of a range partitioning should hold at most, as far as Spark can tell.
BLOCK_BYTES = 256 << 20
MOST_BLOCKS = 1_000_000


def input_bytes(df: DataFrame) -> int:
    """The bytes of the stored tables that a plan reads, by Spark's statistics; what is not stored counts as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    tables = [leaves.apply(i) for i in range(leaves.size())]
    return sum(int(t.stats().sizeInBytes()) for t in tables if t.getClass().getSimpleName() in ("LogicalRelation", "DataSourceV2ScanRelation"))


def ranged(df: DataFrame, *keys: str, block_bytes: int | None = None) -> DataFrame:
    """Partitions by ranges of the keys: as many as the session says, more where these would be too large.

    The session's number does not grow with the data; that of large inputs follows their size.
    """
    needed = min(-(-input_bytes(df) // (block_bytes or BLOCK_BYTES)), MOST_BLOCKS)
    if needed > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.repartitionByRange(needed, *keys)
    return df.repartitionByRange(*keys)


def _file_system(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def children(spark: SparkSession, path: str, finished: bool = False) -> list[str]:
    """The folders below a path in any store that Spark reaches, by name; with ``finished`` those of ended writes."""
    at, files = _file_system(spark, path)
    if not files.exists(at):
        return []
    found = [s.getPath() for s in files.listStatus(at) if s.isDirectory() and not s.getPath().getName().startswith(("_", "."))]
    done = spark._jvm.org.apache.hadoop.fs.Path
    return sorted(p.toString() for p in found if not finished or files.exists(done(p, "_SUCCESS")))


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    at, files = _file_system(spark, path)
    files.delete(at, True)


def files(spark: SparkSession, path: str) -> list[str]:
    """The files right below a path, by name."""
    at, system = _file_system(spark, path)
    return sorted(s.getPath().toString() for s in system.listStatus(at) if s.isFile()) if system.exists(at) else []


def create_note(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file; False if there is one already, which the store decides."""
    at, system = _file_system(spark, path)
    try:
        out = system.create(at, False)
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    try:
        out.write(text.encode())
    finally:
        out.close()
    return True


def read_note(spark: SparkSession, path: str) -> str:
    return spark.read.text(path, wholetext=True).first()[0]
