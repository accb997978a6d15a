"""Helpers shared by the training-data operators: tables in the shared folder and size-checked joins."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: A side is broadcast only after its rows were counted and found to be at most this many.
BROADCAST_ROWS = 100_000


#: Temporary folders of applications that set no shared one (tests).
_temporary: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a temporary one on a local master only: executors
    of a cluster would each write to a disk of their own."""
    conf = spark.sparkContext.getConf()
    found = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _temporary:
            _temporary[app] = tempfile.mkdtemp(prefix="quillgrid-")
        found = _temporary[app]
    return found.rstrip("/") if "://" in found else "file://" + found.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new, unused path in the shared folder."""
    return f"{shared_dir(spark)}/quillgrid/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Spark deletes the shuffle files of a write once it is done: nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path, before = shared_path(spark, name), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table of :func:`stored` that nothing reads any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession) -> None:
    """Delete all tables and archives that this application has stored in the shared folder; their results end with them."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/quillgrid/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small_or_shuffled(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it was counted to have at most ``limit`` rows, else unchanged (a shuffle join)."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def ascii_lower(col):
    """Lower-case A-Z only."""
    return F.translate(col, UPPER, LOWER)


def number_of_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


#: Bytes of texts that go to a Python worker at once.
BATCH_BYTES = 8 << 20


def bound_batches(spark: SparkSession, most: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes in this session: 10,000 rows of long texts would be hundreds of megabytes in the JVM and
    in the worker.  A smaller bound that is set already stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key)
    if not now.isdigit() or int(now) > most:
        spark.conf.set(key, str(most))


def pieces_of(batches, rows: int = 1024):
    """The record batches in stretches of at most ``rows`` rows (no copies), so that few texts are Python objects at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def tiles_of(own, chunks):
    """The tiles (lo, hi) that the row of chunk ``own`` goes to in a group cut into ``chunks`` (null: one): each pair of chunks
    meets in one tile, so no task holds more than two chunks of a group."""
    one = F.array(F.struct(F.lit(0).alias("lo"), F.lit(0).alias("hi")))
    each = F.transform(F.sequence(F.lit(0), F.coalesce(chunks, F.lit(1)) - 1), lambda j: F.struct(F.least(own, j).alias("lo"), F.greatest(own, j).alias("hi")))
    return F.when(chunks.isNull(), one).otherwise(each)
