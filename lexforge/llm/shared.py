"""What several operators need from the session."""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ready_checkpoints(spark: SparkSession) -> None:
    """Keeps the cluster's shared checkpoint folder; one of our own only in local mode, where driver and executors are one machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lexforge-"))


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared checkpoint folder."""
    ready_checkpoints(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


#: Rows and bytes that Python gets at once: a worker's memory must not follow the length of texts.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def bound_batches(spark: SparkSession) -> None:
    """Lowers (never raises) the session's Arrow batch limits; plans read them when they run, so they stay set."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = str(spark.conf.get(key)).rstrip("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def release() -> None:
    """Gives memory that this process freed, and its allocators keep, back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's alone
    if trim is not None:
        trim(0)


def gives_back(run: Callable) -> Callable:
    """A function for mapInArrow or applyInArrow that releases memory when it ends: Python workers wait for further tasks and would keep it from the executor meanwhile."""
    if inspect.isgeneratorfunction(run):

        @functools.wraps(run)
        def freed(*args):
            try:
                yield from run(*args)
            finally:
                release()
    else:

        @functools.wraps(run)
        def freed(*args):
            try:
                return run(*args)
            finally:
                release()

    freed.__signature__ = inspect.signature(run)  # Spark counts the arguments
    return freed


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """UTF-8 bytes of all texts: one column, one number."""
    return docs.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def stored(df: DataFrame) -> DataFrame:
    """The rows as Parquet in the shared checkpoint folder, read again: cuts lineage and keeps column pruning."""
    path = shared_path(df.sparkSession, "stored")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
