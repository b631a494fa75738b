"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, where texts are long.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """df, after its session has been told to cut Arrow batches at BATCH_BYTES, unless they are smaller: ten thousand whole
    texts at once don't fit a Python worker."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxBytesPerBatch"
    now = conf.get(key).lower().rstrip("b")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        conf.set(key, str(BATCH_BYTES))
    return df


_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def release() -> None:
    """Gives freed memory back. Python workers live on through many tasks, and would else hold what the largest slice took."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share. Where the session names none, a local one; but only where
    driver and executors are one process."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="assayer-"))
    return sc.getCheckpointDir()


class _Open(threading.local):
    """Paths of each scratch() that is open in this thread."""

    def __init__(self):
        self.stack: list[list[str]] = []


_OPEN = _Open()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What is stored within is deleted at the end, but for what is kept. Results must not read it lazily afterwards."""
    _OPEN.stack.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for path in _OPEN.stack.pop():
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(conf).delete(p, True)


def place(spark: SparkSession, what: str, keep: bool = False) -> str:
    """A new path in the shared folder. What is written there stays as long as the scratch() around it; with keep, as the one
    around that. Without one, it is the caller's to delete."""
    path = f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    around = _OPEN.stack[: len(_OPEN.stack) - keep]
    if around:
        around[-1].append(path)
    return path


def stored(df: DataFrame, what: str, keep: bool = False) -> DataFrame:
    """Writes df as Parquet into a place() and reads it back: lineage ends there, and each reader scans it."""
    spark = df.sparkSession
    path = place(spark, what, keep)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
