"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than space and the five ASCII control spaces.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a side may have before it is no longer broadcast.
BROADCAST_ROWS = 100_000
#: Bytes of rows that go to a Python worker at once.
BATCH = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one only in local sessions that set none."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path:
        return path.rstrip("/")
    path = spark.sparkContext.getCheckpointDir()
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A staged table as the small side of a join: broadcast while it has few rows, else left to a shuffled join,
    whose large partitions adaptive execution splits."""
    return F.broadcast(df) if df.count() <= rows else df


def bounded(spark: SparkSession) -> None:
    """From here on, rows go to the session's Python workers in batches of about BATCH bytes (of up to 10,000 rows and 64 MB
    by default, which both sides hold, with copies), and Parquet column chunks are read in parts on the heap (by default whole,
    through buffers outside it that the reading threads keep). What the session has set itself stays."""
    for key, value in (("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH)), ("parquet.hadoop.vectored.io.enabled", "false")):
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def lean(run: Callable) -> Callable:
    """run, a function for mapInArrow, which gives free memory back when a task ends: workers that wait for tasks stand
    beside those of the stages that follow."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        getattr(ctypes.CDLL(None), "malloc_trim", lambda _: None)(0)

    return task


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def n_words(text: Column) -> Column:
    """Number of words in a text; 0 for null."""
    spaced = F.translate(F.coalesce(text, F.lit("")), "\t\n\x0b\x0c\r", " " * 5)
    return F.size(F.array_remove(F.split(spaced, " "), "")).cast("long")


def text_groups(batch: pa.RecordBatch, column: int, size: int, rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most rows rows and about size bytes of text each, a longer text in a slice of its own: a
    task's memory follows the longest text, not the number of long texts in a batch."""
    held = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        before = held[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(held, before + size, side="right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi
