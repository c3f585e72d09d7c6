"""What the corpus operators share: the shared folder, staged tables, and words."""

from __future__ import annotations

import atexit
import gc
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of rows that go to a Python worker at a time, about.
BATCH_BYTES = "4m"
#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where the session names none, a temporary folder serves in local mode, in which there is one machine; on a
    cluster that is an error, since no machine sees another's folders.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[.*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir has to name a folder that all machines share ({master})")
        own = tempfile.mkdtemp(prefix="evalgrove-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        folder = "file://" + own
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Tables and folders that wait for their end.
_LIVE: list[Folder] = []


class Folder:
    """A place in the shared folder, until it is dropped."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        _LIVE.append(self)

    def drop(self) -> None:
        if self in _LIVE:
            _LIVE.remove(self)
            path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


class Staged(Folder):
    """A table written to the shared folder, so that a lost executor never costs more than a reread."""

    def __init__(self, df: DataFrame, name: str):
        super().__init__(df.sparkSession, name)
        df.write.parquet(self.path)
        self.schema = df.schema

    @property
    def df(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)


def clear(keep: list[Folder] | None = None) -> None:
    """Drops all staged tables but those to keep. Results that still read them have to be written before."""
    for folder in [f for f in _LIVE if f not in (keep or [])]:
        folder.drop()


@contextmanager
def scratch(keep: list[Folder]) -> Iterator[None]:
    """Drops at its end what was staged inside, but for what was put into keep meanwhile."""
    before = list(_LIVE)
    try:
        yield
    finally:
        clear(before + keep)


@atexit.register
def _end() -> None:
    if SparkContext._active_spark_context is not None:
        with suppress(Py4JError, OSError):  # the session may end at the same time
            clear()


def release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished steps before the next ones are written.

    Spark deletes them once the driver has collected their handles; the second call takes what the first
    made unreachable.
    """
    for _ in range(2):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(0.5)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the bytes of an Arrow batch where the session names no bound of its own.

    Spark's is 64 MB: both ends of a worker's pipe hold it, with what a growing buffer was before, and workers and
    executors keep that memory for the steps that follow. A single longer row is still a batch.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1000) -> Iterator[pa.RecordBatch]:
    """The batches in parts of some rows, so that a worker holds few texts, and their results, at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def byte_slices(batches: Iterator[pa.RecordBatch], column: str, limit: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most so many bytes in a text column; a longer text is a part of its own."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
            yield batch.slice(at, to - at)
            at = to


def word_count(text):
    """Column: number of words, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased; bytes.split() and bytes.lower() know ASCII only, as WORD does."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []
