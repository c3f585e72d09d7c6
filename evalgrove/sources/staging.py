"""Lineage cuts: a table written to the folder that all executors share, until the session ends or it is dropped."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from contextlib import suppress

from py4j.protocol import Py4JError
from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; a folder of our own only where it is unset, in local mode, where there is one machine."""
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


#: Folders that were made here and not dropped yet.
_LIVE: dict[str, SparkSession] = {}


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder, which clear() and the session's end delete."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _LIVE[path] = spark
    return path


def staged(df: DataFrame, name: str = "stage", compression: str | None = None) -> DataFrame:
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear() -> None:
    """Deletes all that was staged. Results that still read it have to be written before."""
    for path, spark in list(_LIVE.items()):
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        del _LIVE[path]


@atexit.register
def _end() -> None:
    if SparkContext._active_spark_context is not None:
        with suppress(Py4JError, OSError):  # the session may end at the same time
            clear()
