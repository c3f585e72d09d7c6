"""Resuming as a stream: new sample files are read once, each id passes once, each batch is scored and appended.

Which ids have passed is told by what was written, not by state of the stream: a batch leaves out the ids in the
output of the batches before. So the stream keeps nothing but the list of files that it has read, however long it runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from evalgrove.operators.rollouts import row_key
from evalgrove.sources.files import exists

_DONE = "_evalgrove_done"


def new_samples(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the JSON-line rows that come to path, each file once."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).json(path)


def _unwritten(batch: DataFrame, number: int, out: str, key: str) -> DataFrame:
    """One row of each key of a batch that no earlier batch has written; rows without a key all stay."""
    keyless = row_key(F.col(key).cast("string"), F.lit(None).cast("string")).isNull()
    keyed = batch.where(~keyless).dropDuplicates([key])
    if exists(batch.sparkSession, out):
        # one narrow column of the output; its own folder is left out, so that a batch run again does the same
        kind = batch.schema[key].dataType.simpleString()
        done = batch.sparkSession.read.schema(f"`{key}` {kind}, batch long").parquet(out).where(F.col("batch") != number).select(F.col(key).alias(_DONE)).distinct()
        keyed = keyed.join(done, F.col(key) == F.col(_DONE), "left_anti")
    return keyed.unionByName(batch.where(keyless))


def append_scored(stream: DataFrame, score: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, available_now: bool = True, key: str = "data_id") -> StreamingQuery:
    """Scores each batch and writes it to a folder of its own number, so a batch that is run again replaces itself.

    score has to keep the key column.
    """

    def write(batch: DataFrame, number: int) -> None:
        score(_unwritten(batch, number, out, key)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
