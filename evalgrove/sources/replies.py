"""A log of model replies, committed by chunk, so that a run that breaks off asks for nothing twice.

A chunk's replies are written to a folder of their own and counted only once a commit file names that folder. What
a broken chunk left behind is never read. Prompts go by their digest; those with a committed reply are not asked again,
whatever chunks they fall into in a later run. One run at a time may write a log.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrove.operators.judge import Source
from evalgrove.sources import files
from evalgrove.sources.staging import scratch_path

#: Prompts between two commits.
CHUNK = 100_000
_ROW = "key string, prompt string, completion int, reply string"


def prompt_key(prompt: Column) -> Column:
    return F.sha2(prompt, 256)


def chunk_of(key: Column, chunks: int) -> Column:
    """The chunk that a prompt falls into: 32 bits of its key modulo their number."""
    return (F.conv(F.substring(key, 1, 8), 16, 10).cast("long") % chunks).cast("int")


class ReplyLog:
    """Committed replies in a folder; those of other settings, such as another model, are kept apart."""

    def __init__(self, spark: SparkSession, folder: str, settings: str = ""):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.path = f"{self.folder}/{hashlib.md5(settings.encode()).hexdigest()[:12]}"

    def commits(self) -> list[dict]:
        """What each commit file says: data, the folder of its replies, and prompts, their number. One small file a chunk."""
        if not files.exists(self.spark, f"{self.path}/commits"):
            return []
        return [json.loads(r["value"]) for r in self.spark.read.text(f"{self.path}/commits").collect()]

    def replies(self) -> DataFrame:
        """(key, prompt, completion, reply) of all committed chunks."""
        folders = [f"{self.path}/data/{c['data']}" for c in self.commits()]
        return self.spark.read.schema(_ROW).parquet(*folders) if folders else self.spark.createDataFrame([], _ROW)

    def add(self, replies: DataFrame, prompts: int) -> None:
        """Writes a chunk and commits it: the commit file is there in whole or not at all."""
        data = uuid.uuid4().hex
        replies.select(prompt_key(F.col("prompt")).alias("key"), "prompt", F.col("completion").cast("int").alias("completion"), "reply").write.parquet(f"{self.path}/data/{data}")
        files.write_text(self.spark, f"{self.path}/commits/{data}.json", json.dumps({"data": data, "prompts": prompts}))

    def drop(self) -> None:
        files.delete(self.spark, self.folder)


class Logged:
    """A source that answers from a log and asks another source, a chunk at a time, for what the log lacks."""

    def __init__(self, source: Source, log: ReplyLog, chunk: int = CHUNK):
        self.source, self.log, self.chunk = source, log, chunk

    def in_round(self, number: int) -> Logged:
        """The same source for a round of its own: a prompt that was asked in another round is asked anew."""
        log = ReplyLog(self.log.spark, self.log.folder)
        log.path = f"{self.log.path}-round{number}"
        return Logged(self.source, log, self.chunk)

    def __call__(self, prompts: DataFrame) -> DataFrame:
        spark = prompts.sparkSession
        keyed = prompts.select("prompt").distinct().withColumn("key", prompt_key(F.col("prompt")))
        waiting, wanted = scratch_path(spark, "waiting"), scratch_path(spark, "wanted")
        keyed.write.parquet(wanted)
        keyed = spark.read.schema(keyed.schema).parquet(wanted)
        missing = keyed.join(self.log.replies().select("key").distinct(), "key", "left_anti")
        chunks = -(-missing.count() // self.chunk)
        if chunks:
            # a file a chunk, so that each chunk reads its own prompts only
            numbered = missing.withColumn("chunk", chunk_of(F.col("key"), chunks))
            numbered.repartition(min(chunks, 1000), "chunk").write.partitionBy("chunk").parquet(waiting)
        for number in range(chunks):
            asked = spark.read.schema("prompt string, key string, chunk int").parquet(waiting).where(F.col("chunk") == number).select("prompt")
            size = asked.count()
            if size:
                self.log.add(self.source(asked.repartition(spark.sparkContext.defaultParallelism)), size)
        files.delete(spark, waiting)
        return self.log.replies().join(keyed.select("key"), "key", "left_semi").select("prompt", "completion", "reply")


def logged(source: Source, spark: SparkSession, folder: str, settings: str = "", chunk: int = CHUNK) -> Logged:
    return Logged(source, ReplyLog(spark, folder, settings), chunk)
