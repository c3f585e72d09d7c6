"""Tables that are filled as they are asked for: answers of a slow source by key, and vectors of taxonomy nodes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrove.functions.metrics import cache_key
from evalgrove.operators.rollouts import remaining
from evalgrove.sources.files import exists
from evalgrove.sources.staging import staged


def cached(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """The rows that a cache holds so far; none if there is no cache yet."""
    return spark.read.schema(schema).parquet(folder) if exists(spark, folder) else spark.createDataFrame([], schema)


def filled(keys: DataFrame, fetch: Callable[[DataFrame], DataFrame], folder: str, schema: str, key: str = "id", batch: int = 100_000) -> DataFrame:
    """The cached rows of the keys. fetch is asked only for keys that the cache lacks, about a batch at a time.

    Each batch is appended as one commit, so a run that breaks off goes on after its last batch. Keys that fetch
    knows nothing of are asked for again by the next call. One call at a time may fill a folder.
    """
    spark = keys.sparkSession
    wanted = keys.where(F.col(key).isNotNull()).select(key).distinct()
    # written before the first batch, for a batch changes what is missing
    missing = staged(remaining(wanted, cached(spark, folder, schema), key), "missing")
    parts = -(-missing.count() // batch)
    for part in range(parts):
        asked = missing.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)
        fetch(asked).write.mode("append").parquet(folder)
    return cached(spark, folder, schema).join(wanted, key, "left_semi")


def node_vectors(nodes: DataFrame, encode: Callable[[DataFrame], DataFrame], folder: str, model: str) -> DataFrame:
    """encode(nodes) (label, ord, embedding), kept in a table named by the model and by the md5 of the labels in order.

    A table without its _SUCCESS mark broke off and is written anew. nodes is a reference table; its labels are joined in
    one task for the key.
    """
    spark = nodes.sparkSession
    labels = nodes.agg(F.array_sort(F.collect_list(F.struct("ord", "label"))).alias("l"))
    (name,) = labels.select(cache_key(F.transform("l", lambda x: x["label"]))).head()
    path = f"{folder.rstrip('/')}/{model.rsplit('/', 1)[-1]}_{name}"
    if not exists(spark, f"{path}/_SUCCESS"):
        encode(nodes).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
