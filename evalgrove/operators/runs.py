"""The catalog of runs: status from files, latest run, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrove.functions.text import model_slug

#: Run ids are date, time and six random digits.
RUN_ID = r"^\d{8}_\d{6}_\d{6}$"


def catalog(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """One row a run. files: (run_dir, name, rows); metadata: (run_dir, model, dataset_path, prompt, no_image, num_shards, shard_examples).

    Merged samples give the number of examples, else the shards together, else the metadata. A run without
    metadata crashed.
    """
    name = F.col("name")
    shard = F.contains(name, F.lit("_shard"))
    samples = F.endswith(name, F.lit("_samples.jsonl")) & ~shard & ~F.contains(name, F.lit("_judged"))
    sample_shard = F.regexp_like(name, F.lit(r"_samples_shard[^/]*\.jsonl$"))
    per = files.groupBy("run_dir").agg(
        F.max(F.when(samples, F.col("rows"))).alias("merged"), F.sum(F.when(sample_shard, F.col("rows"))).alias("sharded"),
        F.count_if(F.endswith(name, F.lit("_scored.jsonl"))).alias("scored"),
        F.count_if(F.contains(name, F.lit("_judged")) & F.endswith(name, F.lit(".jsonl")) & ~shard).alias("judged"),
        F.count_if(F.regexp_like(name, F.lit(r"_results[^/]*\.json$"))).alias("results"),
        F.count_if(samples | sample_shard).alias("_samples"),
    )
    meta = metadata.withColumnRenamed("run_dir", "_dir")
    out = per.join(meta, F.col("run_dir") == F.col("_dir"), "left")
    status = (
        F.when(F.col("_dir").isNull(), "crashed").when((F.col("results") > 0) | (F.col("scored") > 0), "complete")
        .when(F.col("judged") > 0, "judged").when(F.col("_samples") > 0, "samples").otherwise("empty")
    )
    known = F.coalesce(F.nullif(F.coalesce("merged", "sharded"), F.lit(0)), F.col("num_shards") * F.col("shard_examples"), F.lit(0))
    return out.select(
        "run_dir", F.when(F.contains("dataset_path", F.lit("aligned")), "aligned").when(F.col("_dir").isNotNull(), "original").otherwise("").alias("dataset"),
        F.coalesce("prompt", F.lit("")).alias("prompt"), F.coalesce(F.col("no_image").cast("string"), F.lit("false")).alias("no_image"),
        F.coalesce(model_slug(F.col("model")), F.lit("")).alias("model"), known.cast("long").alias("total_examples"), status.alias("status"),
        "scored", "judged", "results", (F.coalesce(model_slug(F.col("judge_model")), F.lit("")) if "judge_model" in metadata.columns else F.lit("")).alias("judge_model"),
    )


def latest(runs: DataFrame, **filters: str) -> DataFrame:
    """The last run directory in order among those whose columns have the given values."""
    for column, value in filters.items():
        runs = runs.where(F.col(column) == value)
    return runs.orderBy(F.col("run_dir").desc()).limit(1)


def latest_by(runs: DataFrame, key: str, run_id: str = "run_id") -> DataFrame:
    """The last well-formed run id of each key."""
    return runs.where(F.regexp_like(F.col(run_id), F.lit(RUN_ID))).groupBy(key).agg(F.max(run_id).alias(run_id))
