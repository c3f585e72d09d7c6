"""Finding the files of runs: listings as tables, and which of several kinds of a file counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalgrove.sources.files import logical

#: Patterns of names by kind of file; of several patterns the first that a run has any of counts.
SCORED = (r"_scored\.jsonl$",)
JUDGED = (r"_judged\.jsonl_shard[0-3]\.jsonl$", r"^(?!.*shard).*judged.*\.jsonl$")
RESULTS = (r"^common_results\.json$", r"_results[^/]*\.json$")
#: All of these count, merged samples first.
SAMPLES = (r"_samples\.jsonl$", r"_samples_shard[^/]*\.jsonl$")


def listing(spark: SparkSession, *folders: str, pattern: str = "*.json*") -> DataFrame:
    """(path, run_dir, name) of the files under folders or at paths, folders of parts as the file that they make.

    Contents aren't read. A path that is missing is an error.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(list(folders))
    return found.select(logical(F.col("path")).alias("path")).distinct().select("path", F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("run_dir"), F.substring_index("path", "/", -1).alias("name"))


def matching(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """files whose name fits a pattern, with place, the first that it fits."""
    place = F.lit(None).cast("int")
    for i, pattern in reversed(list(enumerate(patterns))):
        place = F.when(F.regexp_like("name", F.lit(pattern)), i).otherwise(place)
    return files.withColumn("place", place).where("place is not null")


def preferred(files: DataFrame, patterns: Sequence[str], one: bool = False) -> DataFrame:
    """Of each run the files that fit the first pattern that any of its files fits; with one, the first of them by name."""
    fits = matching(files, patterns)
    if one:
        return fits.withColumn("_n", F.row_number().over(Window.partitionBy("run_dir").orderBy("place", "name"))).where("_n = 1").drop("_n")
    return fits.withColumn("_b", F.min("place").over(Window.partitionBy("run_dir"))).where("place = _b").drop("_b")
