"""Where the images of examples are: paths met with a listing of files, by other suffixes where the path itself is not there.

Nothing is decoded and no content is read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Suffixes that are tried in this order in place of a path's own.
SUFFIXES = (".JPEG", ".jpeg", ".JPG")


def image_files(spark: SparkSession, *folders: str) -> DataFrame:
    """(file) of all files under folders, as plain paths."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(folders))
    return found.select(F.regexp_replace("path", "^file:/+", "/").alias("file"))


def candidates(path: Column) -> Column:
    """A path and, in order, those with other suffixes, as structs of rank and file."""
    bare = F.regexp_replace(path, r"(?<=[^/])\.[^./]+$", "")
    return F.array(F.struct(F.lit(0).alias("rank"), path.alias("file")), *[F.struct(F.lit(i).alias("rank"), F.concat(bare, F.lit(s)).alias("file")) for i, s in enumerate(SUFFIXES, 1)])


def resolve(examples: DataFrame, files: DataFrame, root: str = "", path: str = "image_path") -> DataFrame:
    """examples with image_file: the first candidate of their path, below root if it is relative, that is among files; null if none is.

    files: (file). Distinct paths meet the listing by equality, however many examples share one; empty and null paths
    have no file.
    """
    at = F.col(path) if not root else F.when(F.startswith(F.col(path), F.lit("/")), F.col(path)).otherwise(F.concat(F.lit(root.rstrip("/") + "/"), F.col(path)))
    asked = examples.where(F.col(path) != "").select(path).distinct()
    tried = asked.select(F.col(path).alias("_p"), F.explode(candidates(at)).alias("c")).select("_p", "c.rank", F.col("c.file").alias("_f"))
    met = tried.join(files.select(F.col("file").alias("_g")).distinct(), F.col("_f") == F.col("_g")).groupBy("_p").agg(F.min_by("_f", "rank").alias("image_file"))
    return examples.drop("image_file").join(met, F.col(path) == F.col("_p"), "left").drop("_p")


def missing_images(resolved: DataFrame, path: str = "image_path") -> DataFrame:
    """One row (examples, without_path, not_found)."""
    blank = F.coalesce(F.col(path) == "", F.lit(True))
    return resolved.agg(F.count("*").alias("examples"), F.count_if(blank).alias("without_path"), F.count_if(~blank & F.col("image_file").isNull()).alias("not_found"))
