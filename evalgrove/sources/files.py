"""Readers and writers: JSON lines (strict and tolerant), CSV lookups, TSV, shards, metrics, taxonomy tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BAD = "_corrupt_record"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def delete(spark: SparkSession, path: str) -> None:
    system, where = _at(spark, path)
    system.delete(where, True)


def rename(spark: SparkSession, path: str, to: str) -> None:
    """Moves a file or folder within one file system; an error if it can't be moved."""
    system, where = _at(spark, path)
    target = _at(spark, to)[1]
    system.mkdirs(target.getParent())
    if not system.rename(where, target):
        raise OSError(f"{path} could not be moved to {to}")


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, written aside and moved to its place, so that readers see all of it or nothing."""
    system, where = _at(spark, path)
    aside = _at(spark, re.sub("([^/]+)$", r"._\1", path))[1]
    out = system.create(aside, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(where, True)
    rename(spark, aside.toString(), path)


def read_text(spark: SparkSession, path: str) -> str:
    """One small file, hidden ones too, which Spark's readers pass over."""
    system, where = _at(spark, path)
    stream = system.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def paths_like(spark: SparkSession, pattern: str) -> list[str]:
    """Files and folders that a pattern of names fits, sorted."""
    system, where = _at(spark, pattern)
    return sorted(s.getPath().toString() for s in system.globStatus(where) or [])


def logical(path: Column) -> Column:
    """The file that a path is part of: Spark writes a file as a folder of parts, with folders of partitions between."""
    return F.regexp_replace(path, r"(/[^/=]+=[^/]*)*/part-[^/]*$", "")


def read_jsonl(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON lines; blank lines are skipped and a malformed line fails the job."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_jsonl_tolerant(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of JSON lines; a malformed line becomes a row of nulls with its text in _corrupt_record."""
    return spark.read.schema(f"{schema}, {BAD} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", BAD).json(path)


def parse_jsonl(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """The same from a table of lines; other columns, such as an ordinal, stay."""
    row = F.from_json(column, f"{schema}, {BAD} string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD})
    return lines.where(F.trim(F.col(column)) != "").withColumn("_row", row).select(*[c for c in lines.columns if c != column], "_row.*")


def write_jsonl(df: DataFrame, path: str, append: bool = False) -> None:
    df.write.mode("append" if append else "overwrite").json(path)


def read_lookup_csv(spark: SparkSession, path: str, key: str = "image_id", value: str = "path") -> DataFrame:
    """key, value, dataset of a two-column CSV with a header, the last line of a key counting."""
    rows = spark.read.option("header", True).schema(f"{key} string, {value} string").csv(path)
    return lookup(rows.withColumn("_line", F.monotonically_increasing_id()), key, value, "_line")


def lookup(rows: DataFrame, key: str = "image_id", value: str = "path", order: str | None = None) -> DataFrame:
    """One row a key, the last by order; keys and paths that are missing are left out."""
    rows = rows.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    last = F.max_by(value, order) if order else F.max(value)
    rows = rows.groupBy(key).agg(last.alias(value))
    first = F.substring_index(F.col(value), "/", 1)
    return rows.withColumn("dataset", F.when(F.contains(F.col(value), F.lit("/")) & (first != ""), first).otherwise(F.lit("unknown")))


def write_tsv(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_shards(df: DataFrame, path: str, shards: int, order: str = "ord") -> None:
    """JSON lines in a folder for each shard: a row's shard is its ordinal modulo shards."""
    df.withColumn("shard", (F.col(order) % shards).cast("int")).write.mode("overwrite").partitionBy("shard").json(path)


def read_chains(rows: DataFrame, order: str = "ord") -> DataFrame:
    """(id, taxonomy): the last chain of each id by order."""
    return rows.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by("taxonomy", order).alias("taxonomy"))


def distinct_ids(rows: DataFrame, *columns: str) -> DataFrame:
    """Distinct ids, each from the first of the columns that is neither null nor empty."""
    return rows.select(F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns]).alias("entity_id")).where("entity_id is not null").distinct()


def rows_by_file(spark: SparkSession, path: str | list[str], pattern: str = "*.jsonl", whole: bool = False) -> DataFrame:
    """(file, rows): non-blank lines of each file at or under path; with whole, a folder of parts counts as the file that it makes."""
    lines = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).text(path)
    file = F.col("_metadata.file_path")
    return lines.where(F.trim("value") != "").groupBy((logical(file) if whole else file).alias("file")).agg(F.count("*").alias("rows"))


def metrics_json(metrics: DataFrame) -> DataFrame:
    """One JSON text a run: flat for one measure, a list of measures for more."""
    one = metrics.groupBy("run", "measure").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value")))).alias("metrics"))
    many = one.groupBy("run").agg(F.array_sort(F.collect_list(F.struct("measure", F.to_json("metrics").alias("json")))).alias("all"))
    each = F.transform("all", lambda x: F.concat(F.lit('{"measure":"'), x["measure"], F.lit('","metrics":'), x["json"], F.lit("}")))
    return many.select("run", F.when(F.size("all") == 1, F.get("all", F.lit(0))["json"]).otherwise(F.concat(F.lit('{"measures":['), F.array_join(each, ","), F.lit("]}"))).alias("results"))
