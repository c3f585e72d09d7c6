"""Places of rows in a total order, without a window over all of them.

A range exchange puts the rows in order over partitions; a row's place in its partition is the low half of
monotonically_increasing_id(), and the row counts of the partitions before give the rest. The only table that
one task sees whole has a row a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrove.sources.staging import staged


def numbered(rows: DataFrame, name: str = "ord", order: list[Column | str] | None = None) -> DataFrame:
    """rows with their place from 0 in a column of that name, by the order given, else as they are read.

    Rows that are equal in the order follow one another in no certain order. The rows are written once in order,
    so that places hold whatever the plan does later.
    """
    if order:
        parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        # the exchange reads its input twice, for the ranges and for the rows
        rows = staged(rows, "unordered").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    placed = staged(rows.withColumn("_at", F.monotonically_increasing_id()), "ordered").withColumn("_part", F.shiftright("_at", 33))
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(F.col("_part").alias("_p"), (before - F.col("_first")).alias("_shift"))
    joined = placed.join(F.broadcast(counts), F.col("_part") == F.col("_p"))
    return joined.withColumn(name, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_p", "_shift")
