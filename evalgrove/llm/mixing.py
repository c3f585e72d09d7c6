"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

Every document of a source is expected as often as its source's target holds the source's words. The
expected copies are prefix-summed within the source, in order of size, and a copy is emitted for each
integer that the running sum, moved by one random offset of the source, crosses. In order of size the
words taken stay within one document's size of the target.

The running sum needs each row's rank in its source. One range exchange on (source, size, id) yields
ordered partitions; a row's place in its partition is the low half of monotonically_increasing_id(), and
counts by (partition, source), of which there are at most partitions + sources, give the rest. So a
source with a third of all rows is spread over as many tasks as its rows deserve.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
#: Names that no column of documents has.
_ID, _COPIES, _ROW, _AT, _NTH = "_evalgrove_id", "_evalgrove_copies", "_evalgrove_row", "_evalgrove_at", "_evalgrove_nth"


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """Adds weight and target to (source, source_size), one row a source.

    Sources take the weights by code point, null last, repeating. The sources whose limit of max_repeat
    times their size lies below their share are those of least size by weight, so the water level is
    found by one running sum in that order: what those before a source leave, shared by the weights of
    it and all after it. An empty source has target 0.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    table = F.array(*[F.lit(float(w)) for w in weights])
    weighed = sizes.withColumn("weight", F.element_at(table, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("limit", F.col("source_size") * float(max_repeat))
    rising = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    weighed = weighed.withColumn("level", level)
    # the first source that its limit doesn't hold down sets the level of all after it
    free = F.min(F.when(F.col("limit") > F.col("level") * F.col("weight"), F.struct(F.col("limit") / F.col("weight"), F.col("level")))).over(everything)
    shared = F.coalesce(free["level"] * F.col("weight"), F.col("limit"))
    return weighed.withColumn("target", F.least(F.col("limit"), shared)).drop("limit", "level")


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source, the same in every run: 48 bits of a digest."""
    digest = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.concat(F.lit("s"), source), F.lit("null"))))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, max_repeat: float = MAX_REPEAT, seed: int = 1) -> DataFrame:
    """(id, source, size, source_size, target, copies, taken) of every row.

    A null text has size 0 and null is a source of its own. Rows that repeat, id included, are rows of
    their own; which of them gets a copy makes no difference. No rows give no rows. Other columns of
    docs are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = Staged(rows, "sizes").df  # a range exchange reads its input twice: the sizes, not the texts
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(n, F.col("source").asc_nulls_last(), "size", "id").sortWithinPartitions(F.col("source").asc_nulls_last(), "size", "id")
    ordered = Staged(ordered.withColumn("at", F.monotonically_increasing_id()), "mix").df
    ordered = ordered.withColumn("part", F.shiftright("at", 33))

    parts = ordered.groupBy("part", "source").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.sum("size").alias("part_size"))
    sources = targets(parts.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, max_repeat)
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    parts = parts.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    parts = parts.select(F.col("part").alias("p"), F.col("source").alias("s"), "first", "before", "source_size", "target", offset(F.col("source"), seed).alias("u"))

    joined = ordered.join(parts, (F.col("part") == F.col("p")) & F.col("source").eqNullSafe(F.col("s")))
    rank = F.col("before") + F.col("at") - F.col("first")
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rate = F.least(rate, F.lit(float(max_repeat)))
    whole, part = F.floor(rate), rate - F.floor(rate)
    copies = (whole + F.floor((rank + 1) * part + F.col("u")) - F.floor(rank * part + F.col("u"))).cast("long")
    return joined.withColumn("copies", copies).select(F.col("id").alias(id_col), "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def emit(docs: DataFrame, mixed: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs, each as often as mix() says, numbered from 0 in column copy, which replaces one of that name.

    Rows of one id, source and size, null ones too, are numbered on both sides and meet by number; they weigh
    the same, so which of them gets a copy makes no difference.
    """
    drawn = mixed.where(F.col("copies") > 0).select(F.struct(F.col(id_col).alias("id"), F.col("source"), F.col("size")).alias(_ID), "copies")
    drawn = drawn.select(_ID, F.row_number().over(Window.partitionBy(_ID).orderBy(F.desc("copies"))).alias(_NTH), F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")).alias(_COPIES))
    row = F.struct(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"))
    rows = docs.drop("copy").withColumn(_ROW, row)
    rows = rows.withColumn(_AT, F.row_number().over(Window.partitionBy(_ROW).orderBy(F.xxhash64(text_col))))
    out = rows.join(drawn, (F.col(_ROW) == F.col(_ID)) & (F.col(_AT) == F.col(_NTH)))
    return out.withColumn("copy", F.explode(_COPIES)).drop(_ROW, _AT, _ID, _NTH, _COPIES)
