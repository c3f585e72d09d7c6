"""Exact dedup by progressive refinement, in DataFrame operations only: length, then prefix hash, then full hash.

Texts are equal when they are identical after A-Z became a-z, which leaves lengths in bytes as they are. Lengths of
all rows are counted first; rows whose length another row has too are counted by length and hash of their first
characters; only rows that share both have their whole text hashed. Each level is one aggregation with map-side
combine, so a group of copies with a third of all rows is counted where its rows lie, and texts are never shuffled.

Length classes, at most some 560,000 whatever the corpus, are broadcast. Groups by prefix grow with the corpus: up to
BROADCAST_PREFIXES of them, counted, are broadcast, and texts of the others are never hashed. Beyond, every row that
passed the lengths is hashed where it is read, because to move a digest costs less than to move a text, and the answer
is the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Staged

#: Characters that the second level looks at.
PREFIX = 64
#: Groups by length and prefix that are broadcast at most.
BROADCAST_PREFIXES = 500_000
#: A class with more than one of so many rows of the table is hot; so there are fewer hot classes than this.
HOT_SHARE = 1000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Names that no column of documents has.
_ROW, _HOT, _COOL = "_evalgrove_row", "_evalgrove_hot", "_evalgrove_cool"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.translate(text, _UPPER, _LOWER)


def _length_class(size: Column) -> Column:
    """Lengths below 65,536 as they are, longer ones by their 16 leading bits: at most 65,536 + 15 * 32,768 classes."""
    narrow = reduce(lambda found, bits: F.when(size < (1 << bits), F.shiftright(size, bits - 16) + F.lit(bits << 16)).otherwise(found), range(31, 16, -1), size)
    return F.when(size < 65_536, size).otherwise(narrow)


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    size = F.octet_length(text).cast("int")
    prefix = F.xxhash64(lowered(F.substring(text, 1, PREFIX)))
    return docs.select(F.col(id_col).alias("id"), text.alias("text"), size.alias("size"), _length_class(size).alias("long"), prefix.alias("prefix"))


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digests: bool = False, broadcast_prefixes: int = BROADCAST_PREFIXES) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row of docs.

    Of equal texts the row of the largest id stays; a null id is less than any, and of rows that are equal in id too
    exactly one is marked as kept. A null text counts as empty. text_sha256 is the digest of the lower-cased text where
    a refinement needed it, null elsewhere; with digests every row has it. No rows give no rows; other columns
    of docs are not read.
    """
    rows = _rows(docs, id_col, text_col)
    lengths = Staged(rows.groupBy("long").count().where("count > 1").select(F.col("long").alias("l")), "lengths").df
    shared = rows.join(F.broadcast(lengths), F.col("long") == F.col("l"), "left")

    alike = shared.where("l IS NOT NULL").groupBy("size", "prefix").count().where("count > 1")
    alike = Staged(alike.select(F.col("size").alias("s"), F.col("prefix").alias("p")), "prefixes").df
    few = alike.limit(broadcast_prefixes + 1).count() <= broadcast_prefixes
    met = (F.col("size") == F.col("s")) & (F.col("prefix") == F.col("p"))
    if few:
        shared = shared.join(F.broadcast(alike), met, "left")
        hashed = F.col("p").isNotNull()
    else:
        hashed = F.col("l").isNotNull()
    digest = F.sha2(lowered(F.col("text")), 256)
    digest = digest if digests else F.when(hashed, digest)
    # written, so that row numbers hold and texts are read once for the result
    found = shared.select("id", hashed.alias("meets"), digest.alias("sha"), F.monotonically_increasing_id().alias("row"))
    found = Staged(found, "digests").df

    alone, rivals = found.where("NOT meets"), found.where("meets")
    groups = rivals.groupBy("sha").agg(F.count("*").alias("n"), F.max(F.struct("id", "row")).alias("keep")).where("n > 1")
    groups = Staged(groups.select(F.col("sha").alias("g"), "n", "keep"), "copies").df
    limit = max(found.count() // HOT_SHARE, 1)
    hot, cool = F.broadcast(groups.where(F.col("n") > limit)), groups.where(F.col("n") <= limit)
    # rows of hot classes meet them where they lie; of those that are shuffled no class has more than the limit
    of_hot = rivals.join(hot, F.col("sha") == F.col("g"), "left")
    of_cool = of_hot.where("g IS NULL").drop("g", "n", "keep").join(cool, F.col("sha") == F.col("g"), "left")
    out = alone.withColumns({"n": F.lit(None).cast("long"), "keep": F.lit(None).cast(groups.schema["keep"].dataType)})
    for part in (of_hot.where("g IS NOT NULL"), of_cool):
        out = out.unionByName(part.drop("g"))
    return out.select(
        F.col("id").alias(id_col), F.when(F.col("n").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"), F.coalesce(F.col("keep.row") == F.col("row"), F.lit(True)).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", broadcast_classes: int = BROADCAST_PREFIXES) -> DataFrame:
    """The rows of docs, all columns, without those that a row of equal text and larger id makes needless.

    Of rows equal in text and id any one stays. Nulls as in classes(); columns may have any names. Texts meet the
    classes of two and more by digest: hot ones, and up to broadcast_classes of all, where they lie, else by a shuffle.
    """
    found = classes(docs, id_col, text_col).where("group_size > 1")
    # rows of the id that stays: more than one only where rows repeat
    same = found.where(F.col(id_col).eqNullSafe(F.col("keep_id"))).groupBy(F.col("text_sha256").alias("sha"), F.col("keep_id").alias("id"), F.col("group_size").alias("n"))
    listed = Staged(same.agg((F.count("*") > 1).alias("again")), "kept").df
    limit = max(docs.count() // HOT_SHARE, 1)
    digest = F.sha2(lowered(F.coalesce(F.col(text_col), F.lit(""))), 256)
    rows = docs.withColumn(_ROW, F.struct(digest.alias("sha"), F.col(id_col).alias("id")))
    hot, cool = F.broadcast(listed.where(F.col("n") > limit)), listed.where(F.col("n") <= limit)
    if cool.limit(broadcast_classes + 1).count() <= broadcast_classes:
        cool = F.broadcast(cool)
    for column, side in ((_HOT, hot), (_COOL, cool)):
        rows = rows.join(side.select(F.struct("sha", "id", "again").alias(column)), F.col(f"{_ROW}.sha") == F.col(f"{column}.sha"), "left")
        rows = rows.where(F.col(column).isNull() | F.col(f"{column}.id").eqNullSafe(F.col(f"{_ROW}.id")))
    if listed.where("again").isEmpty():
        return rows.select(*docs.columns)
    again = F.coalesce(f"{_HOT}.again", f"{_COOL}.again", F.lit(False))
    return rows.where(~again).unionByName(rows.where(again).dropDuplicates([_ROW])).select(*docs.columns)
