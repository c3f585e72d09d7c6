"""Tables of sampled answers: long and nested form, dedup, resume, shards, repair, splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns that judging and scoring add, dropped when samples are taken from a later stage.
LATER_PREFIXES = ("judge_", "exact_match_", "contained_", "cascade_", "sentence_bert_", "scored_")
LATER_COLUMNS = ("scored_reference_path", "hP", "hR", "hF", "exact_match", "mapping_method")
#: Columns that scoring without prefixes left in older files.
STALE_COLUMNS = ("scored_predicted_node", "scored_predicted_path", "hP", "hR", "hF", "exact_match", "mapping_method")
#: Hex digits of a hash by which keys are counted.
PREFIX = 4


def explode_rollouts(rows: DataFrame, key: str, texts: str = "all_texts", verdicts: str | None = None) -> DataFrame:
    """(key, idx, text[, verdict]); with verdicts the shorter of the two lists sets the length."""
    if verdicts is None:
        return rows.select(key, F.posexplode(texts).alias("idx", "text"))
    n = F.least(F.size(texts), F.size(verdicts))
    zipped = F.arrays_zip(F.slice(F.col(texts), F.lit(1), n).alias("text"), F.slice(F.col(verdicts), F.lit(1), n).alias("verdict"))
    return rows.where(n > 0).select(key, F.posexplode(zipped).alias("idx", "r")).select(key, "idx", "r.text", "r.verdict")


def nest_rollouts(rollouts: DataFrame, key: str = "example_id") -> DataFrame:
    """Back to one row an example with lists in order of idx."""
    return rollouts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("idx", "text", "verdict"))).alias("r")).select(
        key, F.transform("r", lambda x: x["text"]).alias("all_texts"), F.transform("r", lambda x: x["verdict"]).alias("judge_verdicts")
    )


def first_k(rollouts: DataFrame, k: int) -> DataFrame:
    return rollouts.where(F.col("idx") < k)


def limit_first(rows: DataFrame, n: int, order: str = "ord") -> DataFrame:
    return rows.orderBy(order).limit(n)


def distinct_candidates(rollouts: DataFrame, key: str = "example_id") -> DataFrame:
    """Each text of an example once, at its first place."""
    return rollouts.groupBy(key, "text").agg(F.min("idx").alias("idx"))


def strip_columns(rows: DataFrame, prefixes: Sequence[str] = LATER_PREFIXES, names: Sequence[str] = LATER_COLUMNS) -> DataFrame:
    return rows.drop(*[c for c in rows.columns if c in names or c.startswith(tuple(prefixes))])


def row_key(first: Column, second: Column) -> Column:
    """The id that rows go by: the first, or the second where that is missing or empty."""
    return F.coalesce(F.nullif(first, F.lit("")), F.nullif(second, F.lit("")))


def _keyless(rows: DataFrame, key: str) -> Column:
    return F.col(key).isNull() | (F.col(key).cast("string") == "")


def dedup_first(rows: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The first row of each key by order; rows without a key all stay."""
    first = Window.partitionBy(key).orderBy(order)
    keyed = rows.where(~_keyless(rows, key)).withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return keyed.unionByName(rows.where(_keyless(rows, key)))


def dedup_best(rows: DataFrame, key: str, worth: str, order: str = "ord") -> DataFrame:
    """The row of most worth of each key, the first of several."""
    best = Window.partitionBy(key).orderBy(F.col(worth).desc(), F.col(order))
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def remaining(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return rows.join(done.select(key), key, "left_anti")


def valid(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_semi")


def shard(rows: DataFrame, number: int, of: int, order: str = "ord") -> DataFrame:
    return rows.where(F.col(order) % of == number)


def shard_counts(rows: DataFrame, done: DataFrame, key: str, shards: int, order: str = "ord") -> DataFrame:
    """(shard, expected, completed, remaining) of each shard."""
    ready = done.select(F.col(key).alias("_done")).distinct()
    marked = rows.join(ready, F.col(key) == F.col("_done"), "left")
    counted = marked.groupBy((F.col(order) % shards).cast("int").alias("shard")).agg(F.count("*").alias("expected"), F.count("_done").alias("completed"))
    return counted.withColumn("remaining", F.col("expected") - F.col("completed"))


def is_complete(key: str, texts: str, expected: int) -> Column:
    """Has a key and at least the expected number of answers; 0 asks for none."""
    enough = F.lit(True) if expected <= 0 else F.coalesce(F.size(texts) >= expected, F.lit(False))
    return F.coalesce(F.col(key) != "", F.lit(False)) & enough


def repair_reasons(rows: DataFrame, known: DataFrame, key: str, n_texts: str, expected: int, bad: str = "bad") -> DataFrame:
    """Each row with its fate: malformed, no_id, incomplete, unknown_id, duplicate or kept (the best of its key)."""
    ids = known.select(F.col(key).alias("_known")).distinct()
    marked = rows.join(ids, F.col(key) == F.col("_known"), "left")
    reason = (
        F.when(F.col(bad), "malformed")
        .when(_keyless(rows, key), "no_id")
        .when(F.col(n_texts) < expected, "incomplete")
        .when(F.col("_known").isNull(), "unknown_id")
    )
    marked = marked.withColumn("reason", reason).drop("_known")
    best = Window.partitionBy(key, F.col("reason").isNull()).orderBy(F.col(n_texts).desc(), "ord")
    place = F.row_number().over(best)
    return marked.withColumn("reason", F.coalesce("reason", F.when(place == 1, "kept").otherwise("duplicate")))


def repair_stats(reasons: DataFrame) -> DataFrame:
    return reasons.groupBy("reason").agg(F.count("*").alias("rows"))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    """Keys that are missing or occur more than once, with their number."""
    return rows.groupBy(key).agg(F.count("*").alias("rows")).where((F.col("rows") > 1) | F.col(key).isNull())


def merge_gate(shards: Sequence[DataFrame], expected: DataFrame) -> DataFrame:
    """One row (merged, expected, complete): whether the shards' rows are as many as the input's."""
    merged = shards[0]
    for more in shards[1:]:
        merged = merged.unionByName(more)
    return merged.agg(F.count("*").alias("merged")).crossJoin(expected.agg(F.count("*").alias("expected"))).withColumn("complete", F.col("merged") == F.col("expected"))


def prepare(examples: DataFrame, paths: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """Examples with answer, dataset and path from a lookup; datasets named in exclude are left out."""
    looked = paths.select(F.col("image_id").alias("_image"), F.col("path").alias("image_path"), "dataset")
    out = examples.join(looked, F.col("image_id") == F.col("_image"), "left").drop("_image")
    out = out.withColumn("answer", F.col("entity_text")).withColumn("dataset", F.coalesce("dataset", F.lit("unknown")))
    return out.where(~F.col("dataset").isin(*exclude)) if exclude else out


def hash_split(keys: DataFrame, key: str, shares: dict[str, float], seed: str = "0") -> DataFrame:
    """Each key with a split: keys in order of md5(seed/key) are dealt out by shares of their number.

    Shares are cut by rank, so every run and every partitioning gives the same split.
    """
    hashed = keys.select(key).distinct().withColumn("_h", F.md5(F.concat(F.lit(seed + "/"), F.col(key).cast("string"))))
    hashed = hashed.withColumn("_p", F.substring("_h", 1, PREFIX))
    # at most 16 ** PREFIX counts are summed in one task; ranks are taken within the prefixes
    counts = hashed.groupBy(F.col("_p").alias("_q")).agg(F.count("*").alias("_c"))
    upto = Window.orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_q", F.coalesce(F.sum("_c").over(upto), F.lit(0)).alias("_before"), F.sum("_c").over(Window.partitionBy()).alias("_n"))
    ranked = hashed.join(F.broadcast(counts), F.col("_p") == F.col("_q"))
    ranked = ranked.withColumn("_r", F.col("_before") + F.row_number().over(Window.partitionBy("_p").orderBy("_h", key)))
    split, upto = None, 0.0
    for name, part in shares.items():
        upto += part
        hit = F.col("_r") <= F.floor(F.col("_n") * F.lit(upto) + F.lit(1e-9))
        split = F.when(hit, name) if split is None else split.when(hit, name)
    return ranked.select(key, split.otherwise(list(shares)[-1]).alias("split"))


def sample_chains(paths: DataFrame, key: str, path: str, n: int, min_depth: int, containing: str = "", seed: str = "42") -> DataFrame:
    """n paths of a least depth whose joined text has a substring, in order of md5(seed/key)."""
    text = F.lower(F.array_join(path, " "))
    picked = paths.where((F.size(path) >= min_depth) & F.contains(text, F.lit(containing.lower())))
    return picked.orderBy(F.md5(F.concat(F.lit(seed + "/"), F.col(key).cast("string"))), key).limit(n)
