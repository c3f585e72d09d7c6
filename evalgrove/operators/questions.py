"""Questions aligned with the taxonomy: node frequencies, the generic threshold, rewritten questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .taxonomy import document_frequency

#: Questions that name no category.
GENERIC = ("what is the main object?", "what is shown in the photo?", "what is the main content of this image?")


def generic_threshold(frequency: DataFrame) -> DataFrame:
    """One row (threshold): the lower side of the widest gap between neighbouring frequencies.

    Of equal gaps the one at the larger frequency counts. With a single frequency nothing is generic and the
    threshold is that frequency. The window is over distinct frequencies, which are few.
    """
    freqs = frequency.select("df").distinct()
    lower = F.lag("df").over(Window.orderBy("df"))
    gaps = freqs.withColumn("low", lower).where("low is not null").agg(F.max(F.struct((F.col("df") - F.col("low")).alias("gap"), "low")).alias("g"))
    return gaps.crossJoin(freqs.agg(F.max("df").alias("top"))).select(F.coalesce(F.col("g.low"), F.col("top")).alias("threshold"))


def specific_parents(chains: DataFrame, key: str = "entity_id", chain: str = "chain") -> DataFrame:
    """(key, parent): the node nearest to the leaf, the leaf aside, that isn't generic; null if all are."""
    frequency = document_frequency(chains, chain)
    threshold = generic_threshold(frequency)
    steps = chains.select(key, F.posexplode(chain).alias("pos", "node")).where("pos > 0")
    specific = frequency.crossJoin(F.broadcast(threshold)).where("df <= threshold").select(F.col("node").alias("_n"))
    found = steps.join(specific, F.col("node") == F.col("_n")).groupBy(key).agg(F.min_by("node", "pos").alias("parent"))
    return chains.select(key).distinct().join(found, key, "left")


def aligned(examples: DataFrame, chains: DataFrame, key: str = "entity_id") -> DataFrame:
    """examples with outcome, question and question_source; excluded rows keep their outcome for the counts."""
    parents = specific_parents(chains, key).select(F.col(key).alias("_k"), "parent")
    out = examples.join(parents, F.col(key) == F.col("_k"), "left")
    outcome = (
        F.when(F.col("_k").isNull(), "excluded_no_chain")
        .when(F.col("parent").isNotNull(), "generated_from_chain")
        .when(~F.coalesce(F.col("question"), F.lit("")).isin(*GENERIC), "kept_aligned")
        .otherwise("excluded_generic")
    )
    out = out.withColumn("outcome", outcome).withColumn("original_question", F.when(F.col("outcome") == "generated_from_chain", F.col("question")))
    out = out.withColumn("question", F.when(F.col("outcome") == "generated_from_chain", F.concat(F.lit("what is this "), "parent", F.lit("?"))).otherwise(F.col("question")))
    source = F.when(F.col("outcome") == "generated_from_chain", "chain_parent").when(F.col("outcome") == "kept_aligned", "original")
    return out.withColumn("question_source", source).drop("_k")


def outcome_stats(rows: DataFrame) -> DataFrame:
    counted = rows.groupBy("outcome").agg(F.count("*").alias("examples"))
    return counted.withColumn("percent", F.col("examples") * 100.0 / F.sum("examples").over(Window.partitionBy()))


def missing_descriptions(chains: DataFrame, descriptions: DataFrame) -> DataFrame:
    """One row (pairs, missing, ratio) over distinct (id, label). descriptions: (id, label, description)."""
    pairs = chains.select("id", F.explode("taxonomy").alias("label")).distinct()
    known = descriptions.where(F.trim("description") != "").select("id", "label").distinct().withColumn("_has", F.lit(1))
    out = pairs.join(known, ["id", "label"], "left").agg(F.count("*").alias("pairs"), F.count_if(F.col("_has").isNull()).alias("missing"))
    return out.withColumn("ratio", F.coalesce(F.try_divide(F.col("missing"), F.col("pairs")), F.lit(0.0)))


def description_chains(chains: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(id, descriptions): a chain's descriptions in place, '' where one is missing; the least of several."""
    one = descriptions.groupBy(F.col("id").alias("_i"), F.col("label").alias("_l")).agg(F.min("description").alias("d"))
    steps = chains.select("id", F.posexplode("taxonomy").alias("pos", "label"))
    joined = steps.join(one, (F.col("id") == F.col("_i")) & (F.col("label") == F.col("_l")), "left")
    packed = joined.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("d", F.lit("")).alias("d")))).alias("x"))
    return packed.select("id", F.transform("x", lambda s: s["d"]).alias("descriptions"))
