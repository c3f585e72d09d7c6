"""Comparing runs and describing answers: hit counts, histograms, modes, refusals, accuracy by place."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrove.functions import text as T

#: Lower edges of the bins of hit counts, the last open above.
HIT_BINS = (1, 2, 3, 5, 9, 17, 33, 65, 129, 257)
KS = tuple(2**i for i in range(9))


def hit_counts(rollouts: DataFrame, key: str = "example_id", support: Column | None = None) -> DataFrame:
    """(key, n, c[, s]): answers, those judged right, and those of them that support holds for."""
    yes = F.coalesce(F.col("verdict"), F.lit(False))
    more = [] if support is None else [F.count_if(yes & support).alias("s")]
    return rollouts.groupBy(key).agg(F.count("*").alias("n"), F.count_if(yes).alias("c"), *more)


def histogram(counts: DataFrame, value: str = "c", edges: Sequence[int] = HIT_BINS) -> DataFrame:
    """(bin, examples, percent) of the solved examples, bin being its lower edge; values beyond the last edge are in none."""
    at = None
    for low, high in zip(edges, edges[1:]):
        hit = (F.col(value) >= low) & (F.col(value) < high)
        at = F.when(hit, low) if at is None else at.when(hit, low)
    solved = counts.where(F.col(value) > 0).withColumn("bin", at)
    binned = solved.groupBy("bin").agg(F.count("*").alias("examples"))
    total = Window.partitionBy()
    return binned.withColumn("percent", F.col("examples") * 100.0 / F.sum("examples").over(total)).where("bin is not null")


def cdf(counts: DataFrame, value: str = "c") -> DataFrame:
    """(value, share): the share of solved examples with at most that many hits, at each number that occurs."""
    per = counts.where(F.col(value) > 0).groupBy(value).agg(F.count("*").alias("_n"))
    upto = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    return per.select(F.col(value).alias("value"), (F.sum("_n").over(upto) / F.sum("_n").over(Window.partitionBy())).alias("share"))


def differential(a: DataFrame, b: DataFrame, key: str = "example_id") -> DataFrame:
    """One row on the examples that run a solves and run b doesn't: number, mean hits, shares of 1, <= 2, <= 4."""
    left = a.select(key, F.col("c").alias("ca")).join(b.select(key, F.col("c").alias("cb")), key).where("ca > 0 and cb = 0")
    share = lambda cond: F.coalesce(F.avg(cond.cast("double")), F.lit(0.0))
    return left.agg(F.count("*").alias("examples"), F.coalesce(F.avg("ca"), F.lit(0.0)).alias("mean_hits"), share(F.col("ca") == 1).alias("one"), share(F.col("ca") <= 2).alias("upto2"), share(F.col("ca") <= 4).alias("upto4"))


def modal_counts(rollouts: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, modal): how often the commonest text of each example occurs."""
    return rollouts.groupBy(key, "text").agg(F.count("*").alias("_n")).groupBy(key).agg(F.max("_n").alias("modal"))


def modal_gap(rollouts: DataFrame, a: DataFrame, b: DataFrame, key: str = "example_id") -> DataFrame:
    """Modal counts of the examples that a solves and b doesn't."""
    gap = a.where("c > 0").select(key).join(b.where("c = 0").select(key), key)
    return modal_counts(rollouts.join(gap, key, "left_semi"), key)


def common_ids(runs: Sequence[DataFrame], key: str = "example_id") -> DataFrame:
    out = runs[0].select(key)
    for more in runs[1:]:
        out = out.intersect(more.select(key))
    return out


def refusal_rates(rollouts: DataFrame, *by: str) -> DataFrame:
    low = F.col("text")
    return rollouts.groupBy(*by).agg(F.count("*").alias("rollouts"), (F.avg(T.is_refusal(low).cast("double")) * 100).alias("exact_percent"), (F.avg(T.is_refusal_fuzzy(low).cast("double")) * 100).alias("fuzzy_percent"))


def refusal_by_k(rollouts: DataFrame, key: str = "example_id", ks: Sequence[int] = KS) -> DataFrame:
    """(k, percent): mean over examples of the share of refusals among the first k answers, all of them if fewer.

    One grouping counts the refusals before each k for every example, so answers aren't multiplied by ks.
    """
    no = T.is_refusal(F.col("text"))
    per = rollouts.groupBy(key).agg(F.count("*").alias("n"), *[F.count_if(no & (F.col("idx") < k)).alias(f"r{k}") for k in ks])
    means = per.agg(*[(F.avg(F.col(f"r{k}") / F.least(F.col("n"), F.lit(k))) * 100).alias(f"m{k}") for k in ks])
    return means.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.col(f"m{k}").alias("percent")) for k in ks])).alias("x")).select("x.k", "x.percent")


def accuracy_at(rollouts: DataFrame, places: Sequence[int]) -> DataFrame:
    """(k, examples, accuracy): accuracy of the k-th answer over the examples that have one."""
    picked = rollouts.where(F.col("idx").isin(*[k - 1 for k in places]))
    return picked.groupBy((F.col("idx") + 1).alias("k")).agg(F.count("*").alias("examples"), F.avg(F.coalesce(F.col("verdict"), F.lit(False)).cast("double")).alias("accuracy"))


def answer_distribution(rollouts: DataFrame, top: int = 12, key: str = "example_id") -> DataFrame:
    """(key, text, n, verdict, place): each example's commonest texts, first seen first, with the first verdict."""
    per = rollouts.groupBy(key, "text").agg(F.count("*").alias("n"), F.min("idx").alias("first"), F.min_by("verdict", "idx").alias("verdict"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.col("n").desc(), "first"))
    return per.withColumn("place", place).where(F.col("place") <= top)


def diversity(rollouts: DataFrame, key: str = "example_id") -> DataFrame:
    return rollouts.groupBy(key).agg(F.count_distinct("text").alias("distinct_answers"))


def headline(rollouts: DataFrame, supported: Column, key: str = "example_id") -> DataFrame:
    """Hit rate, mean hits, and examples whose hits are supported, unsupported or none."""
    per = hit_counts(rollouts, key, supported)
    return per.agg(
        F.count("*").alias("examples"), F.avg((F.col("c") > 0).cast("double")).alias("hit_rate"), F.avg("c").alias("mean_hits"),
        F.count_if(F.col("s") > 0).alias("supported"), F.count_if((F.col("c") > 0) & (F.col("s") == 0)).alias("unsupported"), F.count_if(F.col("c") == 0).alias("missed"),
    )


def matching(examples: DataFrame, hit: bool | None = None, support: str | None = None, search: str = "") -> DataFrame:
    """Examples (answer, all_texts, c, s) by hit, support class and a substring of the answer or any text."""
    out = examples
    if hit is not None:
        out = out.where((F.col("c") > 0) == hit)
    if support is not None:
        out = out.where({"supported": F.col("s") > 0, "unsupported": (F.col("c") > 0) & (F.col("s") == 0), "missed": F.col("c") == 0}[support])
    if search:
        low = F.lit(search.lower())
        out = out.where(F.contains(F.lower("answer"), low) | F.exists("all_texts", lambda t: F.contains(F.lower(t), low)))
    return out
