"""Auditing judge verdicts against answers and aliases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrove.functions import metrics as M
from evalgrove.functions import text as T


#: Columns of an audit that a short table goes without.
DETAILS = (*T.SUPPORTED, "answer_contains_prediction", "mean_judge_pos", "median_judge_pos", "mean_supported_pos", "median_supported_pos", "judge_hit_examples", "supported_hit_examples")


def classify(rows: DataFrame, aliases: DataFrame | None, prediction: str = "text", answer: str = "answer") -> DataFrame:
    """rows with category: exact, alias, contains_answer, contains_alias, answer_contains_prediction or null.

    aliases: (canonical, alias), both normalised. They are collected per answer, a handful of names each, so
    rows are not multiplied.
    """
    out = rows.withColumn("_p", T.normalize_audit(F.col(prediction))).withColumn("_a", T.normalize_audit(F.col(answer)))
    if aliases is None:
        out = out.withColumn("_names", F.array().cast("array<string>"))
    else:
        names = aliases.groupBy(F.col("canonical").alias("_c")).agg(F.collect_set("alias").alias("_names"))
        out = out.join(names, F.col("_a") == F.col("_c"), "left").drop("_c").withColumn("_names", F.coalesce("_names", F.array().cast("array<string>")))
    p, a = F.col("_p"), F.col("_a")
    category = (
        F.when(p == a, "exact")
        .when(F.array_contains("_names", p), "alias")
        .when(T.phrase_in(a, p), "contains_answer")
        .when(F.exists("_names", lambda n: T.is_alias_seed(n) & T.phrase_in(n, p)), "contains_alias")
        .when(T.phrase_in(p, a), "answer_contains_prediction")
    )
    return out.withColumn("category", category).drop("_p", "_a", "_names")


def audit(classified: DataFrame, run: str = "run", key: str = "example_id") -> DataFrame:
    """One row a run: hits, pass@1 and pass@n by judge and by support, positives, categories, medians.

    classified: (run, example_id, verdict, category), one row an answer; an unjudged answer has verdict null.
    """
    yes = F.coalesce(F.col("verdict"), F.lit(False))
    held = yes & T.is_supported(F.col("category"))
    kinds = (*T.SUPPORTED, "answer_contains_prediction")
    per = classified.groupBy(run, key).agg(
        F.count("verdict").alias("n"), F.count_if(yes).alias("c"), F.count_if(held).alias("s"),
        *[F.count_if(yes & (F.col("category") == k)).alias(k) for k in kinds],
    )
    ask = lambda c, k: M.pass_at_k(F.col("n").cast("int"), F.col(c).cast("int"), k)
    some = F.col("n") > 0
    mean = lambda x: F.coalesce(F.avg(x), F.lit(0.0))
    hit = lambda c: F.when(F.col(c) > 0, F.col(c).cast("double"))
    share = lambda x, of: F.coalesce(F.try_divide(100.0 * x, of), F.lit(0.0))
    out = per.groupBy(run).agg(
        F.count("*").alias("rows"), F.count_if(F.col("c") > 0).alias("judge_hit_examples"), F.count_if(F.col("s") > 0).alias("supported_hit_examples"),
        mean(F.when(some, ask("c", F.lit(1)))).alias("judge_pass_1"), mean(F.when(some, ask("s", F.lit(1)))).alias("supported_pass_1"),
        mean(F.when(some, ask("c", F.col("n").cast("int")))).alias("judge_pass_n"), mean(F.when(some, ask("s", F.col("n").cast("int")))).alias("supported_pass_n"),
        F.sum("c").alias("judge_positive"), F.sum("s").alias("supported_positive"),
        mean(hit("c")).alias("mean_judge_pos"), F.coalesce(F.median(hit("c")), F.lit(0.0)).alias("median_judge_pos"),
        mean(hit("s")).alias("mean_supported_pos"), F.coalesce(F.median(hit("s")), F.lit(0.0)).alias("median_supported_pos"),
        *[F.sum(k).alias(k) for k in kinds], rollout_size_label(F.when(some, F.col("n"))).alias("k"),
    )
    return out.withColumn("supported_percent", share(F.col("supported_positive"), F.col("judge_positive"))).withColumn("under_specific_percent", share(F.col("answer_contains_prediction"), F.col("judge_positive")))


def rollout_size_label(n):
    """Aggregate: '0', the one size, or 'var:min-max'."""
    low, high = F.min(n).cast("string"), F.max(n).cast("string")
    return F.when(F.max(n).isNull(), "0").when(F.min(n) == F.max(n), high).otherwise(F.concat(F.lit("var:"), low, F.lit("-"), high))
