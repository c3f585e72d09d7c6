"""Hierarchical scores of mapped answers, best of N, run metrics and pass@k."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalgrove.functions import metrics as M
from evalgrove.functions import text as T


def scored(rows: DataFrame, predicted: str = "predicted_path", reference: str = "reference_path", node: str | None = "predicted_node", answer: str | None = "answer") -> DataFrame:
    """Adds mapped, hP, hR, hF and, with node and answer named, exact_match; 0 and false where unmapped."""
    mapped = F.col(predicted).isNotNull() & F.col(reference).isNotNull()
    rows = rows.withColumn("mapped", mapped).withColumn("_h", F.when(mapped, M.hierarchical(F.col(predicted), F.col(reference))))
    for name in ("hP", "hR", "hF"):
        rows = rows.withColumn(name, F.coalesce(F.col(f"_h.{name}"), F.lit(0.0)))
    if node and answer:
        same = T.normalize_match(F.coalesce(F.col(node), F.lit(""))) == T.normalize_match(F.col(answer))
        rows = rows.withColumn("exact_match", F.coalesce(mapped & same, F.lit(False)))
    return rows.drop("_h")


def best_of(rows: DataFrame, key: str = "example_id", score: str = "hF", order: str = "idx") -> DataFrame:
    """The row of best score of each example, the earliest of several."""
    best = Window.partitionBy(key).orderBy(F.col(score).desc(), F.col(order))
    return rows.withColumn("_n", F.row_number().over(best)).where("_n = 1").drop("_n")


def judged_candidates(rollouts: DataFrame, fallback: DataFrame, key: str = "example_id") -> DataFrame:
    """(key, idx, text): the distinct texts judged right, else the example's fallback text at idx 0."""
    right = rollouts.where("verdict").groupBy(key, "text").agg(F.min("idx").alias("idx"))
    rest = fallback.join(right.select(key).distinct(), key, "left_anti").select(key, "text", F.lit(0).alias("idx"))
    return right.unionByName(rest)


def run_metrics(rows: DataFrame, *by: str) -> DataFrame:
    """Means over mapped rows (0 without any), over all rows with _all, and counts."""
    over = lambda name: F.coalesce(F.avg(F.when(F.col("mapped"), F.col(name).cast("double"))), F.lit(0.0))
    every = lambda name: F.coalesce(F.avg(F.when(F.col("mapped"), F.col(name).cast("double")).otherwise(0.0)), F.lit(0.0))
    return rows.groupBy(*by).agg(
        *[over(n).alias(n) for n in ("hP", "hR", "hF")], over("exact_match").alias("exact"),
        *[every(n).alias(f"{n}_all") for n in ("hP", "hR", "hF")],
        F.count("*").alias("num_examples"), F.count_if("mapped").alias("num_mapped"),
    )


def method_counts(rows: DataFrame, method: str = "mapping_method") -> DataFrame:
    return rows.groupBy(method).agg(F.count("*").alias("examples"))


def long_metrics(summary: DataFrame, run: Column, measure: Column, names: list[str]) -> DataFrame:
    """(run, measure, metric, value) of a wide table of metrics."""
    pairs = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])
    return summary.select(run.alias("run"), measure.alias("measure"), F.explode(pairs).alias("m")).select("run", "measure", "m.metric", "m.value")


def variants(tables: dict[str, DataFrame], column: str = "variant") -> DataFrame:
    """Tables of the same columns below one another, each with its name."""
    out = None
    for name, table in tables.items():
        named = table.withColumn(column, F.lit(name))
        out = named if out is None else out.unionByName(named)
    return out


def reaggregate(rows: DataFrame, measure: str = "all") -> DataFrame:
    """Run metrics from a scored table's <measure>_* columns, one row a measure; 'all' takes every measure found."""
    found = [c[: -len("_hP")] for c in rows.columns if c.endswith("_hP")] if measure == "all" else [measure]
    out = None
    for m in sorted(found):
        missing = {f"{m}_{x}" for x in ("predicted_path", "hP", "hR", "hF", "exact_match")} | {"scored_reference_path"}
        if missing - set(rows.columns):
            raise ValueError(f"columns are missing: {sorted(missing - set(rows.columns))}")
        one = rows.select((F.col(f"{m}_predicted_path").isNotNull() & F.col("scored_reference_path").isNotNull()).alias("mapped"), *[F.col(f"{m}_{x}").alias(x) for x in ("hP", "hR", "hF", "exact_match")])
        one = run_metrics(one).withColumn("measure", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out


def verdict_counts(rollouts: DataFrame, key: str = "example_id", verdict: str = "verdict") -> DataFrame:
    """(key, n, c): answers and right answers of each example."""
    return rollouts.groupBy(key).agg(F.count("*").alias("n"), F.count_if(F.coalesce(F.col(verdict), F.lit(False))).alias("c"))


def pass_at_k(counts: DataFrame, strict: bool = False, powers: int = 12) -> DataFrame:
    """(k, value) for k = 1, 2, 4, .. up to the largest n, and the largest n itself.

    Examples are first counted by (n, c), so the cross with the ks is over few rows, and means weigh them.
    """
    shapes = counts.where(F.col("n") > 0).groupBy("n", "c").agg(F.count("*").alias("_w"))
    ks = counts.agg(F.max("n").alias("top")).select(F.explode(F.array_distinct(F.concat(F.filter(F.array(*[F.lit(2**i).cast("long") for i in range(powers)]), lambda k: k <= F.col("top")), F.array("top")))).alias("k"))
    value = M.pass_at_k(F.col("n").cast("int"), F.col("c").cast("int"), F.col("k").cast("int"), strict)
    valued = shapes.crossJoin(F.broadcast(ks)).withColumn("_v", value)
    return valued.groupBy("k").agg((F.sum(F.col("_v") * F.col("_w")) / F.sum(F.when(F.col("_v").isNotNull(), F.col("_w")))).alias("value"))


def parse_stats(rollouts: DataFrame) -> DataFrame:
    """Rollouts the judge saw and those whose reply could not be parsed."""
    seen = F.col("parse_ok").isNotNull()
    return rollouts.agg(F.count_if(seen).alias("num_judge_rollouts"), F.count_if(seen & ~F.col("parse_ok")).alias("num_judge_unparseable"))
