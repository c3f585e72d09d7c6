"""Whole tables through several operators: scoring, judging, repairing and preparing runs.

Rows are the nested stage tables of sources.schemas; inside, answers are long tables by example and place.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrove.functions import prompts as P
from evalgrove.functions import text as T
from evalgrove.functions.metrics import ROOT
from evalgrove.operators import judge as J
from evalgrove.operators import match as M
from evalgrove.operators import rollouts as R
from evalgrove.operators import score as S
from evalgrove.operators import taxonomy as X
from evalgrove.sources import caches, discovery, files, schemas
from evalgrove.sources.staging import staged

KEY = "row_id"
#: Functions of (texts, nodes, k) that return (text, rank, label, path, ord, score).
Candidates = Callable[[DataFrame, DataFrame, int], DataFrame]


def taxonomy_index(
    chains: DataFrame, aliases: DataFrame | None = None, drop_through: Sequence[str] = (), keep_from: Sequence[str] = (),
    names: DataFrame | None = None, akas: DataFrame | None = None, rename_entities: bool = False,
) -> dict[str, DataFrame]:
    """nodes, entities, labels and aliases of leaf-first chains (id, taxonomy).

    aliases: (label, alias), or akas: (id, alias) of the leaves. names: (id, name), the names that samples give to
    leaves; nodes and aliases take them, paths of entities only with rename_entities.
    """
    from evalgrove.functions.metrics import prune_chain

    prune = lambda table: table.withColumn("pruned", prune_chain(F.col("taxonomy"), drop_through, keep_from))
    named = prune(chains if names is None else X.override_leaves(chains, names))
    entities = X.entity_paths(named if rename_entities else prune(chains))
    nodes = X.with_ordinals(X.node_paths(X.edges(X.entity_paths(named))))
    index = {"nodes": nodes, "entities": entities, "labels": X.label_paths(nodes)}
    if aliases is None and akas is not None:
        aliases = X.leaf_aliases(named, akas)
    if aliases is not None:
        index["aliases"] = X.alias_table(aliases)
    return index


def save_index(index: dict[str, DataFrame], folder: str) -> None:
    """Writes each table of an index to the folder, so that later runs load it and walk no taxonomy."""
    for name, table in index.items():
        table.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_index(spark: SparkSession, folder: str, names: Sequence[str] = ("nodes", "entities", "labels")) -> dict[str, DataFrame]:
    return {name: spark.read.parquet(f"{folder}/{name}") for name in names}


def _keyed(rows: DataFrame) -> DataFrame:
    """rows with their id, or a number for those without one; written, so that numbers hold and plans stay short."""
    columns = [c for c in ("data_id", "image_id") if c in rows.columns]
    first, second = (F.col(columns[0]), F.col(columns[-1])) if columns else (F.lit(None), F.lit(None))
    number = F.concat(F.lit("#"), F.monotonically_increasing_id().cast("string"))
    return staged(rows.withColumn(KEY, F.coalesce(R.row_key(first.cast("string"), second.cast("string")), number)), "keyed")


def _optional(rows: DataFrame, name: str, kind: str):
    return F.col(name) if name in rows.columns else F.lit(None).cast(kind)


def embedded(client: Callable[[list[str]], Sequence[Sequence[float]]], folder: str, model: str) -> Candidates:
    """Candidates of largest cosine, by a client that gives texts their vectors; those of the nodes are kept in folder."""

    def candidates(texts: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
        vectors = caches.node_vectors(nodes.select("label", "ord"), M.encode_with(client, "label"), folder, model)
        return M.cosine_candidates(texts, nodes, vectors, M.encode_with(client, "text"), k)

    return candidates


def score_rows(rows: DataFrame, index: dict[str, DataFrame], measures: Sequence[str] = ("exact_match",), k: int = 3, min_score: float | None = 0.35, similarity: str = "bigrams", candidates_of: Candidates | None = None, stem: bool = False) -> DataFrame:
    """rows with <measure>_{predicted_node, predicted_path, hP, hR, hF, exact_match, mapping_method} and scored_reference_path.

    Direct measures take the best of the distinct answers that were judged right, else the selected text,
    else the prediction. 'cascade' takes the best of all answers, with candidates by one of match.SIMILARITIES
    or by candidates_of(texts, nodes, k), such as embedded(). With stem, direct measures compare stems of words. Row
    ids must be unique.
    """
    rows = _keyed(R.strip_columns(rows, prefixes=tuple(f"{m}_" for m in measures), names=("scored_reference_path", *R.STALE_COLUMNS)))
    base = rows.select(KEY, T.clean_light(F.coalesce("answer", F.lit(""))).alias("answer"), _optional(rows, "entity_id", "string").alias("entity_id"))
    refs = X.reference_paths(base, index["nodes"], index["entities"], index["labels"])
    texts = R.explode_rollouts(rows.where(F.size(_optional(rows, "all_texts", "array<string>")) > 0), KEY) if "all_texts" in rows.columns else None
    out = rows
    for measure in measures:
        if measure == "cascade":
            candidates = R.distinct_candidates(texts, KEY)
        else:
            chosen = T.first_full(_optional(rows, "judge_selected_text", "string"), _optional(rows, "prediction", "string"))
            fallback = rows.select(KEY, chosen.alias("text"))
            if {"all_texts", "judge_verdicts"} <= set(rows.columns):
                candidates = S.judged_candidates(R.explode_rollouts(rows, KEY, verdicts="judge_verdicts"), fallback, KEY)
            else:
                candidates = fallback.withColumn("idx", F.lit(0))
        unique = candidates.select("text").distinct()
        if measure == "cascade":
            full = unique.where(F.col("text") != "")
            if candidates_of:
                top = candidates_of(full, index["nodes"], k)
            else:
                top = M.top_k(full, index["nodes"], M.SIMILARITIES[similarity](full, index["nodes"], k), k, last_wins=False)
            found = M.cascade(full, index["nodes"], top, min_score)
        else:
            found = M.direct(unique, index["nodes"], measure, stem)
        joined = candidates.join(found.withColumnRenamed("text", "_t"), F.col("text") == F.col("_t"), "left").drop("_t").join(refs, KEY)
        best = S.best_of(S.scored(joined), KEY)
        kept = ("predicted_node", "predicted_path", "hP", "hR", "hF", "exact_match", "mapping_method")
        best = best.select(F.col(KEY).alias("_k"), *[F.col(c).alias(f"{measure}_{c}") for c in kept])
        out = out.join(best, F.col(KEY) == F.col("_k"), "left").drop("_k")
        for c in ("hP", "hR", "hF"):
            out = out.withColumn(f"{measure}_{c}", F.coalesce(f"{measure}_{c}", F.lit(0.0)))
    path = refs.select(F.col(KEY).alias("_k"), F.col("reference_path").alias("scored_reference_path"))
    return out.join(path, F.col(KEY) == F.col("_k"), "left").drop("_k", KEY)


def run_results(scored: DataFrame, run: str, strict: bool = False) -> DataFrame:
    """(run, measure, metric, value): means, counts, pass@k and parse statistics of a scored table."""
    names = ["hP", "hR", "hF", "exact", "hP_all", "hR_all", "hF_all", "num_examples", "num_mapped"]
    summary = S.reaggregate(scored)
    out = S.long_metrics(summary, F.lit(run), F.col("measure"), names)
    for column, suffix in (("judge_verdicts", ""), ("judge_verdicts_majority", "_majority")):
        if column in scored.columns:
            counts = scored.where(F.size(column) > 0).select(F.size(column).cast("long").alias("n"), F.size(F.filter(column, lambda v: v)).cast("long").alias("c"))
            values = S.pass_at_k(counts, strict)
            out = out.unionByName(values.select(F.lit(run).alias("run"), F.lit("judge").alias("measure"), F.concat(F.lit("pass@"), F.col("k").cast("string"), F.lit(suffix)).alias("metric"), "value"))
    if "judge_parse_ok" in scored.columns:
        stats = scored.agg(F.sum(F.size("judge_parse_ok")).alias("num_judge_rollouts"), F.sum(F.size(F.filter("judge_parse_ok", lambda v: ~v))).alias("num_judge_unparseable"))
        out = out.unionByName(S.long_metrics(stats, F.lit(run), F.lit("judge"), ["num_judge_rollouts", "num_judge_unparseable"]).where("value is not null"))
    return out


def infer(
    examples: DataFrame, source: J.Source, rounds: int = 1, feedback: bool = False, variant: str = "barebones", max_feedback_chars: int = 2000, method: str | None = None, sampling: str = "",
) -> DataFrame:
    """examples with prediction, method, prompt_variant, sampling, n_samples and all_texts: all attempts of all rounds in order.

    Several rounds make the method 'iterative', with attempts (round, attempt, text, matched), total_attempts,
    success and success_round, which stay null and 0: the judge decides. Else it is 'naive-sampling' or, for one answer, 'naive'.
    """
    fresh = ("prediction", "method", "prompt_variant", "sampling", "n_samples", "all_texts", "success", "success_round", "attempts", "total_attempts", "attempts_per_round", "max_rounds", "enable_feedback")
    keyed = _keyed(R.strip_columns(examples, names=fresh))
    tried = J.iterate(keyed.select(F.col(KEY).alias("example_id"), "question"), source, rounds, feedback, max_feedback_chars, variant)
    entry = F.struct("round", (F.col("attempt") + 1).alias("attempt"), "text", F.lit(None).cast("boolean").alias("matched"))
    lists = tried.groupBy("example_id").agg(F.array_sort(F.collect_list(entry)).alias("attempts"))
    out = keyed.join(lists, F.col(KEY) == F.col("example_id")).drop("example_id", KEY).withColumn("all_texts", F.transform("attempts", lambda x: x["text"]))
    several = F.when(F.size("all_texts") > 1, "naive-sampling").otherwise("naive")
    told = {
        "prediction": F.get("all_texts", F.lit(0)), "method": F.lit(method or "iterative") if method or rounds > 1 else several, "prompt_variant": F.lit(variant), "sampling": F.lit(sampling), "n_samples": F.size("all_texts"),
    }
    if rounds > 1:
        per_round = F.size(F.filter("attempts", lambda x: x["round"] == 1))
        told |= {"attempts_per_round": per_round, "max_rounds": F.lit(rounds), "enable_feedback": F.lit(feedback), "success": F.lit(None).cast("boolean"), "success_round": F.lit(0), "total_attempts": F.size("attempts")}
        return out.withColumns(told)
    return out.drop("attempts").withColumns(told)


def self_aggregate(samples: DataFrame, source: J.Source, population: int = 16, k: int = 4, steps: int = 2, selection: str = "first", seed: str = "1234", variant: str = "barebones") -> DataFrame:
    """samples whose all_texts are the last round's population; what judging and scoring added to the old ones goes."""
    keyed = _keyed(R.strip_columns(samples))
    rollouts = R.explode_rollouts(keyed, KEY).withColumnRenamed(KEY, "example_id")
    questions = keyed.select(F.col(KEY).alias("example_id"), "question")
    members = J.aggregate_rounds(rollouts, questions, source, population, k, steps, selection, seed, variant)
    lists = members.groupBy("example_id").agg(F.array_sort(F.collect_list(F.struct("slot", "text"))).alias("r"))
    lists = lists.select("example_id", F.transform("r", lambda x: x["text"]).alias("_texts"))
    out = keyed.join(lists, F.col(KEY) == F.col("example_id")).drop("example_id", KEY, "all_texts").withColumnRenamed("_texts", "all_texts")
    return out.withColumns({"prediction": F.get("all_texts", F.lit(0)), "n_samples": F.size("all_texts")})


def run_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Files and metadata of the runs under a folder, as the catalog of runs reads them; run_dir is relative to the folder's parent.

    A run's metadata is the first of its *_metadata.json files with model, prompt_variant and data; the judge's
    model comes from those that name one.
    """
    plain = lambda path: F.regexp_replace(path, "^file:/+", "/")
    parent = re.escape(re.sub("^file:/+", "/", folder).rstrip("/").rsplit("/", 1)[0] + "/")
    at = lambda path: F.regexp_extract(plain(path), f"{parent}(.*)/[^/]+$", 1)
    name = lambda path: F.substring_index(path, "/", -1)
    listed = discovery.listing(spark, folder).select("path")
    # only samples are read, by path
    samples = [r["path"] for r in discovery.matching(listed.withColumn("name", name(F.col("path"))), discovery.SAMPLES).select("path").collect()]
    found = listed.select(at(F.col("path")).alias("run_dir"), name(F.col("path")).alias("name"), plain(F.col("path")).alias("_path"))
    if samples:
        counted = files.rows_by_file(spark, samples, "*.json*", whole=True).select(plain(F.col("file")).alias("_file"), "rows")
        found = found.join(counted, F.col("_path") == F.col("_file"), "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    else:
        found = found.withColumn("rows", F.lit(0).cast("long"))
    found = found.select("run_dir", "name", "rows")
    told = spark.read.schema(schemas.METADATA).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*_metadata.json").json(folder)
    path = F.col("_metadata.file_path")
    told = told.select(at(path).alias("run_dir"), name(path).alias("name"), "*")
    run = F.col("model").isNotNull() & F.col("prompt_variant").isNotNull() & F.col("data").isNotNull() & F.col("judge_model").isNull()
    first = told.groupBy("run_dir").agg(F.min_by(F.when(run, F.struct("model", "prompt_variant", "data", "sharding")), F.when(run, F.col("name"))).alias("m"), F.min_by("judge_model", F.when(F.nullif("judge_model", F.lit("")).isNotNull(), F.col("name"))).alias("judge_model"))
    meta = first.where("m is not null").select(
        "run_dir", "m.model", F.coalesce("m.data.input", F.lit("")).alias("dataset_path"), F.col("m.prompt_variant").alias("prompt"), F.coalesce("m.data.no_image", F.lit(False)).alias("no_image"),
        F.coalesce("m.sharding.num_shards", F.lit(1)).alias("num_shards"), F.coalesce("m.data.num_examples", F.lit(0)).alias("shard_examples"), "judge_model",
    )
    return found, meta


def judge_rows(rows: DataFrame, source: J.Source, structured: bool = False, evidence: DataFrame | None = None) -> DataFrame:
    """rows with the judge's columns. evidence: (entity_id, labels, descriptions), for free-form prompts only."""
    keyed = _keyed(rows)
    asked = R.explode_rollouts(keyed, KEY).withColumnRenamed(KEY, "_k")
    facts = keyed.select(KEY, "question", "answer", _optional(rows, "entity_id", "string").alias("entity_id"))
    if evidence is not None and not structured:
        block = P.evidence_block(F.col("labels"), F.col("descriptions"))
        facts = facts.join(evidence.select(F.col("entity_id").alias("_e"), block.alias("block")), F.col("entity_id") == F.col("_e"), "left").withColumn("block", F.coalesce("block", F.lit("")))
    asked = asked.join(facts, F.col("_k") == F.col(KEY)).drop("_k")
    if structured:
        prompt = P.judge_prompt(F.col("question"), F.col("answer"), F.col("text"))
    else:
        prompt = P.free_form_prompt(F.col("question"), F.col("answer"), F.col("text"), F.col("block") if evidence is not None else None)
    replies = J.fan_out(asked.select(KEY, "idx", "text", prompt.alias("prompt")), source)
    voted = J.votes(replies, KEY, "idx", "text", structured=structured)
    raw = replies.where("completion = 0").select(F.col(KEY).alias("_k"), F.col("idx").alias("_i"), "reply")
    voted = voted.join(raw, (F.col(KEY) == F.col("_k")) & (F.col("idx") == F.col("_i"))).drop("_k", "_i")
    said = P.parse_structured(F.col("reply"))["reason"] if structured else F.col("reply")
    entry = F.struct("idx", "verdict", "parse_ok", said.alias("said"), "verdict_majority", F.struct(F.col("votes_yes").cast("int").alias("votes_yes"), F.col("votes_no").cast("int").alias("votes_no")).alias("votes"))
    lists = voted.groupBy(F.col(KEY).alias("_k")).agg(F.array_sort(F.collect_list(entry)).alias("r"))
    pick = lambda name: F.transform("r", lambda x: x[name])
    lists = lists.select("_k", pick("verdict").alias("judge_verdicts"), pick("parse_ok").alias("judge_parse_ok"), pick("said").alias("judge_reasons" if structured else "judge_raw"), pick("verdict_majority").alias("judge_verdicts_majority"), pick("votes").alias("judge_votes"))
    out = keyed.join(lists, F.col(KEY) == F.col("_k"), "left").drop("_k")
    for verdict, suffix in (("verdict", ""), ("verdict_majority", "_majority")):
        hits = J.hits(voted, KEY, verdict)
        out = out.join(hits.select(F.col(KEY).alias("_k"), *[F.col(c).alias(c + suffix) for c in ("judge_hit", "judge_hit_count", "judge_selected", "judge_selected_text")]), F.col(KEY) == F.col("_k"), "left").drop("_k")
    # rows without answers are written through with empty verdicts
    none = {"judge_verdicts": F.array().cast("array<boolean>"), "judge_parse_ok": F.array().cast("array<boolean>"), "judge_reasons" if structured else "judge_raw": F.array().cast("array<string>")}
    for suffix in ("", "_majority"):
        none |= {f"judge_hit{suffix}": F.lit(False), f"judge_hit_count{suffix}": F.lit(0).cast("long"), f"judge_selected{suffix}": F.lit(-1), f"judge_selected_text{suffix}": F.lit("")}
    none |= {"judge_verdicts_majority": F.array().cast("array<boolean>"), "judge_votes": F.array().cast(schemas.VOTES)}
    return out.withColumns({c: F.coalesce(c, empty) for c, empty in none.items()}).drop(KEY)


def evidence(labels: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(entity_id, labels, descriptions) for judge_rows() of leaf-first chains (id, taxonomy) of labels and of descriptions."""
    told = descriptions.select(F.col("id").alias("entity_id"), F.col("taxonomy").alias("descriptions"))
    return told.join(labels.select(F.col("id").alias("_l"), F.col("taxonomy").alias("labels")), F.col("entity_id") == F.col("_l"), "left").select("entity_id", "labels", "descriptions")


def label_chains(entities: DataFrame) -> DataFrame:
    """(id, taxonomy) of an index's entities: their paths without the root."""
    bare = F.when(F.element_at("path", -1) == ROOT, F.slice("path", F.lit(1), F.size("path") - 1)).otherwise(F.col("path"))
    return entities.select("id", bare.alias("taxonomy"))


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """A scored file with all columns of its measures, null where JSON left them out; measures are told by its first row."""
    lines = spark.read.text(path).where(F.trim("value") != "").head(1)
    keys = json.loads(lines[0]["value"]) if lines else {}
    measures = sorted(k[: -len("_hP")] for k in keys if k.endswith("_hP"))
    if not measures:
        raise ValueError(f"{path} has no scores")
    return files.read_jsonl(spark, path, ", ".join([schemas.JUDGED, "scored_reference_path array<string>", *(schemas.MEASURED.format(m=m) for m in measures)]))


def repair(samples: DataFrame, inputs: DataFrame, expected: int, shards: int, bad: str = "_corrupt_record") -> dict[str, DataFrame]:
    """kept rows, stats by fate, and shard counts of a run that broke off.

    samples: tolerant JSON lines with an ordinal, ord, and data_id, all_texts; inputs: (data_id, ord).
    """
    marked = samples.withColumn("bad", F.col(bad).isNotNull()).withColumn("n_texts", F.coalesce(F.when(F.col("all_texts").isNotNull(), F.size("all_texts")), F.lit(0)))
    fates = R.repair_reasons(marked, inputs, "data_id", "n_texts", expected)
    kept = fates.where("reason = 'kept'").drop("bad", "n_texts", "reason", bad)
    return {"kept": kept, "stats": R.repair_stats(fates), "shards": R.shard_counts(inputs, kept, "data_id", shards)}


def manifest(run: str, repaired: dict[str, DataFrame], expected: int, shards: int, backup: str | None = None) -> DataFrame:
    """One JSON text on a repair: run, expected answers, number of shards, where the old shards went, stats and shard counts."""
    stats = repaired["stats"].agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "rows")))).alias("stats"))
    counts = repaired["shards"].agg(F.array_sort(F.collect_list(F.struct("shard", "expected", "completed", "remaining"))).alias("shards"))
    whole = F.struct(F.lit(run).alias("run_id"), F.lit(shards).alias("dp"), F.lit(expected).alias("expected_rollouts"), F.lit(backup).alias("backup_dir"), "stats", "shards")
    return stats.crossJoin(counts).select(F.to_json(whole).alias("value"))
