"""Command line over JSON-line files: score, aggregate, judge, infer, rsa, audit, dedup, repair, prepare, questions, layout, images, describe, index, catalog, latest.

    python -m evalgrove.cli score samples.jsonl --chains chains.jsonl --measure all --out scored --results results

Models are clients, functions of (prompts, n) or (prompts, n, settings) that return n replies a prompt, named by --client
module:function and called on the executors; --replies replays a JSON-line file of (prompt, completion, reply) instead.
Replies are committed by --chunk prompts to a log beside the output until the output is written: a run that broke off and is
started again with --resume asks for the rest only.

EVALGROVE_DATA is a folder for relative paths of what is read, EVALGROVE_VECTORS the default of --vectors, EVALGROVE_SCORED of
what audit reads.
"""

from __future__ import annotations

import argparse
import importlib
import inspect
import json
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgrove.functions import text as T
from evalgrove.operators import audit as A
from evalgrove.operators import images as IM
from evalgrove.operators import judge as J
from evalgrove.operators import match as M
from evalgrove.operators import questions as Q
from evalgrove.operators import rollouts as R
from evalgrove.operators import runs as N
from evalgrove.operators import taxonomy as X
from evalgrove.operators.layout import chain_layout
from evalgrove.operators.ordinals import numbered
from evalgrove.plans import pipelines
from evalgrove.sources import descriptions, discovery, files, publish, replies, schemas
from evalgrove.sources.staging import staged


def _ordered(df: DataFrame) -> DataFrame:
    return df.withColumn("ord", F.monotonically_increasing_id())


def _index(spark: SparkSession, path: str | None, saved: str | None = None) -> dict[str, DataFrame]:
    if saved:
        return pipelines.load_index(spark, saved)
    if not path:
        raise SystemExit("--chains or --index is needed")
    return pipelines.taxonomy_index(files.read_chains(_ordered(files.read_jsonl(spark, path, schemas.CHAINS))))


def score(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = files.read_jsonl(spark, a.input, schemas.JUDGED)
    if a.max_examples:
        rows = R.limit_first(_ordered(rows), a.max_examples).drop("ord")
    known = (*M.MEASURES, "cascade")
    measures = tuple(M.MEASURES) if a.measure == "all" else (a.measure,)
    if set(measures) - set(known):
        raise SystemExit(f"unknown measure {a.measure!r}, known: {', '.join((*known, 'all'))}")
    near = None
    if a.encoder:
        if not a.vectors:
            raise SystemExit("--encoder needs --vectors, a folder that keeps the nodes' vectors")
        near = pipelines.embedded(_client(spark, a.encoder), a.vectors, a.model or a.encoder)
    scored = pipelines.score_rows(rows, _index(spark, a.chains, a.index), measures, a.top_k, a.min_score, candidates_of=near, stem=a.stem)
    scored.write.mode("overwrite").json(a.out)
    _write_results(spark.read.schema(scored.schema).json(a.out), a)


def _judge_of(spark: SparkSession, path: str) -> dict:
    """Model and mode of the judge by the metadata of the run that a file belongs to."""
    folder, _, name = path.rstrip("/").rpartition("/")
    run = re.sub(r"_(samples|judged|scored)$", "", name.removesuffix(".jsonl"))
    for found in files.paths_like(spark, f"{folder or '.'}/{run}*_metadata.json"):
        told = json.loads(files.read_text(spark, found))
        if told.get("judge_model"):
            return {"judge_model": told["judge_model"], "judge_mode": told.get("judge_mode", "unknown")}
    return {}


def _write_results(scored: DataFrame, a: argparse.Namespace) -> None:
    (text,) = files.metrics_json(pipelines.run_results(scored, a.run, a.strict)).select("results").head()
    files.write_text(scored.sparkSession, a.results, json.dumps(json.loads(text) | _judge_of(scored.sparkSession, a.input)) + "\n")


def aggregate(spark: SparkSession, a: argparse.Namespace) -> None:
    """The results of a file that is scored already."""
    _write_results(pipelines.read_scored(spark, a.input), a)


def index(spark: SparkSession, a: argparse.Namespace) -> None:
    """Saves the tables of the taxonomy; leaves take the names that --samples give them."""
    chains = files.read_chains(_ordered(files.read_jsonl(spark, a.input, schemas.CHAINS)))
    names = X.sample_names(_ordered(files.read_jsonl(spark, a.samples, schemas.EXAMPLES))) if a.samples else None
    akas = files.read_jsonl(spark, a.aliases, schemas.ALIASES).select("id", F.explode("aka.en.value").alias("alias")) if a.aliases else None
    pipelines.save_index(pipelines.taxonomy_index(chains, names=names, akas=akas), a.out)


def _settings(a: argparse.Namespace, n: int) -> dict:
    return {"temperature": a.temperature, "top_p": a.top_p, "top_k": a.top_k, "max_tokens": a.max_tokens, "n": n}


def _source(spark: SparkSession, a: argparse.Namespace, n: int = 1):
    """What answers prompts, with the log of replies beside the output."""
    if bool(a.client) == bool(a.replies):
        raise SystemExit("one of --client and --replies is needed")
    if a.replies:
        return J.replay(files.read_jsonl(spark, a.replies, schemas.REPLIES))
    client = _client(spark, a.client, _settings(a, n))
    if a.overwrite:
        files.delete(spark, f"{_out(a)}_replies")
    return replies.logged(J.complete_with(client, n), spark, f"{_out(a)}_replies", json.dumps([a.client, a.model, _settings(a, n)]), a.chunk)


def _client(spark: SparkSession, named: str, settings: dict | None = None):
    """A function of that module, looked up on the executors; one that takes a third argument is given the settings."""
    module, _, name = named.partition(":")
    found = importlib.import_module(module)  # a wrong name fails here, not on the executors
    if not hasattr(found, "__path__"):
        spark.sparkContext.addPyFile(found.__file__)
    more = (settings,) if settings is not None and len(inspect.signature(getattr(found, name)).parameters) > 2 else ()
    return lambda *given: getattr(importlib.import_module(module), name)(*given, *more)


def _out(a: argparse.Namespace) -> str:
    """The output, or that of this shard."""
    if a.num_shards == 1:
        return a.out
    return f"{a.out}_shard{a.shard}.jsonl" if a.run_command is judge else f"{a.out.removesuffix('.jsonl')}_shard{a.shard}.jsonl"


def _rows(spark: SparkSession, a: argparse.Namespace, schema: str) -> DataFrame:
    """The input's rows, the first of them if a number is given, of one shard, without those in any output if it is resumed.

    Rows go by data_id or else image_id; those without either are taken as done once one of them is.
    """
    if not 0 <= a.shard < a.num_shards:
        raise SystemExit(f"--shard must be in [0, {a.num_shards})")
    rows = files.read_jsonl(spark, a.input, schema)
    if a.max_examples:
        rows = R.limit_first(_ordered(rows), a.max_examples).drop("ord")
    if a.num_shards > 1:
        rows = R.shard(numbered(rows, "ord"), a.shard, a.num_shards).drop("ord")
    if a.overwrite:
        return rows
    shards = files.paths_like(spark, f"{a.out.removesuffix('.jsonl')}*_shard*.jsonl")
    if files.exists(spark, _out(a)) and not a.resume:
        raise SystemExit(f"{_out(a)} is there already: --resume or --overwrite")
    written = sorted({p for p in (*shards, a.out) if files.exists(spark, p)})
    if not written or not a.resume:
        return rows
    key = lambda: F.coalesce(R.row_key(F.col("data_id"), F.col("image_id")), F.lit(""))
    done = files.read_jsonl(spark, written, schema).select(key().alias("_done")).distinct()
    return rows.withColumn("_key", key()).join(done, F.col("_key") == F.col("_done"), "left_anti").drop("_key")


def _told(spark: SparkSession, path: str, stem: str, told: dict) -> None:
    """Writes metadata beside an output."""
    files.write_text(spark, f"{path.rpartition('/')[0] or '.'}/{stem}_metadata.json", json.dumps(told, indent=2))


def _write(spark: SparkSession, a: argparse.Namespace, out: DataFrame) -> str:
    """Writes the rows and drops the log of replies, which they have made needless."""
    path = _out(a)
    files.write_jsonl(out, path, append=a.resume)
    files.delete(spark, f"{path}_replies")
    return path


def _run_metadata(a: argparse.Namespace, n: int, method: str) -> dict:
    told = {
        "model": a.model or a.client or "replay", "method": method, "prompt_variant": a.variant, "sampling": _settings(a, n),
        "data": {"input": a.input, "max_examples": a.max_examples, "chunk_size": a.chunk, "resume": a.resume, "no_image": a.no_image},
    }
    return told | ({"sharding": {"shard": a.shard, "num_shards": a.num_shards}} if a.num_shards > 1 else {})


def _stem(a: argparse.Namespace) -> str:
    return re.sub(r"_samples(?=$|_shard)", "", _out(a).rpartition("/")[2].removesuffix(".jsonl"))


def judge(spark: SparkSession, a: argparse.Namespace) -> None:
    """Verdicts on all answers; with --descriptions, free-form prompts show what is known of the truth and its parents."""
    known = None
    if a.descriptions:
        if a.structured:
            raise SystemExit("--descriptions are for free-form prompts only")
        if not (a.chains or a.index):
            raise SystemExit("--descriptions need --chains or --index for the labels")
        read = lambda path: files.read_chains(_ordered(files.read_jsonl(spark, path, schemas.CHAINS)))
        labels = read(a.chains) if a.chains else pipelines.label_chains(pipelines.load_index(spark, a.index)["entities"])
        known = pipelines.evidence(labels, read(a.descriptions))
    rows = R.strip_columns(_rows(spark, a, schemas.JUDGED), prefixes=("judge_",))
    told = {
        "judge_model": a.model or a.client or "replay", "judge_mode": "structured" if a.structured else "free-form", "judge_with_desc": bool(a.descriptions), "label_chains": a.chains or "",
        "taxonomy_index": a.index or "", "desc_chains": a.descriptions or "", "input": a.input, "sampling": _settings(a, a.votes),
    }
    judged = pipelines.judge_rows(rows, _source(spark, a, a.votes), a.structured, known)
    path = _write(spark, a, judged)
    written = files.read_jsonl(spark, path, schemas.JUDGED)
    told["num_examples"] = written.count()
    told["parse_errors"] = written.where(F.array_contains("judge_reasons", "(parse error)")).select(F.explode("judge_reasons").alias("r")).where("r = '(parse error)'").count()
    _told(spark, path, path.rpartition("/")[2].removesuffix(".jsonl"), told)


def infer(spark: SparkSession, a: argparse.Namespace) -> None:
    if min(a.n, a.rounds) < 1:
        raise SystemExit("--n and --rounds must be at least 1")
    rows = _rows(spark, a, schemas.SAMPLES)
    method = "iterative" if a.rounds > 1 else "naive-sampling" if a.n > 1 else "naive"
    sampling = ", ".join(f"{short}={_settings(a, a.n)[name]}" for short, name in (("temp", "temperature"), ("top_p", "top_p"), ("top_k", "top_k"), ("n", "n")))
    told = _run_metadata(a, a.n, method)
    if method == "iterative":
        told["iterative"] = {"attempts_per_round": a.n, "max_rounds": a.rounds, "enable_feedback": a.feedback, "max_feedback_chars": a.max_feedback_chars}
    elif method == "naive-sampling":
        told["naive_sampling"] = {"samples_per_example": a.n}
    told["data"]["num_examples"] = rows.count()
    _told(spark, _out(a), _stem(a), told)
    _write(spark, a, pipelines.infer(rows, _source(spark, a, a.n), a.rounds, a.feedback, a.variant, a.max_feedback_chars, method, sampling))


def rsa(spark: SparkSession, a: argparse.Namespace) -> None:
    if min(a.population, a.k, a.steps) < 1 or a.k > a.population:
        raise SystemExit("--population, --k and --steps must be at least 1, and --k at most --population")
    rows = _rows(spark, a, schemas.SAMPLES)
    missing = rows.where("all_texts is null or size(all_texts) = 0").count()
    if missing:
        raise SystemExit(f"{missing} rows have no all_texts")
    told = _run_metadata(a, 1, "rsa") | {"rsa": {"population": a.population, "k": a.k, "steps": a.steps, "selection": a.selection, "seed": a.seed}}
    told["data"]["num_examples"] = rows.count()
    _told(spark, _out(a), _stem(a), told)
    _write(spark, a, pipelines.self_aggregate(rows, _source(spark, a), a.population, a.k, a.steps, a.selection, a.seed, a.variant))


def catalog(spark: SparkSession, a: argparse.Namespace) -> None:
    runs = N.catalog(*pipelines.run_files(spark, a.input)).where("status <> 'crashed'").orderBy("run_dir")
    if a.out:
        files.write_tsv(runs, a.out)
    else:
        runs.show(max(runs.count(), 1), truncate=False)


def latest(spark: SparkSession, a: argparse.Namespace) -> None:
    """Prints the last run in the catalog of the given kind, with images unless --no-image."""
    runs = spark.read.option("sep", "\t").option("header", True).csv(a.input)
    prompt = "concise_no_idk" if a.prompt == "no_idk" else a.prompt
    wanted = {"model": a.model, "prompt": prompt, "dataset": a.dataset, "no_image": str(a.no_image).lower()}
    for r in N.latest(runs, **{k: v for k, v in wanted.items() if v}).select("run_dir").collect():
        print(r["run_dir"])


def audit(spark: SparkSession, a: argparse.Namespace) -> None:
    """One row a scored file; of folders all *_scored.jsonl are taken. Without --out it is shown, short unless --details."""
    if all(p.endswith(".jsonl") for p in a.input):
        paths = a.input
    else:
        paths = sorted({r["path"] for r in discovery.matching(discovery.listing(spark, *a.input), discovery.SCORED).select("path").collect()})
        paths += [p for p in a.input if p.endswith(".jsonl") and not p.endswith("_scored.jsonl")]
    if not paths:
        raise SystemExit("no *_scored.jsonl is there")
    path = files.logical(F.col("_metadata.file_path"))
    label = F.lit(a.run) if a.run != "run" else T.run_label(path, a.lead, a.tail) if a.lead else T.stem(path)
    # each row is an example of its own, whatever its id
    rows = _ordered(files.read_jsonl(spark, paths, schemas.JUDGED).withColumn("run", label)).withColumn("row", F.struct("run", "ord", "answer"))
    texts = R.explode_rollouts(rows, "row", verdicts="judge_verdicts").select("row.*", "idx", "text", "verdict")
    names = None
    if a.aliases:
        given = files.read_jsonl(spark, a.aliases, schemas.ALIASES).select("id", F.explode("aka.en.value").alias("alias"))
        leaves = files.read_jsonl(spark, a.chains, schemas.CHAINS).select(F.col("id").alias("_id"), F.get("taxonomy", F.lit(0)).alias("label"))
        names = X.aliases_by_label(given.join(leaves, F.col("id") == F.col("_id")).select("label", "alias"))
    told = A.audit(A.classify(texts, names), "run", "ord")
    if a.out:
        files.write_tsv(told, a.out)
    else:
        told.orderBy("run").drop(*(() if a.details else A.DETAILS)).show(max(told.count(), 1), truncate=False)


def dedup(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = _ordered(files.read_jsonl(spark, a.input, schemas.SAMPLES))
    kept = R.dedup_first(rows, "data_id")
    if a.dry_run:
        print(f"{rows.count()} rows, {kept.count()} kept")
    else:
        files.write_jsonl(kept.drop("ord"), a.out)


def repair(spark: SparkSession, a: argparse.Namespace) -> None:
    samples = _ordered(files.read_jsonl_tolerant(spark, a.input, schemas.SAMPLES))
    inputs = _ordered(files.read_jsonl(spark, a.examples, schemas.EXAMPLES))
    if R.duplicate_ids(inputs, "data_id").limit(1).count():
        raise SystemExit("ids of the examples are missing or repeat")
    done = pipelines.repair(samples, inputs, a.expected, a.shards)
    if not a.apply:
        done["stats"].show()
        return
    kept = done["kept"].drop("ord").join(inputs.select(F.col("data_id").alias("_id"), "ord"), F.col("data_id") == F.col("_id")).drop("_id")
    told = lambda backup: (f"{a.out}/manifest", pipelines.manifest(a.run, done, a.expected, a.shards, backup).head()["value"] + "\n")
    publish.publish(spark, f"{a.out}/shards", lambda path: files.write_shards(kept, path, a.shards), told)


def prepare(spark: SparkSession, a: argparse.Namespace) -> None:
    examples = files.read_jsonl(spark, a.input, schemas.EXAMPLES).drop("answer", "dataset", "image_path")
    out = R.prepare(examples, files.read_lookup_csv(spark, a.paths), a.exclude)
    files.write_jsonl(out, a.out)


def layout(spark: SparkSession, a: argparse.Namespace) -> None:
    """Places of the nodes of some chains in a drawing."""
    entities = _index(spark, a.input)["entities"]
    picked = R.sample_chains(entities, "id", "path", a.chains, a.min_depth, a.containing, a.seed)
    files.write_tsv(chain_layout(picked), a.out)


def images(spark: SparkSession, a: argparse.Namespace) -> None:
    """Examples with the files of their images; without any that is missing unless --allow-missing."""
    examples = files.read_jsonl(spark, a.input, schemas.EXAMPLES)
    found = staged(IM.resolve(examples, IM.image_files(spark, a.root), a.root), "images")
    told = IM.missing_images(found).head()
    print(f"{told['examples']} examples, {told['without_path']} without a path, {told['not_found']} not found")
    if told["without_path"] + told["not_found"] and not a.allow_missing:
        raise SystemExit("images are missing")
    files.write_jsonl(found, a.out)


def describe(spark: SparkSession, a: argparse.Namespace) -> None:
    """Chains with descriptions in place of labels, from an endpoint and a cache, for the entities of --examples."""
    labels = files.read_chains(_ordered(files.read_jsonl(spark, a.input, schemas.CHAINS)))
    if a.examples:
        known = files.distinct_ids(files.read_jsonl(spark, a.examples, schemas.EXAMPLES), "entity_id")
        labels = labels.join(known, F.col("id") == F.col("entity_id"), "left_semi")
    rows = staged(descriptions.described_chains(labels, a.endpoint, a.cache), "described")
    files.write_jsonl(rows, a.out)
    told = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("taxonomy")), F.lit(0)), F.coalesce(F.sum(F.size(F.filter("taxonomy", lambda x: x == ""))), F.lit(0))).head()
    print(f"{told[0]} chains, {told[2]} of {told[1]} descriptions missing")


def questions(spark: SparkSession, a: argparse.Namespace) -> None:
    chains = files.read_chains(_ordered(files.read_jsonl(spark, a.chains, schemas.CHAINS))).select(F.col("id").alias("entity_id"), F.col("taxonomy").alias("chain"))
    rows = Q.aligned(files.read_jsonl(spark, a.input, schemas.EXAMPLES), chains)
    files.write_jsonl(rows.where("question_source is not null").drop("parent", "outcome"), a.out)
    Q.outcome_stats(rows).show()


#: Arguments that name what is read.
READ = ("input", "chains", "index", "examples", "aliases", "samples", "paths", "descriptions", "replies")


def _rooted(a: argparse.Namespace) -> argparse.Namespace:
    """The arguments with relative paths of what is read below EVALGROVE_DATA, if it is set."""
    root = os.environ.get("EVALGROVE_DATA", "").rstrip("/")
    below = lambda x: f"{root}/{x}" if isinstance(x, str) and x and not re.match(r"/|\w+:", x) else x
    for name in READ if root else ():
        value = getattr(a, name, None)
        setattr(a, name, [below(x) for x in value] if isinstance(value, list) else below(value))
    return a


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="evalgrove")
    commands = parser.add_subparsers(required=True)

    def command(run, *paths: str) -> argparse.ArgumentParser:
        sub = commands.add_parser(run.__name__)
        sub.set_defaults(run_command=run)
        sub.add_argument("input", **({"nargs": "*", "default": os.environ.get("EVALGROVE_SCORED", "").split()} if run is audit else {}))
        for p in paths:
            sub.add_argument(f"--{p}", required=True)
        sub.add_argument("--run", default="run")
        return sub

    def asking(run) -> argparse.ArgumentParser:
        sub = command(run, "out")
        for p in ("client", "replies"):
            sub.add_argument(f"--{p}")
        sub.add_argument("--max-examples", type=int)
        sub.add_argument("--variant", default="barebones")
        for p in ("resume", "overwrite", "no-image"):
            sub.add_argument(f"--{p}", action="store_true")
        sub.add_argument("--model", default="", help="the model's name, for the run's metadata")
        sub.add_argument("--chunk", type=int, default=replies.CHUNK, help="prompts between two commits of replies")
        for name, value in (("temperature", 1.0), ("top-p", 1.0), ("top-k", -1), ("max-tokens", 300)):
            sub.add_argument(f"--{name}", type=type(value), default=value, help="for clients that take settings, and for the metadata")
        sub.add_argument("--shard", type=int, default=0)
        sub.add_argument("--num-shards", type=int, default=1)
        return sub

    sub = asking(judge)
    sub.add_argument("--votes", type=int, default=1)
    sub.add_argument("--structured", action="store_true")
    for p in ("descriptions", "chains", "index"):
        sub.add_argument(f"--{p}")
    sub = asking(infer)
    sub.add_argument("--n", type=int, default=1)
    sub.add_argument("--rounds", type=int, default=1)
    sub.add_argument("--feedback", action="store_true")
    sub.add_argument("--max-feedback-chars", type=int, default=2000)
    sub = asking(rsa)
    for name, value in (("population", 16), ("k", 4), ("steps", 2)):
        sub.add_argument(f"--{name}", type=int, default=value)
    sub.add_argument("--selection", choices=("first", "random"), default="first")
    sub.add_argument("--seed", default="1234")
    command(aggregate, "results").add_argument("--strict", action="store_true")
    sub = command(index, "out")
    for p in ("samples", "aliases"):
        sub.add_argument(f"--{p}")
    command(catalog).add_argument("--out")
    sub = command(latest)
    for p in ("model", "prompt", "dataset"):
        sub.add_argument(f"--{p}")
    sub.add_argument("--no-image", action="store_true")
    sub = command(score, "out", "results")
    sub.add_argument("--chains")
    sub.add_argument("--index", help="a folder that the index command wrote")
    sub.add_argument("--measure", default="exact_match")
    sub.add_argument("--encoder", help="module:function that gives texts their vectors, for the cascade's candidates; bigrams without")
    sub.add_argument("--model", help="the name that vectors are kept under")
    sub.add_argument("--vectors", default=os.environ.get("EVALGROVE_VECTORS"))
    sub.add_argument("--top-k", type=int, default=3)
    sub.add_argument("--min-score", type=float, default=0.35)
    sub.add_argument("--stem", action="store_true", help="compare stems of words in direct matching")
    sub.add_argument("--max-examples", type=int)
    sub.add_argument("--strict", action="store_true", help="leave out pass@k of examples with fewer than k answers")
    sub = command(audit)
    for p in ("out", "aliases"):
        sub.add_argument(f"--{p}")
    for p in ("lead", "tail"):
        sub.add_argument(f"--{p}", default="", help="what a folder's name has around the run's label")
    sub.add_argument("--details", action="store_true")
    sub.add_argument("--chains")
    command(dedup, "out").add_argument("--dry-run", action="store_true")
    sub = command(repair, "examples", "out")
    sub.add_argument("--expected", type=int, default=256)
    sub.add_argument("--shards", type=int, default=4)
    sub.add_argument("--apply", action="store_true")
    command(prepare, "paths", "out").add_argument("--exclude", nargs="*", default=[])
    command(questions, "chains", "out")
    sub = command(layout, "out")
    sub.add_argument("--chains", type=int, default=50, help="how many chains are drawn")
    sub.add_argument("--min-depth", type=int, default=2)
    sub.add_argument("--containing", default="")
    sub.add_argument("--seed", default="42")
    command(images, "root", "out").add_argument("--allow-missing", action="store_true")
    command(describe, "endpoint", "cache", "out").add_argument("--examples")
    a = _rooted(parser.parse_args(argv))
    a.run_command(spark or SparkSession.builder.appName("evalgrove").getOrCreate(), a)


if __name__ == "__main__":
    main()
