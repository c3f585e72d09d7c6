"""Queries on the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrove.functions import text as T

from .registry import Tables, d_audit, d_full, d_grams, d_index, d_light, d_match, d_scores, query


def _normalised(t: Tables, f) -> DataFrame:
    out = f(F.col("text"))
    return t.texts.select("doc_id", F.md5(out).alias("digest"), F.length(out).cast("long").alias("size"))


def _twin(x: str) -> str:
    return f"SELECT doc_id, md5({x}) AS digest, length({x})::BIGINT AS size FROM {{texts}}"


@query(_twin(d_scores("text")))
def norm_scores(t: Tables) -> DataFrame:
    return _normalised(t, T.normalize_scores)


@query(_twin(d_match("text")))
def norm_match(t: Tables) -> DataFrame:
    return _normalised(t, T.normalize_match)


@query(_twin(d_audit("text")))
def norm_audit(t: Tables) -> DataFrame:
    return _normalised(t, T.normalize_audit)


@query(_twin(d_index("text")))
def norm_index(t: Tables) -> DataFrame:
    return _normalised(t, T.normalize_index)


@query(_twin(d_light("text")))
def clean_light(t: Tables) -> DataFrame:
    return _normalised(t, T.clean_light)


@query(_twin(d_full("text")))
def clean_full(t: Tables) -> DataFrame:
    return _normalised(t, T.clean_full)


@query(
    "SELECT n, count(*)::BIGINT AS grams, count(DISTINCT g)::BIGINT AS distinct_grams FROM ("
    + " UNION ALL ".join(f"SELECT {n} AS n, unnest({d_grams(d_match('text'), n)}) AS g FROM {{rollouts}}" for n in (1, 2, 3, 4))
    + ") GROUP BY n"
)
def ngrams_n(t: Tables) -> DataFrame:
    norm = T.normalize_match(F.col("text"))
    grams = F.concat(*[F.transform(T.ngrams(norm, n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"))) for n in (1, 2, 3, 4)])
    return t.rollouts.select(F.explode(grams).alias("x")).select("x.n", "x.g").groupBy("n").agg(F.count("*").alias("grams"), F.count_distinct("g").alias("distinct_grams"))


_P, _A = d_grams(d_match("text"), 2), d_grams(d_match("answer"), 2)


@query(
    f"SELECT example_id, idx, round(CASE WHEN len({_A}) > 0 THEN len(list_intersect({_P}, {_A}))::DOUBLE / len({_A}) ELSE 0 END, 9) AS overlap FROM {{rollouts}}"
)
def ngram_overlap(t: Tables) -> DataFrame:
    return t.rollouts.select("example_id", "idx", F.round(T.ngram_overlap(T.normalize_match(F.col("text")), T.normalize_match(F.col("answer"))), 9).alias("overlap"))


@query(
    f"SELECT example_id, idx, contains({d_match('text')}, {d_match('answer')})::INT AS contained, (text = answer)::INT AS same, contains(lower(text), lower(answer))::INT AS contained_raw FROM {{rollouts}}"
)
def contained_sim(t: Tables) -> DataFrame:
    text, answer = F.col("text"), F.col("answer")
    return t.rollouts.select("example_id", "idx", T.contained(text, answer).cast("int").alias("contained"), T.exact_pair(text, answer).cast("int").alias("same"), T.contained_pair(text, answer).cast("int").alias("contained_raw"))


@query("SELECT round(avg((text = answer)::INT), 9) AS exact_match, round(avg(contains(lower(text), lower(answer))::INT), 9) AS contained FROM {rollouts}")
def pair_means(t: Tables) -> DataFrame:
    text, answer = F.col("text"), F.col("answer")
    return t.rollouts.agg(F.round(F.avg(T.exact_pair(text, answer)), 9).alias("exact_match"), F.round(F.avg(T.contained_pair(text, answer)), 9).alias("contained"))


_T, _W = d_audit("text"), d_audit("answer")


@query(f"SELECT example_id, idx, ({_W} <> '' AND contains(concat(' ', {_T}, ' '), concat(' ', {_W}, ' '))) AS inside, ({_T} <> '' AND contains(concat(' ', {_W}, ' '), concat(' ', {_T}, ' '))) AS around FROM {{rollouts}}")
def phrase_in(t: Tables) -> DataFrame:
    text, answer = T.normalize_audit(F.col("text")), T.normalize_audit(F.col("answer"))
    return t.rollouts.select("example_id", "idx", T.phrase_in(answer, text).alias("inside"), T.phrase_in(text, answer).alias("around"))


@query(f"SELECT DISTINCT alias, length({d_audit('alias')}) >= 4 AND NOT regexp_matches({d_audit('alias')}, '^[0-9]+$') AS seed FROM {{part_aliases}}")
def alias_seed(t: Tables) -> DataFrame:
    return t.part_aliases.select("alias", T.is_alias_seed(T.normalize_audit(F.col("alias"))).alias("seed")).distinct()


_SLUGS = "SELECT DISTINCT lower(concat('lab_', p_type, CASE WHEN p_size % 3 = 0 THEN '-alpha' ELSE '-beta' END, '-', CAST(p_size AS {text}), 'b-instruct')) AS slug FROM {{part}}"


@query(
    "SELECT slug, CASE WHEN regexp_extract(slug, '(\\d+)b', 1) <> '' THEN concat(regexp_extract(slug, '(\\d+)b', 1), 'b') ELSE slug END AS size, "
    "concat_ws(' ', CASE WHEN contains(slug, '-alpha') THEN 'Alpha' WHEN contains(slug, '-beta') THEN 'Beta' ELSE split_part(slug, '_', 1) END, "
    "CASE WHEN regexp_extract(slug, '-(\\d+b)-', 1) <> '' THEN upper(regexp_extract(slug, '-(\\d+b)-', 1)) ELSE slug END) AS label "
    "FROM (" + _SLUGS.format(text="VARCHAR") + ")"
)
def model_slug(t: Tables) -> DataFrame:
    kind = F.when(F.col("p_size") % 3 == 0, "-alpha").otherwise("-beta")
    slug = F.lower(F.concat(F.lit("lab_"), "p_type", kind, F.lit("-"), F.col("p_size").cast("string"), F.lit("b-instruct")))
    rows = t.part.select(slug.alias("slug")).distinct()
    return rows.select("slug", T.model_slug(F.col("slug")).alias("size"), T.model_label(F.col("slug"), {"-alpha": "Alpha", "-beta": "Beta"}).alias("label"))


_PATH = "concat('/runs/', source, '/', CASE doc_id % 4 WHEN 0 THEN 'r_samples.jsonl' WHEN 1 THEN 'r_samples_judged_lab_m-4b.jsonl' WHEN 2 THEN 'r_judged_x.jsonl' ELSE 'other.jsonl' END)"


@query(
    "SELECT DISTINCT path, CASE WHEN regexp_matches(path, '_judged_') THEN regexp_replace(path, '(_samples)?_judged_([A-Za-z0-9_.-]+)\\.jsonl$', '_results_\\2.json') "
    "WHEN path LIKE '%\\_samples.jsonl' ESCAPE '\\' THEN regexp_replace(path, '_samples\\.jsonl$', '_results.json') ELSE regexp_replace(path, '[^/]*$', 'generations_results.json') END AS results "
    f"FROM (SELECT {_PATH} AS path FROM {{documents}})"
)
def results_path(t: Tables) -> DataFrame:
    rows = t.documents.selectExpr(f"{_PATH} AS path").distinct()
    return rows.select("path", T.results_path(F.col("path")).alias("results"))


_RUN = "CASE WHEN doc_id % 3 > 0 THEN concat('/logs/lab_m-', CAST(doc_id % 9 AS STRING), 'b-instruct/', source, '/x_scored.jsonl') ELSE concat('/logs/other/', source, '/y.v', CAST(doc_id % 5 AS STRING), '_scored.jsonl') END"


@query(
    "SELECT DISTINCT path, CASE WHEN regexp_extract(path, '/lab_m-([^/]*)-instruct/', 1) <> '' THEN upper(regexp_extract(path, '/lab_m-([^/]*)-instruct/', 1)) ELSE regexp_replace(split_part(path, '/', -1), '\\.[^.]*$', '') END AS run, "
    "CASE WHEN regexp_extract(path, 'm-(\\d+b)', 1) <> '' THEN concat('Model ', upper(regexp_extract(path, 'm-(\\d+b)', 1))) ELSE split_part(path, '/', -3) END AS label, split_part(path, '/', -2) AS folder, "
    "CASE WHEN path LIKE '%m-%' THEN concat('M ', upper(regexp_extract(path, '-(\\d+b)-', 1))) ELSE 'other' END AS bare, regexp_replace(path, '\\.jsonl$', '_rsa_n16_k4_t2.jsonl') AS aggregated "
    f"FROM (SELECT {_RUN} AS path FROM {{documents}})"
)
def run_labels(t: Tables) -> DataFrame:
    rows, path = t.documents.selectExpr(f"{_RUN} AS path").distinct(), F.col("path")
    slug = T.above(path, 2)
    return rows.select(
        "path", T.run_label(path, "lab_m-", "-instruct").alias("run"), T.path_label(path, {"m": "Model"}).alias("label"), T.above(path).alias("folder"),
        T.model_label(slug, {"lab_m": "M"}, bare=True).alias("bare"), T.aggregated_path(path, 16, 4, 2).alias("aggregated"),
    )


@query(
    "SELECT event_id, concat('logs/eval_', event_type, '_concise/lab_m-', user_id::VARCHAR, 'b/', strftime(ts, '%Y%m%d_%H%M%S'), '_', lpad((event_id % 1000000)::VARCHAR, 6, '0')) AS folder FROM {events}"
)
def output_dir(t: Tables) -> DataFrame:
    model = F.concat(F.lit("Lab/M-"), F.col("user_id").cast("string"), F.lit("B"))
    run = T.run_id(F.col("ts"), F.col("event_id"))
    return t.events.select("event_id", T.output_dir("logs", "eval", F.col("event_type"), F.lit("concise"), model, run).alias("folder"))
