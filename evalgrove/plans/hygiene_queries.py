"""Queries on dedup, resume, shards, repair, splits and the catalog of runs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrove.operators import images
from evalgrove.operators import rollouts as R
from evalgrove.operators import runs as N
from evalgrove.sources import caches, discovery, files, staging

from .registry import Tables, query


@query("SELECT ord, data_id FROM (SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY ord) AS n FROM {samples}) WHERE n = 1 OR data_id = ''")
def dedup_first(t: Tables) -> DataFrame:
    return R.dedup_first(t.samples, "data_id").select("ord", "data_id")


@query("SELECT ord, data_id, n_texts FROM (SELECT *, row_number() OVER (PARTITION BY data_id ORDER BY n_texts DESC, ord) AS n FROM {samples}) WHERE n = 1")
def dedup_best(t: Tables) -> DataFrame:
    return R.dedup_best(t.samples, "data_id", "n_texts").select("ord", "data_id", "n_texts")


@query("SELECT ord, data_id FROM {samples} WHERE data_id NOT IN (SELECT data_id FROM {samples} WHERE ord % 3 = 0)")
def resume_anti(t: Tables) -> DataFrame:
    return R.remaining(t.samples, t.samples.where("ord % 3 = 0"), "data_id").select("ord", "data_id")


@query("SELECT ord, data_id FROM {samples} WHERE data_id IN (SELECT data_id FROM {samples} WHERE ord % 5 = 0)")
def valid_semi(t: Tables) -> DataFrame:
    return R.valid(t.samples, t.samples.where("ord % 5 = 0"), "data_id").select("ord", "data_id")


@query("SELECT ord % 4 AS shard, ord FROM {samples} WHERE ord % 4 IN (1, 3)")
def shard_strided(t: Tables) -> DataFrame:
    parts = [R.shard(t.samples, k, 4).select(F.lit(k).cast("long").alias("shard"), "ord") for k in (1, 3)]
    return parts[0].unionByName(parts[1])


@query("SELECT (ord % 4)::INT AS shard, count(*)::BIGINT AS expected, count_if(data_id IN (SELECT data_id FROM {samples} WHERE n_texts >= 3 AND data_id <> ''))::BIGINT AS completed, (count(*) - count_if(data_id IN (SELECT data_id FROM {samples} WHERE n_texts >= 3 AND data_id <> '')))::BIGINT AS remaining FROM {samples} GROUP BY 1")
def shard_counts(t: Tables) -> DataFrame:
    done = t.samples.where("n_texts >= 3 and data_id <> ''")
    return R.shard_counts(t.samples, done, "data_id", 4)


_REASON = (
    "(SELECT *, CASE WHEN bad THEN 'malformed' WHEN data_id = '' THEN 'no_id' WHEN n_texts < 2 THEN 'incomplete' WHEN data_id IN (SELECT data_id FROM {samples} WHERE ord % 2 = 0) THEN NULL ELSE 'unknown_id' END AS why FROM {samples})"
)


@query(f"SELECT coalesce(why, CASE WHEN n = 1 THEN 'kept' ELSE 'duplicate' END) AS reason, count(*)::BIGINT AS rows FROM (SELECT *, row_number() OVER (PARTITION BY data_id, why IS NULL ORDER BY n_texts DESC, ord) AS n FROM {_REASON}) GROUP BY 1")
def repair_stats(t: Tables) -> DataFrame:
    return R.repair_stats(R.repair_reasons(t.samples, t.samples.where("ord % 2 = 0"), "data_id", "n_texts", 2))


@query("SELECT data_id, count(*)::BIGINT AS rows FROM {samples} GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(t: Tables) -> DataFrame:
    return R.duplicate_ids(t.samples, "data_id")


@query("SELECT ord, coalesce(data_id <> '' AND n_texts >= 4, FALSE) AS complete FROM {samples}")
def complete_rows(t: Tables) -> DataFrame:
    rows = t.samples.withColumn("all_texts", F.array_repeat(F.lit("x"), F.col("n_texts").cast("int")))
    return rows.select("ord", R.is_complete("data_id", "all_texts", 4).alias("complete"))


@query("SELECT count(*)::BIGINT AS merged, (SELECT count(*) FROM {samples})::BIGINT AS expected, count(*) = (SELECT count(*) FROM {samples}) AS complete FROM {samples} WHERE ord % 4 < 3")
def merge_gate(t: Tables) -> DataFrame:
    return R.merge_gate([R.shard(t.samples, k, 4) for k in range(3)], t.samples)


@query("SELECT ord, data_id FROM {samples} ORDER BY ord LIMIT 10")
def limit_first(t: Tables) -> DataFrame:
    """The feature is the limit: the first rows in file order."""
    return R.limit_first(t.samples, 10).select("ord", "data_id")


@query("SELECT example_id, idx, text FROM {rollouts} WHERE idx < 2")
def first_k(t: Tables) -> DataFrame:
    return R.first_k(t.rollouts, 2).select("example_id", "idx", "text")


@query(
    "SELECT data_id, CASE WHEN r <= floor(n * 0.5::DOUBLE + 1e-9) THEN 'train' WHEN r <= floor(n * 0.6::DOUBLE + 1e-9) THEN 'dev' ELSE 'test' END AS split FROM (SELECT data_id, row_number() OVER (ORDER BY md5(concat('0/', data_id)), data_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT data_id FROM {samples}))"
)
def split_hash(t: Tables) -> DataFrame:
    return R.hash_split(t.samples, "data_id", {"train": 0.5, "dev": 0.1, "test": 0.4})


@query("SELECT id, array_to_string(path, ' > ') AS path FROM {part_chains} WHERE len(path) >= 2 AND contains(lower(array_to_string(path, ' ')), 'red') ORDER BY md5(concat('42/', id)), id LIMIT 5")
def chain_sample(t: Tables) -> DataFrame:
    """The feature is the limit: a seeded sample of chains."""
    rows = R.sample_chains(t.part_chains, "id", "path", 5, 2, "red")
    return rows.select("id", F.array_join("path", " > ").alias("path"))


@query(
    "SELECT d.doc_id, d.lang AS answer, coalesce(CASE WHEN contains(l.path, '/') AND split_part(l.path, '/', 1) <> '' THEN split_part(l.path, '/', 1) ELSE CASE WHEN l.path IS NOT NULL THEN 'unknown' END END, 'unknown') AS dataset, l.path AS image_path "
    "FROM {documents} d LEFT JOIN (SELECT doc_id, concat(source, '/', doc_id::VARCHAR, '.jpg') AS path FROM {documents} WHERE doc_id % 3 > 0) l ON d.doc_id = l.doc_id WHERE coalesce(split_part(l.path, '/', 1), 'unknown') <> 'src1'"
)
def prepare_bridge(t: Tables) -> DataFrame:
    image = F.col("doc_id").cast("string")
    paths = files.lookup(t.documents.where("doc_id % 3 > 0").select(image.alias("image_id"), F.concat("source", F.lit("/"), image, F.lit(".jpg")).alias("path")))
    examples = t.documents.select("doc_id", image.alias("image_id"), F.col("lang").alias("entity_text"))
    return R.prepare(examples, paths, exclude=["src1"]).select("doc_id", "answer", "dataset", "image_path")


@query("SELECT doc_id, lang FROM {documents}")
def strip_columns(t: Tables) -> DataFrame:
    rows = t.documents.select("doc_id", "lang", F.lit(1).alias("judge_hit"), F.lit(0.5).alias("cascade_hF"), F.lit(1).alias("hP"), F.lit("x").alias("scored_reference_path"), F.lit(0.1).alias("sentence_bert_hF"))
    return R.strip_columns(rows)


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN source ELSE lang END AS key FROM {documents}")
def row_key(t: Tables) -> DataFrame:
    first = F.when(F.col("doc_id") % 3 == 0, F.col("source")).when(F.col("doc_id") % 3 == 1, "")
    return t.documents.select("doc_id", R.row_key(first, F.col("lang")).alias("key"))


@query("SELECT DISTINCT coalesce(CASE WHEN doc_id % 7 > 0 THEN lang END, source) AS entity_id FROM {documents}")
def eval_ids(t: Tables) -> DataFrame:
    return files.distinct_ids(t.documents.select(F.when(F.col("doc_id") % 7 > 0, F.col("lang")).otherwise("").alias("entity_id"), F.col("source").alias("entity")), "entity_id", "entity")


@query("SELECT image_id, max_by(path, doc_id) AS path, split_part(max_by(path, doc_id), '/', 1) AS dataset FROM (SELECT doc_id, (doc_id % 300)::VARCHAR AS image_id, concat(lang, '/', doc_id::VARCHAR) AS path FROM {documents}) GROUP BY 1")
def lookup_last_wins(t: Tables) -> DataFrame:
    image = F.col("doc_id").cast("string")
    return files.lookup(t.documents.select("doc_id", (F.col("doc_id") % 300).cast("string").alias("image_id"), F.concat("lang", F.lit("/"), image).alias("path")), order="doc_id")


@query("SELECT event_id, CASE WHEN event_id % 9 = 0 THEN NULL ELSE regexp_extract(props, '(\\d+)', 1)::BIGINT END AS k, CASE WHEN event_id % 9 = 0 THEN concat('{x', props) END AS _corrupt_record FROM {events} WHERE event_id % 10 > 0")
def tolerant_jsonl(t: Tables) -> DataFrame:
    """Lines, some malformed and some blank: the malformed keep their text, the blank go."""
    line = F.when(F.col("event_id") % 10 == 0, "  ").when(F.col("event_id") % 9 == 0, F.concat(F.lit("{x"), "props")).otherwise(F.col("props"))
    return files.parse_jsonl(t.events.select("event_id", line.alias("value")), "k bigint").select("event_id", "k", "_corrupt_record")


_FILES = (
    "(SELECT concat('logs/', source) AS run_dir, name, (doc_id % 100)::BIGINT AS rows FROM (SELECT *, CASE doc_id % 13 WHEN 0 THEN 'a_samples.jsonl' WHEN 1 THEN 'a_samples_shard0.jsonl' WHEN 2 THEN 'a_samples_judged_m.jsonl' WHEN 3 THEN 'a_judged_shard1.jsonl' "
    "WHEN 4 THEN 'a_scored.jsonl' WHEN 5 THEN 'a_results_m.json' ELSE 'log.txt' END AS name FROM {documents}))"
)


@query(
    "WITH f AS " + _FILES + ", p AS (SELECT run_dir, max(rows) FILTER (WHERE name = 'a_samples.jsonl') AS merged, sum(rows) FILTER (WHERE name = 'a_samples_shard0.jsonl') AS sharded, count_if(name = 'a_scored.jsonl') AS scored, count_if(name = 'a_samples_judged_m.jsonl') AS judged, count_if(name = 'a_results_m.json') AS results FROM f GROUP BY 1) "
    "SELECT run_dir, CASE WHEN run_dir LIKE '%3' THEN 'crashed' WHEN results > 0 OR scored > 0 THEN 'complete' WHEN judged > 0 THEN 'judged' WHEN merged IS NOT NULL OR sharded IS NOT NULL THEN 'samples' ELSE 'empty' END AS status, "
    "CASE WHEN run_dir LIKE '%3' THEN '' WHEN run_dir LIKE '%5' THEN 'aligned' ELSE 'original' END AS dataset, CASE WHEN run_dir LIKE '%3' THEN '' ELSE '8b' END AS model, "
    "coalesce(nullif(coalesce(merged, sharded), 0), CASE WHEN run_dir LIKE '%3' THEN 0 ELSE 14 END)::BIGINT AS total_examples, scored::BIGINT AS scored, judged::BIGINT AS judged, results::BIGINT AS results FROM p"
)
def run_catalog(t: Tables) -> DataFrame:
    return _catalog(t).select("run_dir", "status", "dataset", "model", "total_examples", "scored", "judged", "results")


def _catalog(t: Tables) -> DataFrame:
    k = F.col("doc_id") % 13
    name = F.when(k == 0, "a_samples.jsonl").when(k == 1, "a_samples_shard0.jsonl").when(k == 2, "a_samples_judged_m.jsonl").when(k == 3, "a_judged_shard1.jsonl").when(k == 4, "a_scored.jsonl").when(k == 5, "a_results_m.json").otherwise("log.txt")
    found = t.documents.select(F.concat(F.lit("logs/"), "source").alias("run_dir"), name.alias("name"), (F.col("doc_id") % 100).alias("rows"))
    runs = found.select("run_dir").distinct().where(~F.endswith("run_dir", F.lit("3")))
    path = F.when(F.endswith("run_dir", F.lit("5")), "aligned.jsonl").otherwise("plain.jsonl")
    meta = runs.select("run_dir", F.lit("Lab/Model-8B-it").alias("model"), path.alias("dataset_path"), F.lit("barebones").alias("prompt"), F.lit(False).alias("no_image"), F.lit(2).alias("num_shards"), F.lit(7).alias("shard_examples"))
    return N.catalog(found, meta)


@query("SELECT max(run_dir) AS run_dir FROM " + _FILES + " WHERE run_dir LIKE '%5' HAVING max(run_dir) IS NOT NULL")
def latest_run(t: Tables) -> DataFrame:
    return N.latest(_catalog(t), dataset="aligned").select("run_dir")


@query("SELECT user_id AS model, max(run_id) AS run_id FROM (SELECT user_id, concat(strftime(ts, '%Y%m%d_%H%M%S'), '_', CASE WHEN event_id % 5 = 0 THEN 'x' ELSE lpad(event_id::VARCHAR, 6, '0') END) AS run_id FROM {events}) WHERE run_id NOT LIKE '%x' GROUP BY 1")
def latest_by_model(t: Tables) -> DataFrame:
    tail = F.when(F.col("event_id") % 5 == 0, "x").otherwise(F.lpad(F.col("event_id").cast("string"), 6, "0"))
    rows = t.events.select(F.col("user_id").alias("model"), F.concat_ws("_", F.date_format("ts", "yyyyMMdd_HHmmss"), tail).alias("run_id"))
    return N.latest_by(rows, "model")


@query("SELECT label, count(*)::BIGINT AS images, string_agg(image, '|' ORDER BY image) AS all_images FROM (SELECT lang AS label, concat('img/', doc_id::VARCHAR) AS image FROM {documents}) GROUP BY 1")
def image_map(t: Tables) -> DataFrame:
    rows = t.documents.select(F.col("lang").alias("label"), F.concat(F.lit("img/"), F.col("doc_id").cast("string")).alias("image"))
    grouped = rows.groupBy("label").agg(F.array_sort(F.collect_list("image")).alias("i"))
    return grouped.select("label", F.size("i").cast("long").alias("images"), F.array_join("i", "|").alias("all_images"))


_JUDGED = "CASE doc_id % 4 WHEN 0 THEN CASE WHEN source LIKE '%1' THEN 'a_judged.jsonl_shard1.jsonl' ELSE 'b.jsonl' END WHEN 1 THEN concat('a_judged_', lang, '.jsonl') WHEN 2 THEN 'a_judged_shard1.jsonl' ELSE 'log.txt' END"


@query(
    f"WITH f AS (SELECT DISTINCT source AS run_dir, {_JUDGED} AS name FROM {{documents}}), m AS (SELECT *, CASE WHEN ends_with(name, '_judged.jsonl_shard1.jsonl') THEN 0 WHEN contains(name, 'judged') AND NOT contains(name, 'shard') THEN 1 END AS place FROM f) "
    "SELECT run_dir, name FROM (SELECT *, min(place) OVER (PARTITION BY run_dir) AS best FROM m WHERE place IS NOT NULL) WHERE place = best"
)
def judged_files(t: Tables) -> DataFrame:
    """Shards of judged answers where a run has any, else its merged files."""
    found = t.documents.selectExpr("source AS run_dir", f"{_JUDGED} AS name").distinct()
    return discovery.preferred(found, discovery.JUDGED).select("run_dir", "name")


@query("SELECT doc_id AS id, concat('about ', doc_id::VARCHAR) AS description, doc_id % 3 > 0 AS late FROM {documents}")
def cache_fill(t: Tables) -> DataFrame:
    """A cache that a run left with every third id is asked for all: the rest is fetched, what is there stays."""
    folder = f"{staging.shared_folder(t.spark)}/cache-{uuid.uuid4().hex}"
    fetch = lambda late: lambda keys: keys.select("id", F.concat(F.lit("about "), F.col("id").cast("string")).alias("description"), F.lit(late).alias("late"))
    ids, schema = t.documents.select(F.col("doc_id").alias("id")), "id bigint, description string, late boolean"
    caches.filled(ids.where("id % 3 = 0"), fetch(False), folder, schema)
    return caches.filled(ids, fetch(True), folder, schema)


_STEM = "concat('img/', (page_id // 2)::VARCHAR, '.v')"
_FILES = "SELECT concat('/data/img/', page_id::VARCHAR, '.v', CASE page_id % 4 WHEN 0 THEN '.JPEG' WHEN 1 THEN '.jpeg' WHEN 2 THEN '.JPG' ELSE '.png' END) AS file FROM {pages} UNION ALL SELECT concat('/data/img/', page_id::VARCHAR, '.v.jpeg') FROM {pages} WHERE page_id % 3 = 0"


@query(
    f"WITH f AS ({_FILES}), p AS (SELECT page_id, {_STEM} AS stem, CASE page_id % 3 WHEN 0 THEN '.png' WHEN 1 THEN '.jpg' ELSE '' END AS own FROM {{pages}}), "
    "c AS (SELECT page_id, 0 AS rank, concat('/data/', stem, own) AS file FROM p UNION ALL SELECT page_id, rank, concat('/data/', CASE WHEN own = '' THEN left(stem, length(stem) - 2) ELSE stem END, suffix) FROM p, (VALUES (1, '.JPEG'), (2, '.jpeg'), (3, '.JPG')) s(rank, suffix)) "
    "SELECT p.page_id, concat(p.stem, p.own) AS image_path, m.file AS image_file FROM p LEFT JOIN (SELECT page_id, arg_min(file, rank) AS file FROM c SEMI JOIN f ON c.file = f.file GROUP BY 1) m ON p.page_id = m.page_id"
)
def image_paths(t: Tables) -> DataFrame:
    """Paths of images, several examples to one, against a listing in which some have other suffixes and some are missing."""
    stem = F.concat(F.lit("img/"), F.floor(F.col("page_id") / 2).cast("string"), F.lit(".v"))
    own = F.when(F.col("page_id") % 3 == 0, ".png").when(F.col("page_id") % 3 == 1, ".jpg").otherwise("")
    name = F.concat(F.lit("/data/img/"), F.col("page_id").cast("string"), F.lit(".v"))
    kind = F.when(F.col("page_id") % 4 == 0, ".JPEG").when(F.col("page_id") % 4 == 1, ".jpeg").when(F.col("page_id") % 4 == 2, ".JPG").otherwise(".png")
    listed = t.pages.select(F.concat(name, kind).alias("file")).unionByName(t.pages.where("page_id % 3 = 0").select(F.concat(name, F.lit(".jpeg")).alias("file")))
    return images.resolve(t.pages.select("page_id", F.concat(stem, own).alias("image_path")), listed, "/data")
