"""Operators on small tables, plans, files and the stream."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evalgrove.functions.text import normalize_match
from evalgrove.operators import audit, compare, judge, match, questions, rollouts, score, taxonomy
from evalgrove.sources import files, schemas
from evalgrove.streaming import resume


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture(scope="module")
def nodes(spark):
    paths = spark.createDataFrame([(["poodle", "dog", "animal", "root"],), (["tabby cat", "cat", "animal", "root"],), (["cat", "animal", "root"],), (["poodle", "toy", "root"],)], "path array<string>")
    return taxonomy.with_ordinals(taxonomy.node_paths(taxonomy.edges(paths)))


def test_shortest_path_wins(nodes):
    got = {r["label"]: r["path"] for r in nodes.collect()}
    assert got["poodle"] == ["poodle", "toy", "root"]
    assert got["tabby cat"] == ["tabby cat", "cat", "animal", "root"]


def test_cycles_end(spark):
    links = spark.createDataFrame([("root", "a"), ("a", "b"), ("b", "a")], "parent string, child string")
    assert {r["label"]: r["depth"] for r in taxonomy.node_paths(links).collect()} == {"a": 2, "b": 3}


def test_exact_is_an_equi_join(spark, nodes):
    texts = spark.createDataFrame([("A: Cat.",), ("catfish",)], "text string")
    out = match.direct(texts, nodes, "exact_match")
    assert {r["text"]: r["predicted_node"] for r in out.collect()} == {"A: Cat.": "cat", "catfish": None}
    assert "BroadcastNestedLoopJoin" not in plan(out) and "CartesianProduct" not in plan(out) and "Python" not in plan(out)


def test_contained_matches_inside_words(spark, nodes):
    texts = spark.createDataFrame([("catfish",)], "text string")
    assert match.direct(texts, nodes, "contained").head()["predicted_node"] == "cat"


def test_cascade_stages(spark, nodes):
    texts = spark.createDataFrame([("tabby cat",), ("a big poodle dog",), ("zzz",)], "text string")
    top = match.top_k(texts, nodes, match.lexical_hits(texts, nodes), 3, last_wins=False)
    got = {r["text"]: (r["predicted_node"], r["mapping_method"]) for r in match.cascade(texts, nodes, top).collect()}
    assert got["tabby cat"] == ("tabby cat", "exact_match_in_top_k")
    assert got["a big poodle dog"][1].startswith("ngram_")
    assert match.cascade(texts, nodes, top, min_score=0.35).where("text = 'zzz'").head()["mapping_method"] == "none"


def test_mapped_means_and_all(spark):
    data = spark.createDataFrame([(1, 0, ["a", "root"], ["a", "root"], "a", "a"), (2, 0, None, ["b", "root"], None, "b")], "example_id int, idx int, predicted_path array<string>, reference_path array<string>, predicted_node string, answer string")
    got = score.run_metrics(score.scored(data)).head()
    assert (got["hF"], got["hF_all"], got["num_examples"], got["num_mapped"], got["exact"]) == (1.0, 0.5, 2, 1, 1.0)
    assert score.run_metrics(score.scored(data.limit(0))).head()["hF"] == 0.0


def test_reaggregate_asks_for_columns(spark):
    with pytest.raises(ValueError, match="columns are missing"):
        score.reaggregate(spark.createDataFrame([(1.0,)], "x_hP double"), "x")


def test_ties_are_no(spark):
    replies = spark.createDataFrame([(1, 0, "<answer>1</answer>"), (1, 1, "<answer>0</answer>"), (2, 0, "?"), (2, 1, "?"), (3, 0, "<answer>1</answer>"), (3, 1, "?")], "example_id int, completion int, reply string")
    got = {r["example_id"]: (r["votes_yes"], r["votes_no"], r["verdict_majority"], r["parse_ok"]) for r in judge.votes(replies, "example_id").collect()}
    assert got == {1: (1, 1, False, True), 2: (0, 1, False, False), 3: (1, 1, False, True)}


def test_client_is_asked_once_a_prompt(spark):
    rows_ = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "id int, prompt string")
    source = judge.complete_with(lambda prompts, n: [[x + "!"] * n for x in prompts], n=2)
    assert judge.fan_out(rows_, source).count() == 6
    assert {r["reply"] for r in judge.fan_out(rows_, source).collect()} == {"p!", "q!"}


def test_population_is_padded_in_turn(spark):
    texts = spark.createDataFrame([(1, i, t) for i, t in enumerate(["c1", " ", "c2", "c3"])] + [(2, 0, " ")], "example_id int, idx int, text string")
    got = {}
    for r in judge.population(texts, 5).orderBy("slot").collect():
        got.setdefault(r["example_id"], []).append(r["text"])
    assert got == {1: ["c1", "c2", "c3", "c1", "c2"], 2: [""] * 5}


def test_categories(spark):
    data = spark.createDataFrame([("cat", "domestic cat"), ("Domestic Cat", "domestic cat"), ("moggy", "domestic cat"), ("my domestic cat", "domestic cat"), ("a moggy here", "domestic cat"), ("car", "domestic cat"), ("", "")], "text string, answer string")
    names = spark.createDataFrame([("domestic cat", "moggy"), ("domestic cat", "ca")], "canonical string, alias string")
    got = [r["category"] for r in audit.classify(data, names).collect()]
    assert sorted(map(str, got)) == sorted(["answer_contains_prediction", "exact", "alias", "contains_answer", "contains_alias", "None", "exact"])


def test_single_frequency_has_no_generic_nodes(spark):
    got = questions.generic_threshold(spark.createDataFrame([("a", 3), ("b", 3)], "node string, df long"))
    assert got.head()["threshold"] == 3


def test_dedup_is_idempotent_and_shards_partition(spark):
    data = spark.createDataFrame([(i, f"k{i % 3}" if i % 4 else "") for i in range(12)], "ord int, data_id string")
    once = rollouts.dedup_first(data, "data_id")
    assert rows(rollouts.dedup_first(once, "data_id")) == rows(once)
    assert sum(rollouts.shard(data, k, 5).count() for k in range(5)) == 12


def test_refusals_by_k_use_all_if_fewer(spark):
    data = spark.createDataFrame([(1, 0, "I don't know"), (1, 1, "cat")], "example_id int, idx int, text string")
    got = {r["k"]: r["percent"] for r in compare.refusal_by_k(data, ks=(1, 2, 8)).collect()}
    assert got == {1: 100.0, 2: 50.0, 8: 50.0}


def test_jsonl_round_trip(spark, tmp_path):
    data = spark.createDataFrame([("1", "ünï")], "data_id string, text string")
    files.write_jsonl(data, str(tmp_path / "x"))
    files.write_jsonl(data, str(tmp_path / "x"), append=True)
    assert rows(files.read_jsonl(spark, str(tmp_path / "x"), "data_id string, text string")) == [("1", "ünï")] * 2
    (tmp_path / "bad.jsonl").write_text('{"data_id": "1"}\n\nnope\n')
    got = files.read_jsonl_tolerant(spark, str(tmp_path / "bad.jsonl"), "data_id string")
    assert rows(got) == [("1", None), (None, "nope")]
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "data_id string").collect()


def test_csv_lookup_tsv_and_shards(spark, tmp_path):
    (tmp_path / "l.csv").write_text("id,path\n1,cars/c.jpg\n2,b.jpg\n1,birds/a.jpg\n")
    got = {r["image_id"]: r["dataset"] for r in files.read_lookup_csv(spark, str(tmp_path / "l.csv")).collect()}
    assert got == {"1": "birds", "2": "unknown"}
    data = spark.range(10).select(F.col("id").alias("ord"))
    files.write_shards(data, str(tmp_path / "shards"), 3)
    found = files.rows_by_file(spark, str(tmp_path / "shards"), "*.json").groupBy(F.element_at(F.split("file", "/"), -2).alias("shard")).agg(F.sum("rows"))
    assert rows(found) == [("shard=0", 4), ("shard=1", 3), ("shard=2", 3)]
    files.write_tsv(data, str(tmp_path / "t"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).count() == 10


def test_schemas_parse(spark):
    for s in (schemas.EXAMPLES, schemas.JUDGED, schemas.CHAINS, schemas.ALIASES, schemas.METRICS, schemas.ROLLOUTS):
        assert spark.createDataFrame([], s).count() == 0


def test_top_k_uses_a_group_limit(spark, nodes):
    texts = spark.createDataFrame([("cat",)], "text string")
    assert "WindowGroupLimit" in plan(match.top_k(texts, nodes, match.exact_hits(texts, nodes), 2))


def test_stream_resumes(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    schema = "data_id string, text string"
    mark = lambda df: df.withColumn("norm", normalize_match(F.col("text")))
    for name, ids in (("a", ["1", "2", "1"]), ("b", ["2", "3"])):
        (tmp_path / "in" / f"{name}.json").write_text("".join(json.dumps({"data_id": i, "text": "A-b"}) + "\n" for i in ids))
        query = resume.append_scored(resume.new_samples(spark, source, schema), mark, out, check)
        assert query.awaitTermination(120)
    got = spark.read.parquet(out)
    assert sorted(r["data_id"] for r in got.collect()) == ["1", "2", "3"]
    assert {r["norm"] for r in got.collect()} == {"a b"}


def test_discovery_prefers_and_reads_no_contents(spark, tmp_path):
    from evalgrove.sources import discovery

    for run, names in (("r1", ["r1_results_a.json", "common_results.json", "x_scored.jsonl"]), ("r2", ["r2_results_b.json", "r2_results_a.json", "r2_samples.jsonl", "r2_samples_shard1.jsonl"])):
        (tmp_path / run).mkdir()
        for name in names:
            (tmp_path / run / name).write_text("{broken")
    found = discovery.listing(spark, str(tmp_path / "r1"), str(tmp_path / "r2"))
    names = lambda df: sorted(r["name"] for r in df.collect())
    assert names(discovery.preferred(found, discovery.RESULTS, one=True)) == ["common_results.json", "r2_results_a.json"]
    assert names(discovery.matching(found, discovery.SAMPLES)) == ["r2_samples.jsonl", "r2_samples_shard1.jsonl"]
    assert names(discovery.matching(found, discovery.SCORED)) == ["x_scored.jsonl"]


def test_cache_asks_for_what_is_missing(spark, tmp_path):
    from evalgrove.sources import caches

    folder, asked = str(tmp_path / "c"), []

    def fetch(keys):
        asked.append(sorted(r["id"] for r in keys.collect()))
        return keys.where("id <> 'gone'").select("id", F.upper("id").alias("told"))

    ask = lambda *ids: sorted((r["id"], r["told"]) for r in caches.filled(spark.createDataFrame([(i,) for i in ids], "id string"), fetch, folder, "id string, told string", batch=2).collect())
    assert ask("a", "b", "a", None, "gone") == [("a", "A"), ("b", "B")]
    assert sorted(sum(asked, [])) == ["a", "b", "gone"] and len(asked) == 2
    asked.clear()
    assert ask("b", "c") == [("b", "B"), ("c", "C")] and asked == [["c"]]
    assert ask() == []


def test_vectors_are_kept_by_model_and_labels(spark, tmp_path):
    from evalgrove.sources import caches

    asked = []

    def encode(nodes):
        asked.append(1)
        return nodes.select("label", "ord", F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))

    one = spark.createDataFrame([("a", 0), ("b", 1)], "label string, ord int")
    for _ in range(2):
        assert caches.node_vectors(one, encode, str(tmp_path), "lab/m").count() == 2
    assert len(asked) == 1
    (kept,) = tmp_path.iterdir()
    (kept / "_SUCCESS").unlink()  # a write that broke off
    assert caches.node_vectors(one, encode, str(tmp_path), "lab/m").count() == 2 and len(asked) == 2
    caches.node_vectors(one.where("ord = 0"), encode, str(tmp_path), "lab/m")
    caches.node_vectors(one, encode, str(tmp_path), "lab/n")
    assert len(asked) == 4 and len(list(tmp_path.iterdir())) == 3


def test_leaves_named_by_samples(spark):
    from evalgrove.plans import pipelines

    chains = spark.createDataFrame([("1", ["cat", "animal"]), ("2", ["dog", "animal"]), ("3", [])], "id string, taxonomy array<string>")
    examples = spark.createDataFrame([("1", "kitty", None, 0), ("1", "mog", "moggy", 1), ("3", "x", None, 2), (None, "y", None, 3)], "entity_id string, answer string, original_answer string, ord int")
    akas = spark.createDataFrame([("1", "animal"), ("1", "feline"), ("2", "hound"), ("9", "z")], "id string, alias string")
    names = taxonomy.sample_names(examples)
    index = pipelines.taxonomy_index(chains, names=names, akas=akas)
    assert sorted(r["label"] for r in index["nodes"].collect()) == ["animal", "dog", "moggy"]
    assert sorted(r["path"][0] for r in index["entities"].collect()) == ["cat", "dog"]
    assert sorted((r["alias"], r["label"]) for r in index["aliases"].collect()) == [("feline", "moggy"), ("hound", "dog")]
    renamed = pipelines.taxonomy_index(chains, names=names, rename_entities=True)
    assert sorted(r["path"][0] for r in renamed["entities"].collect()) == ["dog", "moggy"]
