"""Whole runs over small tables and the command line."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from evalgrove import cli
from evalgrove.operators import judge
from evalgrove.plans import pipelines
from evalgrove.sources import files, schemas

CHAINS = [("Q1", ["poodle", "dog", "animal"]), ("Q2", ["tabby cat", "cat", "animal"])]
SAMPLES = [
    {"data_id": "1", "entity_id": "Q1", "question": "what?", "answer": "A: poodle", "all_texts": ["A: Dog.", "poodle", "cat"], "prediction": "A: Dog."},
    {"data_id": "2", "entity_id": "Q2", "question": "what?", "answer": "tabby cat", "all_texts": ["nothing", "a cat maybe", ""], "prediction": "nothing"},
]


@pytest.fixture(scope="module")
def index(spark):
    return pipelines.taxonomy_index(spark.createDataFrame(CHAINS, schemas.CHAINS))


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([json.dumps(s) for s in SAMPLES], "string").select(F.from_json("value", schemas.SAMPLES).alias("x")).select("x.*")


def answering(prompts):
    """A judge that says yes to answers that name a dog or cat."""
    yes = F.regexp_like("prompt", F.lit('(?i)Response: "[^"]*(dog|cat)[^"]*"'))
    return prompts.select("prompt", F.lit(0).alias("completion"), F.when(yes, "<answer>1</answer>").otherwise("<answer>0</answer>").alias("reply"))


def test_judge_then_score(spark, samples, index):
    judged = pipelines.judge_rows(samples, answering)
    got = {r["data_id"]: r for r in judged.collect()}
    assert got["1"]["judge_verdicts"] == [True, False, True] and got["1"]["judge_selected"] == 0 and got["1"]["judge_hit_count"] == 2
    assert got["2"]["judge_verdicts"] == [False, True, False] and got["2"]["judge_selected_text"] == "a cat maybe"
    scored = pipelines.score_rows(judged, index, ("exact_match", "contained", "cascade"))
    got = {r["data_id"]: r for r in scored.collect()}
    assert got["1"]["exact_match_predicted_node"] == "dog" and got["1"]["exact_match_hP"] == 1.0 and not got["1"]["exact_match_exact_match"]
    assert got["2"]["exact_match_predicted_node"] is None and got["2"]["contained_predicted_node"] == "cat"
    assert got["1"]["cascade_predicted_node"] == "poodle" and got["1"]["cascade_exact_match"]
    assert got["2"]["scored_reference_path"] == ["tabby cat", "cat", "animal", "root"]
    metrics = {(r["measure"], r["metric"]): r["value"] for r in pipelines.run_results(scored, "r").collect()}
    assert metrics["exact_match", "num_mapped"] == 1 and metrics["exact_match", "num_examples"] == 2
    assert metrics["judge", "pass@3"] == 1.0 and metrics["judge", "num_judge_rollouts"] == 6


def test_structured_judge(samples):
    reply = lambda p: p.select("prompt", F.lit(0).alias("completion"), F.lit('{"verdict": "yes", "reason": "same"}').alias("reply"))
    got = pipelines.judge_rows(samples, reply, structured=True).head()
    assert got["judge_reasons"] == ["same"] * 3 and got["judge_hit_count_majority"] == 3


def test_replayed_completions(spark, samples):
    asked = []
    source = lambda p: (asked.append(1), answering(p))[1]
    table = answering(spark.createDataFrame([("p",)], "prompt string"))
    assert judge.replay(table)(spark.createDataFrame([("p",), ("q",)], "prompt string")).count() == 1
    assert pipelines.judge_rows(samples.where("data_id = '1'"), source).count() == 1 and asked == [1]


def test_repair(spark, tmp_path):
    lines = ['{"data_id": "1", "all_texts": ["a"]}', '{"data_id": "1", "all_texts": ["a", "b"]}', "{broken", '{"data_id": "9", "all_texts": ["a", "b"]}', '{"data_id": "2", "all_texts": ["a", "b"]}', '{"data_id": "2", "all_texts": ["c", "d"]}']
    (tmp_path / "s.jsonl").write_text("\n".join(lines) + "\n")
    (tmp_path / "e.jsonl").write_text("".join(json.dumps({"data_id": i}) + "\n" for i in "123"))
    cli.main(["repair", str(tmp_path / "s.jsonl"), "--examples", str(tmp_path / "e.jsonl"), "--out", str(tmp_path / "out"), "--expected", "2", "--shards", "2", "--apply"], spark)
    (told,) = spark.read.text(str(tmp_path / "out/manifest")).collect()
    told = json.loads(told["value"])
    assert told["stats"] == {"malformed": 1, "incomplete": 1, "unknown_id": 1, "duplicate": 1, "kept": 2}
    assert told["shards"] == [{"shard": 0, "expected": 2, "completed": 1, "remaining": 1}, {"shard": 1, "expected": 1, "completed": 1, "remaining": 0}]
    assert spark.read.json(str(tmp_path / "out/shards")).count() == 2


def test_command_line(spark, tmp_path):
    judged = [s | {"judge_verdicts": [True, True, False]} for s in SAMPLES]
    (tmp_path / "j.jsonl").write_text("".join(json.dumps(s) + "\n" for s in [*judged, judged[0]]))
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": i, "taxonomy": t}) + "\n" for i, t in CHAINS))
    (tmp_path / "a.jsonl").write_text(json.dumps({"id": "Q2", "aka": {"en": [{"value": "nothing"}]}}) + "\n")
    (tmp_path / "p.csv").write_text("image_id,path\ni1,birds/x.jpg\n")
    (tmp_path / "x.jsonl").write_text(json.dumps({"data_id": "1", "image_id": "i1", "entity_id": "Q1", "entity_text": "poodle", "question": "what is this dog?"}) + "\n")
    at = lambda name: str(tmp_path / name)
    cli.main(["dedup", at("j.jsonl"), "--out", at("d")], spark)
    assert files.read_jsonl(spark, at("d"), schemas.SAMPLES).count() == 2
    cli.main(["score", at("j.jsonl"), "--chains", at("c.jsonl"), "--out", at("s"), "--results", at("r"), "--max-examples", "2", "--measure", "all"], spark)
    results = json.loads(spark.read.text(at("r")).head()["value"])
    assert {m["measure"] for m in results["measures"]} == {"contained", "exact_match", "judge"}
    cli.main(["audit", at("j.jsonl"), "--aliases", at("a.jsonl"), "--chains", at("c.jsonl"), "--out", at("t")], spark)
    told = spark.read.option("sep", "\t").option("header", True).csv(at("t")).head()
    assert told["alias"] == "1" and told["rows"] == "3" and told["run"] == "j"
    (tmp_path / "runs" / "lab-m-instruct").mkdir(parents=True)
    for name in ("a_scored.jsonl", "b_scored.jsonl", "b_judged.jsonl"):
        (tmp_path / "runs" / "lab-m-instruct" / name).write_text((tmp_path / "j.jsonl").read_text())
    cli.main(["audit", at("runs"), "--out", at("t2"), "--lead", "lab-", "--tail=-instruct"], spark)
    (told,) = spark.read.option("sep", "\t").option("header", True).csv(at("t2")).collect()
    assert told["run"] == "M" and told["rows"] == "6"
    cli.main(["audit", at("runs"), "--details"], spark)
    cli.main(["prepare", at("x.jsonl"), "--paths", at("p.csv"), "--out", at("e")], spark)
    assert files.read_jsonl(spark, at("e"), schemas.EXAMPLES).head()["dataset"] == "birds"
    cli.main(["questions", at("x.jsonl"), "--chains", at("c.jsonl"), "--out", at("q")], spark)
    assert spark.read.json(at("q")).head()["question"] == "what is this dog?"
    with pytest.raises(SystemExit):
        cli.main(["score", at("j.jsonl"), "--chains", at("c.jsonl"), "--out", at("s"), "--results", at("r"), "--measure", "nope"], spark)


def test_commands_that_ask_a_model(spark, tmp_path, monkeypatch):
    rows = [{"data_id": str(i), "question": f"what is {i}?", "answer": "dog", "entity_text": "dog"} for i in range(3)]
    (tmp_path / "x.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    at = lambda name: str(tmp_path / name)
    (tmp_path / "judge_client.py").write_text("def reply_to(prompts, n):\n    return [['<answer>1</answer>'] * n for _ in prompts]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    client = ["--client", "judge_client:reply_to"]
    cli.main(["infer", at("x.jsonl"), "--out", at("i"), "--n", "4", *client], spark)
    sampled = files.read_jsonl(spark, at("i"), schemas.SAMPLES).collect()
    assert len(sampled) == 3 and all(len(r["all_texts"]) == 4 and r["prediction"] == r["all_texts"][0] for r in sampled)
    with pytest.raises(SystemExit):
        cli.main(["infer", at("x.jsonl"), "--out", at("i"), *client], spark)
    cli.main(["infer", at("x.jsonl"), "--out", at("i"), "--resume", *client], spark)
    assert files.read_jsonl(spark, at("i"), schemas.SAMPLES).count() == 3
    cli.main(["rsa", at("i"), "--out", at("p"), "--population", "3", "--k", "2", "--steps", "2", *client], spark)
    assert [len(r["all_texts"]) for r in files.read_jsonl(spark, at("p"), schemas.SAMPLES).collect()] == [3, 3, 3]
    for wrong in (["--k", "9", "--population", "3"], ["--steps", "0"]):
        with pytest.raises(SystemExit):
            cli.main(["rsa", at("i"), "--out", at("p2"), *wrong, *client], spark)
    cli.main(["judge", at("i"), "--out", at("j"), "--votes", "3", *client], spark)
    judged = files.read_jsonl(spark, at("j"), schemas.JUDGED).collect()
    assert len(judged) == 3 and all(len(r["judge_verdicts"]) == 4 and r["judge_hit"] for r in judged)


def test_catalog_and_index_commands(spark, tmp_path, capsys):
    logs = tmp_path / "logs"
    for name, dataset, extra in (("20250101_000000_000001", "aligned.jsonl", ["m_samples.jsonl", "m_scored.jsonl"]), ("20250102_000000_000001", "plain.jsonl", ["m_samples_shard0.jsonl"]), ("20250103_000000_000001", "aligned.jsonl", [])):
        run = logs / "sub" / name
        run.mkdir(parents=True)
        (run / "m_metadata.json").write_text(json.dumps({"model": "Lab/M-8B", "prompt_variant": "concise", "data": {"input": dataset, "no_image": False, "num_examples": 5}, "sharding": {"num_shards": 2}}, indent=1))
        for f in extra:
            (run / f).write_text('{"a": 1}\n{"a": 2}\n')
    cli.main(["catalog", str(logs), "--out", str(tmp_path / "runs")], spark)
    told = {r["run_dir"]: r for r in spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "runs")).collect()}
    assert [(k[:22], r["status"], r["dataset"], r["model"], r["total_examples"]) for k, r in sorted(told.items())] == [
        ("logs/sub/20250101_0000", "complete", "aligned", "8b", "2"), ("logs/sub/20250102_0000", "samples", "original", "8b", "2"), ("logs/sub/20250103_0000", "empty", "aligned", "8b", "10"),
    ]
    capsys.readouterr()
    cli.main(["latest", str(tmp_path / "runs"), "--model", "8b", "--dataset", "original"], spark)
    assert capsys.readouterr().out.strip().endswith("20250102_000000_000001")
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": i, "taxonomy": t}) + "\n" for i, t in CHAINS))
    judged = [s | {"judge_verdicts": [True, True, False]} for s in SAMPLES]
    (tmp_path / "j.jsonl").write_text("".join(json.dumps(s) + "\n" for s in judged))
    at = lambda name: str(tmp_path / name)
    cli.main(["index", at("c.jsonl"), "--out", at("x")], spark)
    for given, name in ((["--chains", at("c.jsonl")], "s1"), (["--index", at("x")], "s2")):
        cli.main(["score", at("j.jsonl"), *given, "--out", at(name), "--results", at(name + "r")], spark)
    one, two = (json.loads(spark.read.text(at(n)).head()["value"]) for n in ("s1r", "s2r"))
    assert one == two
    cli.main(["aggregate", at("s1"), "--results", at("again")], spark)
    assert json.loads(spark.read.text(at("again")).head()["value"]) == one


def test_cascade_by_an_encoder(spark, index, tmp_path, monkeypatch):
    (tmp_path / "letters_client.py").write_text("def vectors(texts):\n    return [[t.lower().count(c) for c in 'abcdefghijklmnopqrstuvwxyz'] for t in texts]\n")
    monkeypatch.syspath_prepend(str(tmp_path))
    rows = [{"data_id": str(i), "entity_id": "Q1", "answer": "poodle", "all_texts": [t]} for i, t in enumerate(("poodels", "777", "Poodle", "a dog?"))]
    (tmp_path / "j.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": i, "taxonomy": t}) + "\n" for i, t in CHAINS))
    at = lambda name: str(tmp_path / name)
    asked = ["score", at("j.jsonl"), "--chains", at("c.jsonl"), "--out", at("s"), "--results", at("r"), "--measure", "cascade", "--encoder", "letters_client:vectors"]
    with pytest.raises(SystemExit):
        cli.main(asked, spark)
    cli.main([*asked, "--vectors", at("v"), "--model", "lab/letters"], spark)
    got = {r["data_id"]: (r["cascade_predicted_node"], r["cascade_mapping_method"]) for r in spark.read.json(at("s")).select("data_id", "cascade_mapping_method", "cascade_predicted_node").collect()}
    assert got == {"0": ("poodle", "top_score"), "1": (None, "none"), "2": ("poodle", "exact_match_in_top_k"), "3": ("dog", "ngram_topk_match_1")}
    assert [p.name.startswith("letters_") for p in (tmp_path / "v").iterdir()] == [True]
