"""Runs that break off and go on, the files they leave, and what reads them back."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from urllib.parse import parse_qs, urlparse

import pytest
from evalgrove import cli
from evalgrove.operators import images, judge, layout, ordinals, taxonomy
from evalgrove.plans import pipelines
from evalgrove.sources import descriptions, discovery, files, publish, replies, schemas, staging
from evalgrove.streaming import resume
from pyspark.sql import functions as F


def echo(prompts):
    return prompts.select("prompt", F.lit(0).alias("completion"), F.concat(F.lit("to "), "prompt").alias("reply"))


class Breaking:
    """Answers so many chunks, then fails; counts what it is asked."""

    def __init__(self, chunks):
        self.left, self.asked = chunks, []

    def __call__(self, prompts):
        if not self.left:
            raise ConnectionError
        self.left -= 1
        self.asked += [r[0] for r in prompts.collect()]
        return echo(prompts)


def test_replies_are_kept_by_chunk(spark, tmp_path):
    prompts = spark.range(100).select(F.concat(F.lit("p"), "id").alias("prompt"))
    log = replies.ReplyLog(spark, str(tmp_path / "log"), "model a")
    first, second = Breaking(4), Breaking(100)
    with pytest.raises(ConnectionError):
        replies.Logged(first, log, 10)(prompts)
    assert len(log.commits()) == 4 and log.replies().count() == len(first.asked) == sum(c["prompts"] for c in log.commits())
    got = replies.Logged(second, log, 10)(prompts)
    assert {r["prompt"]: r["reply"] for r in got.collect()} == {f"p{i}": f"to p{i}" for i in range(100)}
    assert sorted(first.asked + second.asked) == sorted(f"p{i}" for i in range(100))
    third = Breaking(0)
    assert replies.Logged(third, log, 10)(prompts.limit(7).unionByName(prompts.limit(7))).count() == 7
    assert replies.ReplyLog(spark, str(tmp_path / "log"), "model b").replies().count() == 0


def test_a_chunk_without_its_commit_is_asked_again(spark, tmp_path, monkeypatch):
    prompts = spark.range(30).select(F.concat(F.lit("p"), "id").alias("prompt"))
    log = replies.ReplyLog(spark, str(tmp_path / "log"))
    write, calls = files.write_text, []

    def killed(*a):
        calls.append(a)
        if len(calls) == 2:
            raise KeyboardInterrupt
        write(*a)

    monkeypatch.setattr(files, "write_text", killed)
    with pytest.raises(KeyboardInterrupt):
        replies.Logged(echo, log, 10)(prompts)
    monkeypatch.setattr(files, "write_text", write)
    known = {r[0] for r in log.replies().select("prompt").collect()}
    rest = Breaking(9)
    got = replies.Logged(rest, log, 10)(prompts)
    assert 0 < len(known) < 30 and set(rest.asked) == {f"p{i}" for i in range(30)} - known and got.count() == 30


def test_rounds_are_asked_anew(spark, tmp_path):
    examples = spark.createDataFrame([("1", "what?")], "example_id string, question string")
    source = Breaking(9)
    for _ in range(2):
        got = judge.iterate(examples, replies.logged(source, spark, str(tmp_path / "log")), rounds=3)
        assert got.count() == 3 and len(source.asked) == 3


def test_feedback_keeps_all_rounds(spark):
    seen = []

    def source(prompts):
        seen.extend(r[0] for r in prompts.collect())
        return echo(prompts.select(F.lit("x").alias("x"), "prompt")).withColumn("reply", F.lit("a long answer"))

    examples = spark.createDataFrame([("1", "what?")], "example_id string, question string")
    judge.iterate(examples, source, rounds=3, feedback=True, max_chars=6).count()
    assert len(seen) == 3 and "round 1" in seen[1] and "round 1" in seen[2] and "round 2" in seen[2] and seen[2].startswith(seen[1]) and "a long\n...(truncated)" in seen[1]


CLIENT = """
def reply_to(prompts, n, settings):
    return [[f"A: dog {settings['temperature']} {i}" for i in range(n)] for _ in prompts]

def judge_of(prompts, n):
    return [['<answer>1</answer>' if 'description evidence' in p or 'poodle' in p else '<answer>0</answer>'] * n for p in prompts]

def json_of(prompts, n):
    return [['{"verdict": "yes", "reason": "same"}' if "7" in p else "what"] * n for p in prompts]
"""


def test_a_run_from_end_to_end(spark, tmp_path, monkeypatch, capsys):
    """Inference in shards, judging with evidence, scores, results, catalog and audit, all from what the library wrote."""
    rows = [{"data_id": str(i), "question": f"what is {i}?", "answer": "poodle" if i % 2 else "tabby cat", "entity_id": "Q1" if i % 2 else "Q2"} for i in range(7)]
    (tmp_path / "x.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": i, "taxonomy": t}) + "\n" for i, t in (("Q1", ["poodle", "dog"]), ("Q2", ["tabby cat", "cat"]))))
    (tmp_path / "d.jsonl").write_text(json.dumps({"id": "Q2", "taxonomy": ["a striped cat", ""]}) + "\n")
    (tmp_path / "runs_client.py").write_text(CLIENT)
    monkeypatch.syspath_prepend(str(tmp_path))
    run = tmp_path / "logs" / "m" / "20250101_000000_000001"
    at = lambda name: str(run / name)
    for shard in "01":
        cli.main(["infer", str(tmp_path / "x.jsonl"), "--out", at("m_samples.jsonl"), "--n", "2", "--rounds", "2", "--feedback", "--client", "runs_client:reply_to", "--model", "Lab/M-8B", "--temperature", "0.5", "--shard", shard, "--num-shards", "2"], spark)
    told = json.loads((run / "m_shard0_metadata.json").read_text())
    assert told["method"] == "iterative" and told["iterative"]["attempts_per_round"] == 2 and told["sharding"] == {"shard": 0, "num_shards": 2} and told["data"]["num_examples"] == 4
    samples = files.read_jsonl(spark, [at("m_samples_shard0.jsonl"), at("m_samples_shard1.jsonl")], schemas.SAMPLES).collect()
    assert sorted(r["data_id"] for r in samples) == [str(i) for i in range(7)]
    assert all([(x["round"], x["attempt"]) for x in r["attempts"]] == [(1, 1), (1, 2), (2, 1), (2, 2)] and r["total_attempts"] == 4 and r["all_texts"][0] == "A: dog 0.5 0" and r["sampling"].startswith("temp=0.5") for r in samples)
    files.write_jsonl(files.read_jsonl(spark, [at("m_samples_shard0.jsonl"), at("m_samples_shard1.jsonl")], schemas.SAMPLES), at("m_samples.jsonl"))
    cli.main(["catalog", str(tmp_path / "logs")], spark)
    assert "samples" in capsys.readouterr().out
    cli.main(["judge", at("m_samples.jsonl"), "--out", at("m_judged.jsonl"), "--client", "runs_client:judge_of", "--model", "Lab/J-3B", "--votes", "3", "--chains", str(tmp_path / "c.jsonl"), "--descriptions", str(tmp_path / "d.jsonl")], spark)
    judged = files.read_jsonl(spark, at("m_judged.jsonl"), schemas.JUDGED).collect()
    assert len(judged) == 7 and all(r["judge_hit"] for r in judged), "poodles by their name, cats by the evidence"
    assert json.loads((run / "m_judged_metadata.json").read_text())["num_examples"] == 7
    cli.main(["score", at("m_judged.jsonl"), "--chains", str(tmp_path / "c.jsonl"), "--out", at("m_scored.jsonl"), "--results", at("m_results.json"), "--run", "r"], spark)
    one = json.loads((run / "m_results.json").read_text())
    assert (one["judge_model"], one["judge_mode"]) == ("Lab/J-3B", "free-form")
    monkeypatch.setenv("EVALGROVE_DATA", str(run))
    cli.main(["aggregate", "m_scored.jsonl", "--results", at("again_results.json"), "--run", "r"], spark)
    assert json.loads((run / "again_results.json").read_text()) == one
    cli.main(["catalog", str(tmp_path / "logs"), "--out", str(tmp_path / "runs")], spark)
    (row,) = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "runs")).collect()
    assert (row["run_dir"], row["status"], row["total_examples"], row["model"], row["judge_model"]) == ("logs/m/20250101_000000_000001", "complete", "7", "8b", "3b")
    cli.main(["audit", str(tmp_path / "logs"), "--out", str(tmp_path / "t")], spark)
    (row,) = spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "t")).collect()
    assert row["rows"] == "7" and row["run"] == "m_scored"
    assert {r["name"] for r in discovery.listing(spark, str(run)).collect()} >= {"m_samples.jsonl", "m_samples_shard0.jsonl", "m_judged.jsonl", "m_scored.jsonl", "m_results.json"}


def test_judging_goes_on_after_a_break(spark, tmp_path, monkeypatch):
    rows = [{"data_id": str(i) if i else None, "question": f"what is {i}?", "answer": "dog", "all_texts": [f"t{i}"] if i != 3 else []} for i in range(9)]
    (tmp_path / "s.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "asked.txt").write_text("")
    (tmp_path / "frail_client.py").write_text(
        f"def reply_to(prompts, n):\n    lines = open({str(tmp_path / 'asked.txt')!r}).read().splitlines()\n    if len(lines) > 3 and not open({str(tmp_path / 'up.txt')!r}, 'a').tell():\n        raise OSError('down')\n"
        f"    open({str(tmp_path / 'asked.txt')!r}, 'a').write(''.join(repr(p) + chr(10) for p in prompts))\n    return [['<answer>1</answer>'] for _ in prompts]\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    ask = ["judge", str(tmp_path / "s.jsonl"), "--out", str(tmp_path / "j.jsonl"), "--client", "frail_client:reply_to", "--chunk", "1"]
    with pytest.raises(Exception, match="down"):
        cli.main(ask, spark)
    before = len((tmp_path / "asked.txt").read_text().splitlines())
    (tmp_path / "up.txt").write_text("x")
    cli.main([*ask, "--resume"], spark)
    asked = (tmp_path / "asked.txt").read_text().splitlines()
    assert 0 < before < 8 and len(set(asked)) == 8 and len(asked) - 8 <= 2, "twice at most what its broken chunk had asked"
    got = files.read_jsonl(spark, str(tmp_path / "j.jsonl"), schemas.JUDGED).collect()
    assert len(got) == 9 and not (tmp_path / "j.jsonl_replies").exists()
    (empty,) = [r for r in got if r["data_id"] == "3"]
    assert empty["judge_verdicts"] == [] and empty["judge_hit"] is False and empty["judge_selected"] == -1 and empty["judge_selected_text"] == ""
    cli.main([*ask, "--resume"], spark)
    assert files.read_jsonl(spark, str(tmp_path / "j.jsonl"), schemas.JUDGED).count() == 9, "the row without an id is not judged again"


def test_structured_judging_counts_what_it_cannot_parse(spark, tmp_path, monkeypatch):
    (tmp_path / "s.jsonl").write_text("".join(json.dumps({"data_id": str(i), "question": "q", "answer": "a", "all_texts": [f"t{i}"]}) + "\n" for i in (7, 8)))
    (tmp_path / "runs2_client.py").write_text(CLIENT)
    monkeypatch.syspath_prepend(str(tmp_path))
    cli.main(["judge", str(tmp_path / "s.jsonl"), "--out", str(tmp_path / "j.jsonl"), "--client", "runs2_client:json_of", "--structured"], spark)
    told = json.loads((tmp_path / "j_metadata.json").read_text())
    assert told["judge_mode"] == "structured" and told["parse_errors"] == 1 and told["num_examples"] == 2
    with pytest.raises(SystemExit):
        cli.main(["judge", str(tmp_path / "s.jsonl"), "--out", str(tmp_path / "k.jsonl"), "--client", "runs2_client:json_of", "--structured", "--descriptions", "x", "--chains", "y"], spark)


def test_results_of_a_run_without_a_mapped_answer(spark, tmp_path):
    rows = [{"data_id": str(i), "answer": "poodle", "entity_id": "Q1", "prediction": "nothing of the kind"} for i in range(3)]
    (tmp_path / "j.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    (tmp_path / "c.jsonl").write_text(json.dumps({"id": "Q1", "taxonomy": ["poodle", "dog"]}) + "\n")
    at = lambda name: str(tmp_path / name)
    cli.main(["score", at("j.jsonl"), "--chains", at("c.jsonl"), "--out", at("s.jsonl"), "--results", at("r.json")], spark)
    cli.main(["aggregate", at("s.jsonl"), "--results", at("r2.json")], spark)
    one, two = (json.loads((tmp_path / n).read_text()) for n in ("r.json", "r2.json"))
    assert one == two and one["num_mapped"] == 0 and one["num_examples"] == 3
    (tmp_path / "e.jsonl").write_text("{}\n")
    with pytest.raises(ValueError, match="no scores"):
        pipelines.read_scored(spark, at("e.jsonl"))


@pytest.mark.parametrize("step", range(1, 6))
def test_a_folder_is_replaced_as_a_whole(spark, tmp_path, monkeypatch, step):
    """Killed before its first, second, ... move, a publication leaves the old rows or the new ones, and can be finished."""
    live = str(tmp_path / "shards")
    rows = lambda n: spark.range(n).coalesce(1)
    read = lambda: spark.read.parquet(publish.current(spark, live)).count()
    assert publish.publish(spark, live, lambda path: rows(3).write.parquet(path)) is None and read() == 3
    calls = []

    def frail(f):
        def run(*a):
            calls.append(a)
            if len(calls) == step:
                raise KeyboardInterrupt
            return f(*a)

        return run

    with monkeypatch.context() as m:
        for name in ("rename", "write_text", "delete"):
            m.setattr(publish.files, name, frail(getattr(files, name)))
        with pytest.raises(KeyboardInterrupt):
            publish.publish(spark, live, lambda path: rows(5).write.parquet(path), lambda backup: (str(tmp_path / "note"), f"old rows in {backup}"))
    before = read()
    started = publish.finish(spark, live)
    # the second move puts the journal in its place, from then on the new rows count
    assert started == (step > 2) and before == read() == (5 if started else 3)
    if started:
        assert "old rows in" in (tmp_path / "note").read_text() and not publish.finish(spark, live)
        assert [spark.read.parquet(str(p)).count() for p in tmp_path.glob("shards.backup-*")] == [3]


def test_a_stream_without_state(spark, tmp_path):
    """Ids pass once over many batches, and the stream keeps no state of them."""
    source, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    (tmp_path / "in").mkdir()
    for i in range(6):
        ids = [str(i), str(i), "always", None, ""]
        (tmp_path / "in" / f"f{i}.json").write_text("".join(json.dumps({"data_id": x, "n": i}) + "\n" for x in ids))
    stream = resume.new_samples(spark, source, "data_id string, n int", files_per_batch=1)
    resume.append_scored(stream, lambda b: b.withColumn("m", F.col("n") * 2), out, check).awaitTermination()
    got = [r["data_id"] for r in spark.read.parquet(out).collect()]
    assert sorted(x for x in got if x) == sorted([*map(str, range(6)), "always"]) and sum(not x for x in got) == 12
    assert not (tmp_path / "check" / "state").exists()


def test_ordinals(spark):
    rows = spark.range(1000).select(F.concat(F.lit("n"), (F.col("id") * 7919) % 1000).alias("label"))
    got = [r["label"] for r in ordinals.numbered(rows.repartition(7), "place", ["label"]).orderBy("place").collect()]
    assert got == sorted(got) and len(got) == 1000
    as_read = ordinals.numbered(spark.range(100, numPartitions=7)).collect()
    assert all(r["id"] == r["ord"] for r in as_read) and ordinals.numbered(spark.range(0), "o", ["id"]).collect() == []
    placed = taxonomy.with_ordinals(rows.select("label", F.array("label", F.lit("root")).alias("path"), F.lit(2).alias("depth")))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and placed.where("ord = 999").count() == 1  # ordered and written before


def test_layout(spark):
    chains = [["a", "x", "root"], ["b", "x", "root"], ["c", "y", "root"], ["y", "root"], ["d", "c", "y", "root"], ["b", "z", "root"]]
    got = {r["node"]: r for r in layout.chain_layout(spark.createDataFrame([(c,) for c in chains], "path array<string>"), 300, 90).collect()}
    # leaves in order: a, b (under x, the least path), d, z
    assert [got[n]["x"] for n in ("a", "b", "d", "z")] == [50, 125, 200, 275]
    assert got["x"]["x"] == 87 and got["y"]["x"] == got["c"]["x"] == 200 and got["root"]["x"] == (87 + 200 + 275) // 3
    assert [got[n]["y"] for n in ("root", "x", "a", "d")] == [0, 30, 60, 90] and got["root"]["leaves"] == 4 and got["b"]["parent"] == "x"
    none = spark.createDataFrame([], "path array<string>")
    assert layout.chain_layout(none).collect() == []


def test_images(spark, tmp_path):
    for name in ("a.png", "b.JPEG", "b.jpg", "sub.x/c.JPG", "d.jpeg"):
        (tmp_path / "img" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "img" / name).write_text("x")
    root = str(tmp_path / "img")
    paths = ["a.png", "b.png", "b.jpg", "sub.x/c", "/nowhere/a.png", f"{root}/d.png", "", None, "a.png", ".hidden"]
    rows = spark.createDataFrame(list(enumerate(paths)), "n int, image_path string")
    found = images.resolve(rows, images.image_files(spark, root), root)
    assert found.columns == ["n", "image_path", "image_file"]
    got = [r["image_file"] and r["image_file"].removeprefix(root) for r in found.orderBy("n").collect()]
    assert got == ["/a.png", "/b.JPEG", "/b.jpg", "/sub.x/c.JPG", None, "/d.jpeg", None, None, "/a.png", None]
    assert tuple(images.missing_images(found).head()) == (10, 2, 2)
    (tmp_path / "x.jsonl").write_text("".join(json.dumps({"data_id": str(i), "image_path": p}) + "\n" for i, p in enumerate(("a.png", "zz.png"))))
    ask = ["images", str(tmp_path / "x.jsonl"), "--root", root, "--out", str(tmp_path / "o")]
    with pytest.raises(SystemExit):
        cli.main(ask, spark)
    cli.main([*ask, "--allow-missing"], spark)
    assert spark.read.json(str(tmp_path / "o")).where("image_file IS NOT NULL").count() == 1


@pytest.fixture()
def endpoint():
    """A local stand-in for a SPARQL endpoint, which turns away each request once."""
    seen: list[tuple[str, str]] = []

    class Handler(BaseHTTPRequestHandler):
        def do_GET(self):
            query = parse_qs(urlparse(self.path).query)["query"][0]
            first = query not in {q for q, _ in seen}
            seen.append((query, "busy" if first else "ok"))
            if first:
                self.send_response(429)
                self.send_header("Retry-After", "0")
                self.end_headers()
                return
            ids = [w.removeprefix("wd:") for w in query.split() if w.startswith("wd:")]
            value = lambda x: {"value": x}
            rows = []
            for i in ids:
                root = value(f"http://x/entity/{i}")
                if "classLabel" not in query:
                    rows += [{"root": root, "classDescription": value(f"{i} itself")}]
                elif i != "Q3":
                    rows += [{"root": root, "classLabel": value("dog"), "classDescription": value(f"pet {k}")} for k in (1, 2)] + [{"root": root, "classLabel": value("bare")}]
            body = json.dumps({"results": {"bindings": rows}}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/sparql", seen
    server.shutdown()


def test_descriptions(spark, tmp_path, endpoint):
    url, seen = endpoint
    chains = [("Q1", ["poodle", "dog", "bare"]), ("Q2", ["dog", "animal"]), ("Q3", ["cat"]), ("Q4", [])]
    labels = spark.createDataFrame(chains, schemas.CHAINS)
    for _ in range(2):
        got = {r["id"]: r["taxonomy"] for r in descriptions.described_chains(labels, url, str(tmp_path / "cache"), batch=2).collect()}
        assert got == {"Q1": ["Q1 itself", "pet 1", ""], "Q2": ["pet 1", ""], "Q3": ["Q3 itself"], "Q4": []}
    served = [q for q, how in seen if how == "ok"]
    assert len(served) == len(set(served)) and sum("Q1" in q for q in served) == 2, "nothing is asked for twice"
    (tmp_path / "c.jsonl").write_text("".join(json.dumps({"id": i, "taxonomy": t}) + "\n" for i, t in chains))
    cli.main(["describe", str(tmp_path / "c.jsonl"), "--endpoint", url, "--cache", str(tmp_path / "cache"), "--out", str(tmp_path / "d")], spark)
    assert files.read_jsonl(spark, str(tmp_path / "d"), schemas.CHAINS).count() == 4


def test_descriptions_fail_after_retries(spark):
    reader = spark.read.format("entity_descriptions").options(endpoint="http://127.0.0.1:9/none", ids="Q1", retries="1", wait="0")
    spark.dataSource.register(descriptions.EntityDescriptions)
    with pytest.raises(Exception, match="refused|URLError"):
        reader.load().collect()


def test_staged_tables_go(spark, tmp_path):
    path = staging.scratch_path(spark, "test")
    spark.range(3).write.parquet(path)
    assert files.exists(spark, path)
    staging.clear()
    assert not files.exists(spark, path)
