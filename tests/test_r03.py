"""Findings of the third round: results that differed from SQL, and work that grew faster than its input."""

from __future__ import annotations

import duckdb
import numpy as np
from pyspark.sql import functions as F

from evalgrove.functions import prompts as P
from evalgrove.operators import judge as J
from evalgrove.plans import catalog
from evalgrove.plans.registry import Tables


def test_near_ties_of_cosines_go_by_score(spark, tmp_path):
    """Three others whose scores lie within the gate of the vote: the first counts, as in the SQL."""
    base = np.zeros(4)
    base[0] = 1
    vectors = [(100, base)]
    for i, turn in enumerate((0.5, 0.501, 0.502), 1):
        v = np.zeros(4)
        v[0], v[i] = np.cos(turn), np.sin(turn)
        vectors.append((i, v))
    path = str(tmp_path / "embeddings.parquet")
    spark.createDataFrame([(i, v.tolist(), i) for i, v in vectors], "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(path)
    got = [tuple(r) for r in catalog.QUERIES["cascade_embedding"](spark, str(tmp_path)).collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/*.parquet'")
    assert got == con.execute(catalog.ORACLE_SQL["cascade_embedding"]).fetchall() == [("vector 100", "node1", "top_score")]


def test_lines_are_numbered_without_names_and_paths(spark, small):
    """The rows that order_geo sorts hold keys of nations only."""
    plan = Tables(spark, small).order_geo._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("row_number()") :].splitlines()
    window = next(line for line in plan.splitlines() if "row_number()" in line and "Window" in line)
    at = next(i for i, line in enumerate(below) if "Window" in line or "row_number()" in line)
    assert "l_orderkey" in window and "path" not in below[at + 1] and "n_name" not in below[at + 1]


def _exchanges(df):
    """Columns of the rows that each exchange of a plan takes."""
    found = []

    def walk(node):
        if "Exchange" in node.nodeName():
            found.append(node.child().output().mkString(","))
        node = node.executedPlan() if node.nodeName() == "AdaptiveSparkPlan" else node
        children = node.children()
        for i in range(children.size()):
            walk(children.apply(i))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_prompts_made_of_columns_are_asked_once_and_not_shuffled(spark):
    """a prompt that several rows make is asked once, one that is null gets no reply, and exchanges take digests and parts."""
    rows = spark.createDataFrame([(1, "a", "b"), (2, "ab", ""), (3, "a", "b"), (4, None, "b"), (5, None, "b"), (6, "c", "d")], "key int, x string, y string")
    asked = []

    def source(prompts):
        asked.extend(r["prompt"] for r in prompts.collect())
        return prompts.where("prompt is not null").select("prompt", F.lit(0).alias("completion"), F.concat("prompt", F.lit("!")).alias("reply"))

    out = J.fan_out(rows, source, F.concat("x", "y")).select("key", "reply")
    assert sorted(map(tuple, out.collect())) == [(1, "ab!"), (2, "ab!"), (3, "ab!"), (6, "cd!")]
    assert sorted(asked, key=str) == sorted(["ab", None, "cd"], key=str)
    digested = lambda p: p.select("prompt", F.lit(0).alias("completion"), F.md5("prompt").alias("reply"))
    exchanges = _exchanges(J.fan_out(rows, digested, F.concat("x", "y")).select("key", "reply"))
    assert exchanges and not any("prompt" in e for e in exchanges)


def test_draws_stay_in_their_row(spark, small):
    """members are grouped once, by example; nothing groups, and so sorts and spills, a row for each member of each draw."""
    plan = catalog.QUERIES["rsa_subsets"](spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [") == 1 and "collect_list" in plan


def test_rows_of_a_common_text_are_not_brought_together(spark, small):
    """rollouts meet the nodes of their texts without an exchange by text, and are ranked in the partitions they were numbered in."""
    exchanges = _exchanges(catalog.QUERIES["cascade_best_of_n"](spark, small))
    assert exchanges and not any("example_id" in e and "idx" in e and "answer" in e for e in exchanges)


def test_equal_sets_of_candidates_vote_once(spark, small, monkeypatch):
    """votes are counted for distinct sets of labels, not for each example."""
    from evalgrove.plans import match_queries

    seen = []
    kept = match_queries.staged
    monkeypatch.setattr(match_queries, "staged", lambda df, name="stage": seen.append((name, kept(df, name))) or seen[-1][1])
    rows = catalog.QUERIES["voting_ancestor"](spark, small).count()
    votes = dict(seen)["votes"]
    assert votes.count() == votes.select("labels").distinct().count() and rows > 0


def test_blocks_of_vectors_are_arrays_of_bounded_size(spark, monkeypatch):
    """a block goes out as two arrays, as many vectors as their numbers allow, and blocks together find what one does."""
    from evalgrove.operators import match

    rng = np.random.default_rng(3)
    rows = [(f"n{i}", i, (v / np.linalg.norm(v)).tolist()) for i, v in enumerate(rng.normal(size=(300, 16)))]
    nodes = spark.createDataFrame(rows, "label string, ord long, embedding array<double>")
    queries = nodes.where("ord % 20 = 0").withColumnRenamed("ord", "id")
    sizes = []
    kept = match._vectors
    monkeypatch.setattr(match, "_vectors", lambda block: sizes.append(kept(block)) or sizes[-1])
    found = lambda: sorted(map(tuple, match.nearest(queries, nodes, 3).select("id", "rank", "ord", "score").collect()))
    whole = found()
    assert [v.shape for _, v in sizes] == [(300, 16)] and len(whole) == 45
    sizes.clear()
    monkeypatch.setattr(match, "BLOCK_NUMBERS", 1600)
    assert found() == whole
    assert len(sizes) == 3 and sum(len(o) for o, _ in sizes) == 300
