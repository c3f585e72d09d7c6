"""Findings of the fourth round: what rounds over answers write to disk."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F
from test_r03 import _exchanges

from evalgrove.functions import prompts as P
from evalgrove.operators import judge as J
from evalgrove.plans import catalog
from evalgrove.sources import staging


def test_rounds_shuffle_narrow_answers_once(spark, small, monkeypatch):
    """questions that differ have no equal prompts, so a round brings nothing together by prompt, and lines go by three columns and their text."""
    seen = []
    kept = staging.staged
    monkeypatch.setattr(staging, "staged", lambda df, name="stage", *rest: seen.append((name, df)) or kept(df, name, *rest))
    catalog.QUERIES["rsa_rounds"](spark, small)
    rounds = [df for name, df in seen if name == "round"]
    found = [e for df in rounds for e in _exchanges(df)]
    assert len(rounds) == 2 and found and not _exchanges(rounds[1])
    assert not any(word in e for e in found for word in ("prompt", "candidates", "_h#", "reply", "l_shipdate", "l_quantity"))


#: A question whose prompts may equal those of 'x', by the words that it holds.
SHAM = P.VARIANTS["barebones"].format("x") + "\n\nCandidate answers (may contain mistakes):\n\n---- Answer 1 ----\na\n\n---- Answer 2 ----\nb"
QUESTIONS = {
    "own": ["x", "y", "z", None],
    "some": ["x", " x", "y", SHAM, None, None],
    "all": ["x", "x ", "x", "x"],
}


@pytest.mark.parametrize(("kind", "way"), [("own", "plain"), ("own", "keeping"), ("some", "keeping"), ("some", "client"), ("all", "plain")])
def test_rounds_ask_each_distinct_prompt_once(spark, kind, way):
    """whether questions are shared or not, replies are those of asking for all draws, and no prompt is asked twice in a round."""
    texts = ["a", "b", "a", " "]
    rollouts = spark.createDataFrame([(e, i, t) for e in range(len(QUESTIONS[kind])) for i, t in enumerate(texts)], "example_id long, idx int, text string")
    questions = spark.createDataFrame(list(enumerate(QUESTIONS[kind])), "example_id long, question string")
    asked = []

    def noted(prompts):
        asked[-1].extend(r["prompt"] for r in prompts.collect())
        return prompts

    digested = lambda p: p.select("*", F.lit(0).alias("completion"), F.md5("prompt").alias("reply"))
    client = J.complete_with(lambda prompts, n: [[hashlib.md5(p.encode()).hexdigest()] for p in prompts])
    answer = client if way == "client" else digested

    class Noting:
        keeps_columns = way == "keeping"

        def in_round(self, number):
            while len(asked) < number:
                asked.append([])
            return self

        def __call__(self, prompts):
            return answer(noted(prompts))

    got = sorted(map(tuple, J.aggregate_rounds(rollouts, questions, Noting(), population_size=4, k=2, steps=3).select("example_id", "slot", "text").collect()))
    members = J.packed_population(rollouts, 4)
    for step, prompts in enumerate(asked, 1):
        drawn = J.draws(members.join(questions, "example_id"), 2, 4, f"1234/{step}")
        every = [tuple(r) for r in drawn.select("example_id", "subset", P.aggregation_prompt(F.col("question"), F.col("candidates"))).collect()]
        assert sorted(prompts) == sorted({p for _, _, p in every})
        rows = [(e, s, hashlib.md5(p.encode()).hexdigest()) for e, s, p in every]
        members = J.packed(spark.createDataFrame(rows, "example_id long, slot int, text string"))
    assert len(asked) == 2 and got == sorted(rows)


def test_equal_prompts_have_equal_roots(spark):
    """a question that holds the words after a question makes the prompt of another, and both have one root."""
    rest = "b Answer in the format 'A: <answer>.'\n\nCandidate answers (may contain mistakes):\n\n---- Answer 1 ----\nc\n\n---- Answer 2 ----\nd"
    rows = spark.createDataFrame([("x", ["a", rest]), (" x", ["a", rest]), (SHAM, ["c", "d"]), ("y", ["a", rest])], "question string, candidates array<string>")
    made = [tuple(r) for r in rows.select(P.aggregation_prompt(F.col("question"), F.col("candidates")), P.asked_root(F.col("question"))).collect()]
    assert made[0] == made[1] == made[2] and made[0][0] != made[3][0] and made[0][1] != made[3][1]
