"""Literal cases of the column functions and of the semantics decided for edge cases."""

from __future__ import annotations

import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evalgrove.functions import metrics as M
from evalgrove.functions import prompts as P
from evalgrove.functions import text as T


def value(spark, column, **inputs):
    row = spark.createDataFrame([tuple(inputs.values()) or (1,)], ", ".join(f"{k} {kind(v)}" for k, v in inputs.items()) or "x int")
    return row.select(column.alias("v")).head()["v"]


def kind(v):
    if isinstance(v, list):
        return f"array<{kind(v[0]) if v else 'string'}>"
    return {str: "string", int: "int", float: "double", bool: "boolean", type(None): "string"}[type(v)]


@pytest.mark.parametrize(
    "f,text,want",
    [
        (T.normalize_match, "España", "españa"), (T.normalize_audit, "España", "espa a"), (T.normalize_index, "España", "espa a"),
        (T.normalize_match, "a_b", "ab"), (T.normalize_audit, "a_b", "a b"), (T.normalize_index, "a_b", "a b"),
        (T.normalize_match, " Semi-  trailer! ", "semi trailer"), (T.normalize_scores, "a  b-c", "a  b c"),
        (T.clean_full, "A: red fox.", "red fox"), (T.clean_light, "A: red fox.", "red fox."),
        (T.clean_full, "x<|end_header_id|> dog!!<|eot_id|>y", "dog!"), (T.clean_full, "", ""), (T.normalize_audit, "<b>Hi</b> 5", "hi 5"),
        (T.clean_full, "dog.\n", "dog.\n".strip()[:-1]),
    ],
)
def test_text(spark, f, text, want):
    assert value(spark, f(F.col("t")), t=text) == want


@pytest.mark.parametrize("needle,hay,want", [("cat", "caterpillar", False), ("golden retriever", "a golden retriever dog", True), ("50", "1950", False), ("", "x", False)])
def test_phrase(spark, needle, hay, want):
    assert value(spark, T.phrase_in(F.col("n"), F.col("h")), n=needle, h=hay) is want


@pytest.mark.parametrize("alias,want", [("707", False), ("au", False), ("boeing", True), ("1234", False)])
def test_alias_seed(spark, alias, want):
    assert value(spark, T.is_alias_seed(F.col("a")), a=alias) is want


def test_ngrams(spark):
    assert value(spark, T.ngrams(F.col("t"), 3), t="a b") == []
    assert value(spark, T.ngrams(F.col("t"), 1), t="") == []
    assert sorted(value(spark, T.ngrams(F.col("t"), 2), t="a b a b")) == ["a b", "b a"]
    assert value(spark, T.ngram_overlap(F.col("p"), F.col("l")), p="red", l="red") == 0.0


@pytest.mark.parametrize("n,c,k,want", [(3, 0, 2, 0.0), (3, 0, 4, 1.0), (4, 2, 1, 0.5), (5, 5, 5, 1.0), (1, 0, 1, 0.0)])
def test_pass_at_k(spark, n, c, k, want):
    got = value(spark, M.pass_at_k(F.col("n"), F.col("c"), F.col("k")), n=n, c=c, k=k)
    assert got == pytest.approx(want)
    strict = value(spark, M.pass_at_k(F.col("n"), F.col("c"), F.col("k"), strict=True), n=n, c=c, k=k)
    assert strict == (None if k > n else pytest.approx(want))


def test_pass_at_k_is_the_binomial_form(spark):
    rows = [(n, c, k) for n in range(1, 9) for c in range(n + 1) for k in range(1, n + 1)]
    got = spark.createDataFrame(rows, "n int, c int, k int").select("n", "c", "k", M.pass_at_k(F.col("n"), F.col("c"), F.col("k")).alias("v")).collect()
    assert all(r["v"] == pytest.approx(1 - math.comb(r["n"] - r["c"], r["k"]) / math.comb(r["n"], r["k"])) for r in got)


@pytest.mark.parametrize("p,r,want", [(["b", "a", "root"], ["c", "a", "root"], (2 / 3, 2 / 3, 2 / 3)), (["a", "root"], ["c", "a", "root"], (1, 2 / 3, 0.8)), (["x"], ["y"], (0, 0, 0))])
def test_hierarchical(spark, p, r, want):
    assert tuple(value(spark, M.hierarchical(F.col("p"), F.col("r")), p=p, r=r)) == pytest.approx(want)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=5), min_size=2, max_size=30))
def test_common_suffix_is_the_suffix_set_form(spark, paths):
    pairs = list(itertools.pairwise(paths))
    got = spark.createDataFrame(pairs, "p array<string>, r array<string>").select("p", "r", M.common_suffix(F.col("p"), F.col("r")).alias("n")).collect()
    ends = lambda x: {tuple(x[i:]) for i in range(len(x))}
    assert all(row["n"] == len(ends(row["p"]) & ends(row["r"])) for row in got)


def test_prune(spark):
    prune = lambda c, drop=(), keep=(): value(spark, M.prune_chain(F.col("c"), drop, keep), c=c)
    assert prune(["leaf", "b", "a"]) == ["a", "b", "leaf"]
    assert prune(["leaf", "b", "a"], drop=["a"]) == ["b", "leaf"]
    assert prune(["leaf", "b", "a"], drop=["leaf"]) == []
    assert prune(["leaf", "r", "b", "r", "a"], keep=["r"]) == ["r", "leaf"]
    assert prune(["leaf", "b", "r"], keep=["r"]) == ["r", "b", "leaf"]


@pytest.mark.parametrize("reply,want", [("<answer>0</answer> x <answer> 1 </answer>", (True, "1", True)), ("no tag", (False, "", False)), ("<answer>7</answer>", (False, "7", True))])
def test_free_form(spark, reply, want):
    assert tuple(value(spark, P.parse_free_form(F.col("r")), r=reply)) == want


@pytest.mark.parametrize(
    "reply,want",
    [('{"verdict":"yes","reason":" "}', (False, "(parse error)", False)), ('{"verdict":"yes","reason":" ok "}', (True, "ok", True)), ('{"verdict":"no","reason":"x"}', (False, "x", True)), ("yes", (False, "(parse error)", False)), ('{"verdict":"yes"', (False, "(parse error)", False)), ('{"verdict":"yes","reason":5}', (False, "(parse error)", False))],
)
def test_structured(spark, reply, want):
    assert tuple(value(spark, P.parse_structured(F.col("r")), r=reply)) == want


def test_results_path(spark):
    f = lambda p: value(spark, T.results_path(F.col("p")), p=p)
    assert f("d/R_judged_lab_m-4b.jsonl") == "d/R_results_lab_m-4b.json"
    assert f("R_samples_judged_x.jsonl") == "R_results_x.json"
    assert f("R_samples.jsonl") == "R_results.json"
    assert f("d/x.jsonl") == "d/generations_results.json"


def test_softmax_gate(spark):
    gate = lambda s: value(spark, M.is_ambiguous(M.softmax(F.col("s"))), s=s)
    assert gate([0.5, 0.5, 0.5]) is True
    assert gate([1.0, 0.0, 0.0]) is False
    assert gate([1.0]) is False


def test_evidence_falls_back(spark):
    block = P.evidence_block(F.col("l"), F.col("d"))
    assert value(spark, block, l=["a"], d=["", " "]) == ""
    assert value(spark, block, l=["a"], d=["x", "", "z"]) == "Ground-truth description evidence:\n- Ground truth: a — x\n- Grandparent: z"


def test_unknown_variant():
    with pytest.raises(ValueError, match="unknown prompt variant"):
        P.question_prompt(F.lit("q") if False else None, "nope")
