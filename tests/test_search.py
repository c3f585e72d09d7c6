"""Searching labels: stems, automata, shares of n-grams, and nearest vectors with pruning."""

from __future__ import annotations

import random

import numpy as np
import pytest
from evalgrove.functions.stem import stem, stem_words
from evalgrove.operators import match
from pyspark.sql import functions as F

# Pairs of the sample vocabulary that is published with the algorithm.
PAIRS = (
    "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistent consist consistently consist consisting consist consists consist "
    "consolation consol consolations consol consolatory consolatori consolidate consolid consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson consort consort "
    "consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl "
    "constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee "
    "kneel kneel kneeled kneel kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight knightly knight knights knight knit knit knits knit knitted knit "
    "knitting knit knives knive knob knob knobs knob knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot"
).split()


def test_published_stems():
    assert {a: stem(a) for a in PAIRS[::2]} == dict(zip(PAIRS[::2], PAIRS[1::2]))


@pytest.mark.parametrize(
    "word,want",
    [("skies", "sky"), ("dying", "die"), ("innings", "inning"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("this", "this"), ("gaps", "gap"), ("kiwis", "kiwi"), ("luxuriated", "luxuri"), ("hopping", "hop"),
     ("hoping", "hope"), ("by", "by"), ("say", "say"), ("cry", "cri"), ("youth", "youth"), ("generously", "generous"), ("communism", "communism"), ("relational", "relat"), ("national", "nation"), ("agreed", "agre"),
     ("feed", "feed"), ("dog's", "dog"), ("'tis", "tis"), ("be", "be"), ("", ""), ("fall", "fall"), ("controll", "control"), ("rate", "rate"), ("españa", "españa"), ("adoption", "adopt"), ("apology", "apolog")],
)
def test_stems(word, want):
    assert stem(word) == want


def test_stems_of_texts(spark):
    rows = spark.createDataFrame([("running  dogs",), (None,), ("",)], "t string").select(stem_words(F.col("t")).alias("s"))
    assert [r["s"] for r in rows.collect()] == ["run dog", None, ""]


NODES = [("cat", 3), ("Cat!", 0), ("a cat sat", 2), ("", 4), ("at", 1), ("hat", 5), ("big red dog", 6), ("red dog", 7), ("dogs", 8)]


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(label, [label, "root"], 2, o, label.lower()) for label, o in NODES]
    return spark.createDataFrame(rows, "label string, path array<string>, depth int, ord int, norm string")


@pytest.mark.parametrize("bound", [match.BROADCAST_NODES, 2])
def test_containment(spark, nodes, monkeypatch, bound):
    """Each text against each label, however many blocks the labels come in."""
    monkeypatch.setattr(match, "BROADCAST_NODES", bound)
    texts = ["A cat sat.", "the HAT", "nothing", "", "concatenate", "big red dog"]
    got = match.contained_hits(spark.createDataFrame([(t,) for t in texts], "text string"), nodes).collect()
    clean = {t: t.lower().rstrip(".") for t in texts}
    want = {(t, o) for t in texts for label, o in NODES if label.lower().replace("!", "") in clean[t]}
    assert {(r["text"], r["ord"]) for r in got} == want and len(got) == len(want)
    plan = match.contained_hits(spark.createDataFrame([("x",)], "text string"), nodes)
    assert plan._jdf.queryExecution().executedPlan().toString().count("Generate") <= 2


def test_direct_by_stems(spark, nodes):
    texts = spark.createDataFrame([("cats",), ("big red dogs",), ("dog",), (None,)], "text string")
    got = {r["text"]: r["predicted_node"] for r in match.direct(texts, nodes, "exact_match", stem=True).collect()}
    assert got == {"cats": "cat", "big red dogs": "big red dog", "dog": "dogs", None: None}
    held = {r["text"]: r["predicted_node"] for r in match.direct(texts, nodes, "contained", stem=True).collect()}
    assert held["big red dogs"] == "dogs" and held["cats"] == ""


@pytest.mark.parametrize("bound", [match.BROADCAST_NODES, 3])
def test_lexical_shares(spark, monkeypatch, bound):
    """The k best by brute force, on words of which one pair is in nearly all labels and texts."""
    monkeypatch.setattr(match, "BROADCAST_NODES", bound)
    rng = random.Random(2)
    phrase = lambda: " ".join([*rng.choices("abcdef", k=rng.randint(0, 3)), *(["hot", "pair"] if rng.random() < 0.9 else []), *rng.choices("abcdef", k=rng.randint(0, 3))])
    labels, texts = sorted({phrase() for _ in range(40)}), sorted({phrase() for _ in range(30)})
    nodes = spark.createDataFrame([(x, [x], 1, i, x) for i, x in enumerate(labels)], "label string, path array<string>, depth int, ord int, norm string")
    grams = lambda t: set(zip(t.split(), t.split()[1:]))
    for k in (1, 3):
        got = match.lexical_hits(spark.createDataFrame([(t,) for t in texts], "text string"), nodes, k)
        top = match.top_k(spark.createDataFrame([(t,) for t in texts], "text string"), nodes, got, k, last_wins=False)
        want = set()
        for t in texts:
            scored = sorted((-(len(grams(x) & grams(t)) / len(grams(x)) if grams(x) else 0.0), i) for i, x in enumerate(labels))
            want |= {(t, r, labels[i], -s) for r, (s, i) in enumerate(scored[:k], 1)}
        assert {(r["text"], r["rank"], r["label"], r["score"]) for r in top.collect()} == want
    assert "hashpartitioning(_p" not in got._jdf.queryExecution().executedPlan().toString()


def nearest_by_force(queries, vectors, k):
    out = {}
    for i, q in enumerate(queries):
        score = (vectors * q).sum(axis=1)
        out[i] = np.lexsort((np.arange(len(vectors)), -score))[:k].tolist()
    return out


@pytest.mark.parametrize("block,pivots", [(10**6, 64), (300, 8), (10**6, 1)])
def test_nearest_is_exact(spark, block, pivots):
    """Clustered, repeated and zero vectors, in one block and in several."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    vectors = np.concatenate([centres[rng.integers(0, 12, 900)] + rng.normal(size=(900, 16)) * 0.05, rng.normal(size=(100, 16))])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    vectors[50:70] = vectors[49]
    vectors[500] = 0
    queries = np.concatenate([vectors[::97], rng.normal(size=(5, 16))])
    queries[-5:] /= np.linalg.norm(queries[-5:], axis=1, keepdims=True)
    nodes = spark.createDataFrame([(f"n{i}", i, v.tolist()) for i, v in enumerate(vectors)] + [("none", 5000, None)], "label string, ord int, embedding array<double>")
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(queries)] + [(99, None)], "id int, embedding array<double>")
    computed = spark.sparkContext.accumulator(0)
    got = match.nearest(asked, nodes, 5, block=block, pivots=pivots, computed=computed).orderBy("id", "rank").collect()
    found = {i: [r["ord"] for r in got if r["id"] == i] for i in range(len(queries))}
    assert found == nearest_by_force(queries, vectors, 5) and not [r for r in got if r["id"] == 99]
    share = computed.value / (len(queries) * len(vectors))
    assert share < (0.5 if pivots == 64 else 1.01), share
    assert match.nearest(asked, nodes.limit(0), 5).collect() == []


def test_share_of_pairs_at_a_hundred_thousand_vectors():
    """In clusters few pairs are computed; the answers are those of all pairs."""
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(200, 32))
    vectors = centres[rng.integers(0, 200, 100_000)] + rng.normal(size=(100_000, 32)) * 0.1
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    cells = match._Cells([(i, v) for i, v in enumerate(vectors)], 256)
    found, pairs = cells.search(vectors[::5000], 3)
    assert {i: [o for o, _ in row] for i, row in enumerate(found)} == nearest_by_force(vectors[::5000], vectors, 3)
    assert pairs < 0.1 * 20 * 100_000
