"""Whole tables against brute force."""

from __future__ import annotations

import hashlib
from collections import defaultdict

import brute
import pytest
from evalgrove.llm import queries as q


@pytest.fixture(scope="module")
def docs(medium):
    return brute.rows(medium, "documents")


def result(df, key="doc_id"):
    return {r[key]: r for r in df.collect()}


def test_mix(spark, medium, docs):
    got = result(q.op1_mix_sources(spark, medium))
    size, target = brute.target_words(docs)
    taken = defaultdict(int)
    for d in docs:
        r = got[d["doc_id"]]
        assert r["size"] == len(brute.WORD.findall(d["text"] or ""))
        assert r["source_size"] == size[d["source"]]
        assert r["target"] == pytest.approx(target[d["source"]], rel=1e-9)
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[d["source"]] += r["taken"]
    largest = max(r["size"] for r in got.values())
    assert all(abs(taken[s] - target[s]) <= largest for s in target)
    assert {k: r["taken"] for k, r in result(q.op1_mix_sources(spark, medium)).items()} == {k: r["taken"] for k, r in got.items()}


def test_near(spark, medium, docs):
    got = result(q.op2_near_dedup(spark, medium))
    assert {k: (r["n_shingles"], r["component_id"]) for k, r in got.items()} == brute.near(docs, 3, 85)
    assert all(r["kept"] == (k == r["component_id"]) for k, r in got.items())


def test_secrets(spark, medium, docs):
    got = result(q.op4_secret_scan(spark, medium))
    for d in docs:
        want = brute.base_spans(d["text"] or "")
        r = got[d["doc_id"]]
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == x for _, _, x in want) for k in ("assign", "access", "hex"))
        assert r["base_sha256"] == brute.sha(",".join(f"{k}:{s}:{e}" for s, e, k in want))
        assert {f"{k}:{s}:{e}" for s, e, k in want} <= set(r["spans"].split(","))


def test_warc(spark, medium):
    got = result(q.op7_warc(spark, medium), "page_id")
    assert {k: tuple(r)[1:] for k, r in got.items()} == brute.warc(brute.rows(medium, "pages"))


def test_leaks(spark, medium, docs):
    got = result(q.op9_decontaminate(spark, medium))
    assert {k: tuple(r)[1:5] for k, r in got.items()} == brute.leaks(docs, brute.rows(medium, "benchmark"))
    assert all(r["contaminated"] == (r["n_hit"] > 0) for r in got.values())


def test_repeats(spark, small):
    docs = brute.rows(small, "documents")
    got = result(q.op3_suffix_dedup(spark, small))
    assert {k: tuple(r)[1:] for k, r in got.items()} == brute.repeats(docs)


def test_language(spark, medium, docs):
    import zlib

    got = result(q.op5_language(spark, medium))
    assert len(got) == len(docs)
    held = [d for d in docs if zlib.crc32(str(d["doc_id"]).encode()) % 5 == 0]
    assert {d["doc_id"] for d in held} == {k for k, r in got.items() if r["held_out"]}
    assert sum(got[d["doc_id"]]["lang_pred"] == d["lang"] for d in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_language_by_brute_force(spark, small):
    """Every whole text's language and score, by another way of greedy parsing."""
    from evalgrove.llm import language

    docs = brute.rows(small, "documents")
    want = brute.languages(docs, language.training_sample(spark.read.parquet(f"{small}/documents.parquet")))
    got = result(q.op5_language(spark, small))
    assert {k: r["lang_pred"] for k, r in got.items()} == {k: x for k, (x, _) in want.items()}
    assert all(r["score"] == pytest.approx(want[k][1], rel=1e-9) for k, r in got.items())


def test_quality(spark, medium, docs):
    labels = {r["doc_id"]: r["quality"] for r in brute.rows(medium, "labels")}
    got = result(q.op6_quality(spark, medium))
    held = [k for k, r in got.items() if r["held_out"] and k in labels]
    good, bad = ([got[k]["score"] for k in held if labels[k] == y] for y in (1, 0))
    assert sum(g > b for g in good for b in bad) >= 0.9 * len(good) * len(bad)
    assert all(r["predicted"] == (r["score"] >= 0.3) and 0 <= r["score"] <= 1 for r in got.values())


def test_quality_by_brute_force(spark, small):
    """Scores of all documents with every pair of inputs summed one by one."""
    import math

    import numpy as np
    from evalgrove.llm import quality

    frame = spark.read.parquet(f"{small}/documents.parquet")
    machine = quality.train(frame, spark.read.parquet(f"{small}/labels.parquet"))
    got = result(q.op6_quality(spark, small))
    for d in brute.rows(small, "documents"):
        cols, x = quality.inputs(d["text"], d["n_chars"], quality._Columns())
        inner = (machine.v[cols] @ machine.v[cols].T) * np.outer(x, x)
        raw = machine.b + float(machine.w[cols] @ x) + float(np.triu(inner, 1).sum())
        assert got[d["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-max(-30.0, min(30.0, raw)))), rel=1e-6)


def test_rules_by_brute_force(spark, medium, docs):
    """Kept or not, by the textbook recursion over both labels of every line."""
    from evalgrove.llm import rules

    field = rules.train(spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet"))
    got = result(q.op8_rules(spark, medium))
    for d in docs:
        lines, words = rules.lines_of(d["text"] or "")
        paths = [(0.0, 0), (0.0, 0)]
        for t, (x, n) in enumerate(zip(lines, words.tolist())):
            own = (0.0, float(x @ field.weights))
            after = []
            for y in (0, 1):
                options = [(paths[z][0] + (field.stay[y] if z == y else 0.0) + own[y], paths[z][1] + n * y) for z in (0, 1)] if t else [(own[y], n * y)]
                after.append(max(options, key=lambda o: o[0]))
            paths = after
        share = max(paths, key=lambda p: p[0])[1] / words.sum() if len(words) else 0.0
        r = got[d["doc_id"]]
        assert r["kept"] == (not r["base_failed"] and share >= rules.MIN_CONTENT) and r["content"] == pytest.approx(share)


def test_rules(spark, medium, docs):
    got = result(q.op8_rules(spark, medium))
    for d in docs:
        r, want = got[d["doc_id"]], brute.quality_counts(d["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    labels = {r["doc_id"]: r["quality"] for r in brute.rows(medium, "labels")}
    clean = [k for k, y in labels.items() if y == 1 and not got[k]["base_failed"]]
    assert sum(got[k]["kept"] for k in clean) >= 0.98 * len(clean)
    junk = [k for k, y in labels.items() if y == 0 and not got[k]["base_failed"]]
    assert sum(not got[k]["kept"] for k in junk) >= 0.9 * len(junk)


def test_sentence_spans(spark, small):
    """All runs of all whole texts, by a segmenter of its own."""
    docs = [(d["doc_id"], d["text"]) for d in brute.rows(small, "documents")]
    got = result(q.op10_sentence_spans(spark, small))
    assert {k: r["n_removed"] for k, r in got.items()} == brute.spans_removed(docs, sentences=10**9)
    assert {k: r["n_pieces"] for k, r in got.items()} == {k: len(brute.pieces(t)) for k, t in docs}


def test_sentence_spans_of_few_words(spark, small, tmp_path):
    """runs of three sentences are cut by the query too, beside passages, and counted apart."""
    docs = [(d["doc_id"], d["text"]) for d in brute.rows(small, "documents")]
    got = result(q.op10_sentence_spans(spark, small))
    both, passages = brute.spans_removed(docs), brute.spans_removed(docs, sentences=10**9)
    assert {k: r["n_removed"] + r["n_short_removed"] for k, r in got.items()} == both
    assert {k: r["n_short_removed"] for k, r in got.items()} == {k: both[k] - passages[k] for k in both}
    assert any(both[k] > passages[k] for k in both)
    texts = [(1, "One here. Two here. Three here. And the end of a first text."), (2, "Another start. One here. Two here. Three here. Some other end.")]
    spark.createDataFrame(texts, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    cut = result(q.op10_sentence_spans(spark, str(tmp_path)))
    assert cut[1]["n_short_removed"] == cut[2]["n_removed"] == 0 and cut[2]["n_short_removed"] >= 3
    assert cut[2]["kept_sha256"] == hashlib.sha256(b"Another start. Some other end.").hexdigest()
