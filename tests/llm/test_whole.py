"""What the reviewed cuts lost: each test fails on the code before its finding was settled."""

from __future__ import annotations

import base64
import re
import zlib

import brute
import numpy as np
import pyarrow as pa
import pytest
from evalgrove.llm import decontaminate, language, mixing, rules, secrets, spans


def test_language_stage_rejects_planted_junk(spark, small):
    """Junk of every length goes, clean texts stay, short ones too."""
    rng = np.random.default_rng(7)
    letters = list("abcdefghijklmnopqrstuvwxyz   ")
    docs = [(d["doc_id"], d["text"], d["lang"]) for d in brute.rows(small, "documents") if d["text"]]
    junk, clean = [], []
    for i, size in enumerate([32, 64, 128, 512, 4000] * 6):
        junk.append((100000 + 3 * i, "".join(rng.choice(letters, size)), None))
        junk.append((100001 + 3 * i, base64.b64encode(rng.bytes(size)).decode(), None))
        junk.append((100002 + 3 * i, "".join(f"<td id={rng.integers(1e9):x} class=q{rng.integers(99)}/>" for _ in range(size // 20 + 1)), None))
    for i, (_, text, _) in enumerate(docs[:100]):
        clean.append((200000 + i, text.split("\n")[0], None))
    frame = spark.createDataFrame(docs + junk + clean, "doc_id long, text string, lang string")
    kept = {r["doc_id"] for r in language.with_language(frame).select("doc_id").collect()}
    assert len(kept & {d[0] for d in junk}) == 0
    assert len(kept & {d[0] for d in docs}) >= 0.98 * len(docs)
    assert len(kept & {d[0] for d in clean}) >= 0.97 * len(clean)


def test_short_ends_of_repeated_runs_go(spark):
    """Sentences of 12, 12 and 6 words in whole copies and within other text, and random runs, against all runs."""
    rng = np.random.default_rng(9)
    words = ["aa", "bo", "cu", "di", "ew", "fy", "ga", "hi", "ix", "jo"]

    def sentence(n):
        return " ".join(rng.choice(words, n)) + "."

    run = " ".join(sentence(n) for n in (12, 12, 6))
    docs = [(1, run), (2, run), (3, f"{sentence(15)} {run} {sentence(30)}"), (4, f"{sentence(9)} {run} {sentence(17)}")]
    pool = [sentence(int(n)) for n in rng.integers(1, 15, 30)]
    for i in range(5, 30):
        at = int(rng.integers(0, 20))
        docs.append((i, " ".join([sentence(7), *pool[at : at + int(rng.integers(1, 10))], sentence(4)])))
    got = {r["doc_id"]: r for r in spans.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got[2]["kept_text"] == ""
    assert {k: r["n_removed"] for k, r in got.items()} == brute.spans_removed(docs)


def test_short_sentences_and_one_document_in_rows(spark):
    """Three short sentences repeat and go; two stay; equal rows of one id keep what the first keeps."""
    run = "Yes, he did. So did I. Then we left."
    docs = [(1, f"Some lead here. {run} One end."), (2, f"{run} Another end."), (3, "So did I. Then we left. Third end of it."), (4, f"{run} Own. {run} Tail."), (4, f"{run} Own. {run} Tail.")]
    got = sorted(map(tuple, spans.deduplicate(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)).select("doc_id", "kept_text").collect()))
    assert got == [(1, docs[0][1]), (2, "Another end."), (3, docs[2][1]), (4, "Own. Tail."), (4, "Own. Tail.")]


@pytest.mark.parametrize("leads", [(4, 8), (4, 20), (0, 33)])
def test_passages_pasted_in_mid_sentence_line_up(spark, leads):
    """Two sentences of 26 and 27 words behind leads without a stop: most of each second copy goes."""
    rng = np.random.default_rng(11)
    fresh = lambda n: [f"{''.join(rng.choice(list('abcdefghijklmnop'), 6))}" for _ in range(n)]
    docs, passages = [], []
    for k in range(20):
        passage = " ".join(fresh(26)) + ". " + " ".join(fresh(27)) + "."
        for j, lead in enumerate(leads):
            docs.append((2 * k + j, " ".join([*fresh(lead), passage, *fresh(9)])))
        passages.append(passage.split())
    got = {r["doc_id"]: r["kept_text"] for r in spans.deduplicate(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    left = [len(set(got[2 * k + 1].split()) & set(p)) for k, p in enumerate(passages)]
    assert all(got[2 * k] == docs[2 * k][1] for k in range(20))
    assert sum(left) <= 0.35 * 53 * 20 and sum(n < 53 for n in left) >= 19
    assert all("".join(spans.pieces(t)) == t for _, t in docs)


def test_line_labels_follow_most_documents():
    lines, of = np.array([7, 8, 7, 9, 7, 7, 9, 8]), np.array([0, 0, 1, 1, 2, 2, 3, 4])
    good = np.array([True, True, False, False, False, False, True, True])
    # 7: one good document against two, however often each has it; 9: as many of either; 8: good only
    assert rules.line_labels(lines, of, good).tolist() == [False, True, False, False, False, False, True, True]


def test_rules_split_a_document(spark, medium):
    """Clean lines above or below spoilt ones, all of held-out documents, get the labels of their own parts."""
    docs, labels = spark.read.parquet(f"{medium}/documents.parquet"), spark.read.parquet(f"{medium}/labels.parquet")
    field = rules.train(docs, labels)
    rows = docs.join(labels, "doc_id").where(language.held_out(docs["doc_id"])).orderBy("doc_id").select("text", "quality").collect()
    clean = [r["text"] for r in rows if r["quality"] == 1 and r["text"] and r["text"].count("\n") >= 2]
    spoilt = ["\n".join(x for x in r["text"].split("\n")[1:] if x.strip()) for r in rows if r["quality"] == 0 and r["text"] and "!! " in r["text"]]
    assert len(clean) >= 10 and spoilt
    right = total = 0
    for i, text in enumerate(clean):
        junk = "\n".join([spoilt[i % len(spoilt)].split("\n")[0]] + ["BUY NOW!! ### $$$ %%% WIN!! ***"] * 2)
        for parts in ((text, junk), (junk, text)):
            features, _ = rules.lines_of("\n".join(parts))
            sizes = [len(rules.lines_of(p)[0]) for p in parts]
            found = rules.viterbi(features @ field.weights, field.stay)
            right += int((found == np.repeat([p is text for p in parts], sizes)).sum())
            total += sum(sizes)
    assert right >= 0.97 * total


def test_rules_learn_from_evenly_spaced_runs(spark):
    """A document of any length gives at most runs * SEQUENCE lines, from its beginning to its end."""
    text = "\n".join(f"line number {i} of many." for i in range(10_000))
    batch = pa.RecordBatch.from_pydict({"_id": ["1", "2"], "quality": pa.array([1, 0], pa.int32()), "text": [text, "# $\n\n% &"]})
    out = next(iter(rules._sampler(3)(iter([batch])))).to_pydict()
    assert out["_id"] == ["1", "1", "1", "2"] and list(map(len, out["hashes"])) == [rules.SEQUENCE] * 3 + [2]
    last = rules.lines_of(text)[0][-rules.SEQUENCE :]
    assert out["lines"][2] == pytest.approx(last.ravel().tolist())


def test_two_hundred_languages_hold_few_tables(monkeypatch):
    """Automata take a few numbers a character, tables are made for some languages at a time; phrases are the greedy ones in all."""
    rng = np.random.default_rng(9)
    syllables = {f"l{k:03d}": ["".join(map(chr, [*rng.integers(97, 123, 2), 0x400 + k])) for _ in range(40)] for k in range(200)}
    text = lambda lang, n: "".join(s + " " * int(rng.integers(0, 2)) for s in rng.choice(syllables[lang], n))
    samples = {lang: [text(lang, 150) for _ in range(3)] for lang in syllables}
    model = language.Model(samples)
    texts = [text(lang, 20) for lang in model.languages]
    assert model.predict(texts)[0] == model.languages
    assert len(model._tables) < language.TABLES
    for lang, automaton in zip(model.languages, model.automata):
        assert len(automaton.keys) <= 3 * sum(len(t) + 1 for t in samples[lang])
    got = model.phrases([model.symbol[language._codes(t)] for t in texts[:3]])
    for j in range(0, 200, 40):
        parser = brute.Parser(samples[model.languages[j]])
        assert got[:, j].tolist() == [parser.phrases(t) for t in texts[:3]]
    monkeypatch.setattr(language, "TABLES", 1)
    assert (language.Model(samples).phrases([model.symbol[language._codes(t)] for t in texts[:3]]) == got).all()


def test_languages_of_many_characters():
    """Three scripts of 300 characters each, and rare letters: phrases are the greedy ones and texts of a sample go to its language."""
    rng = np.random.default_rng(5)
    words = {lang: ["".join(chr(start + int(c)) for c in rng.integers(0, 300, 2)) for _ in range(400)] for lang, start in (("aa", 0x4E00), ("bb", 0xAC00), ("cc", 0x5E00))}
    words["zz"] = ["the", "cat", "sat", "on", "mats"]
    text = lambda lang, n: "".join(rng.choice(words[lang], n))
    samples = {lang: [text(lang, 300 if lang == "aa" else 900) for _ in range(3)] for lang in words}
    model = language.Model(samples)
    for lang in words:
        got, _ = model.predict([samples[lang][1][100:300], text(lang, 60)])
        assert got == [lang, lang]

    parsers = {lang: brute.Parser(samples[lang]) for lang in words}
    for lang in words:
        t = samples["bb"][0][50:90] + text(lang, 20)
        got = model.phrases([model.symbol[language._codes(t)]])[0].tolist()
        assert got == [parsers[other].phrases(t) for other in model.languages]


def test_benchmark_in_blocks_keeps_rows_apart(spark):
    """Rows that repeat an id, with equal and other texts, and rows without one, by one pass and by a pass an item."""
    docs = [(1, "a b c d"), (1, "x a b y z w"), (1, "x a b y z w"), (None, "z w q"), (None, "nothing"), (None, None), (2, "")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame([(1, "a b"), (2, "z w"), (3, "b y z"), (4, "unseen words")], "item_id long, text string")
    want = [(i, len((t or "").split())) for i, t in docs]
    one, many = ([tuple(map(str, r)) for r in decontaminate.contamination(frame, bench, block_bytes=b).collect()] for b in (decontaminate.BLOCK_BYTES, 1))
    assert sorted(one) == sorted(many)
    assert sorted((r[0], r[1]) for r in many) == sorted((str(i), str(n)) for i, n in want)


def test_secrets_and_copies_of_rows_without_an_own_id(spark):
    """Null and repeated ids: every text loses its own secrets, and each source is drawn to its target."""
    secret = "password=hunter22xyz"
    rows = [(None, f"see {secret} here", "a"), (None, "nothing here at all", "a"), (1, f"{secret} first", "a"), (1, f"a longer lead before {secret}", "b"), (1, "clean text", "b"), (2, "plain words", None)]
    clean = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted(r["text"] for r in clean) == sorted(t.replace(secret, "[SECRET]") for _, t, _ in rows)
    many = [(None if i % 3 == 0 else i % 5, "w " * (i % 7 + 1) + f"x{i}", "a" if i % 4 else "b") for i in range(300)] + [(9, "w w", None)] * 3
    docs = spark.createDataFrame(many, "doc_id long, text string, source string")
    mixed = mixing.mix(docs)
    taken = {}
    for r in mixed.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    out = mixing.emit(docs, mixed).collect()
    words = {s: sum(len(r["text"].split()) for r in out if r["source"] == s) for s in taken}
    assert words == taken
    assert len({(r["doc_id"], r["text"], r["copy"]) for r in out if r["source"]}) == len([r for r in out if r["source"]])


def test_sample_is_taken_from_whole_texts(spark):
    """Few long documents fill the budget, with pieces from all of each; short ones are taken whole."""
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5]
    text = lambda n: " ".join(f"w{k:05d}" for k in range(n))
    docs = [(i, text(20000), "aa") for i in ids[:3]] + [(ids[3], "short text", "bb"), (ids[4], text(9000), "bb")] + [(i, text(1000), "cc") for i in ids[5:90]]
    got = language.training_sample(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    assert {k: len(v) for k, v in got.items()} == {"aa": 3, "bb": 2, "cc": language.DOCS}
    for lang, texts in got.items():
        assert 0.95 * language.CHARS <= sum(map(len, texts)) <= 1.05 * language.CHARS, lang
    assert "short text" in got["bb"]
    for t, n in [*((t, 20000) for t in got["aa"]), *((t, 1000) for t in got["cc"])]:
        seen = [int(w[1:]) for w in t.split() if re.fullmatch(r"w\d{5}", w)]
        assert min(seen) < 0.05 * n and max(seen) > 0.9 * n
    assert all(any(abs(int(w[1:]) - 10000) < 500 for w in t.split() if re.fullmatch(r"w\d{5}", w)) for t in got["aa"])
