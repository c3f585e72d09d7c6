"""Exact copies, ranked search and resampling: odd rows, hot groups, bounds crossed, and brute force."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pyarrow as pa
import pytest
from evalgrove.llm import exact_dedup, queries, resample, search
from evalgrove.llm.common import Folder, byte_slices
from pyspark.sql import functions as F

CLASHES = ("id", "size", "row", "n", "keep", "sha", "g", "l", "p", "s", "prefix", "long", "meets", "q", "part", "score", "rank", "weight", "n_words", "at", "first", "item", "known", "term", "bucket", "again")
LONG = "The cat sat on a mat and then it ran off to the hill again. " * 3000
ROWS = [
    (1, "Same Text"), (2, "same text"), (2, "same text"), (3, None), (4, ""), (5, " "), (None, "SAME TEXT"), (6, LONG), (7, LONG.upper()), (8, LONG + "x"), (9, "ÄÖ"), (10, "äö"),
    (None, "only here"), (None, "Only Here"), (11, "same texu"), (12, "a" * 70 + "b"), (13, "a" * 70 + "c"), (14, "A" * 70 + "b"),
]
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).withColumns({c: F.lit("x") for c in CLASHES})


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "the CAT, the hill"), (1, "same"), (None, "same text äö"), (3, None), (4, ""), (5, "absentword"), (6, "äö ÄÖ")]
    return spark.createDataFrame(rows, "item_id long, text string").withColumns({c: F.lit("x") for c in CLASHES})


def copies_by_force(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[brute.low(t or "")].append(i)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        done = False
        for i in ids:
            kept = i == keep and not done
            done |= kept
            out.append((i, keep, len(ids), kept, brute.sha(text)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bound", [0, exact_dedup.BROADCAST_PREFIXES])
def test_copies(spark, docs, bound):
    got = exact_dedup.classes(docs, digests=True, broadcast_prefixes=bound)
    assert got.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == copies_by_force(ROWS)
    lean = exact_dedup.classes(docs, broadcast_prefixes=bound).collect()
    assert sorted((tuple(r)[:4] for r in lean), key=str) == sorted((r[:4] for r in copies_by_force(ROWS)), key=str)


def test_whole_texts_are_hashed_only_after_length_and_prefix_agree(docs):
    hashed = {r["doc_id"] for r in exact_dedup.classes(docs).where("text_sha256 IS NOT NULL AND doc_id IS NOT NULL").collect()}
    # ids 12 to 14 agree in their first 64 characters and in length; 11 has the length of 1 and 2 alone
    assert {1, 2, 3, 4, 6, 7, 12, 13, 14} == hashed


@pytest.mark.parametrize("bound", [0, exact_dedup.BROADCAST_PREFIXES])
def test_one_row_of_a_class_stays(docs, bound):
    out = exact_dedup.deduplicate(docs, broadcast_classes=bound)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert len(got) == len({brute.low(t or "") for _, t in ROWS})
    assert (2, "same text") in got and (7, LONG.upper()) in got and (4, "") in got and sum(t in ("only here", "Only Here") for _, t in got) == 1
    assert exact_dedup.deduplicate(docs.limit(0)).collect() == [] and exact_dedup.classes(docs.limit(0)).collect() == []


def test_a_third_of_all_rows_are_copies(spark):
    rows = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot text").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("text"))
    got = exact_dedup.classes(rows)
    assert got.count() == 9000 and got.where("kept").count() == 6001
    assert {tuple(r) for r in got.where("group_size > 1").select("keep_id", "group_size").distinct().collect()} == {(8997, 3000)}
    assert exact_dedup.deduplicate(rows).count() == 6001


def test_length_classes(spark):
    sizes = [0, 1, 65_535, 65_536, 65_537, 65_538, 131_071, 131_072, 131_075, 131_076, 1 << 30, (1 << 31) - 1]
    got = [r[0] for r in spark.createDataFrame([(s,) for s in sizes], "size int").select(exact_dedup._length_class(F.col("size"))).collect()]
    assert got[:4] == [0, 1, 65_535, (17 << 16) + 32_768] and got[3] == got[4] != got[5] and len(set(got)) == 10
    assert len(set(got[-2:])) == 2


def test_no_python_where_it_is_promised(spark, small):
    plan = queries.QUERIES["op11_exact_dedup"](spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "CartesianProduct" not in plan


def ranked_by_force(docs, items, k=50):
    term = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    counts = [(i, Counter(brute.low(w) for w in term.findall(t or ""))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    big_n, big_l = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in counts:
            n, score = sum(c.values()), 0
            for t in {brute.low(w) for w in term.findall(text or "")} & c.keys():
                w = math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1)))
                m = 100 - 50 + (50 * n * big_n) // big_l
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m))
            if score > 0:
                found.append((-score, i is None, i or 0))
        out += [(item, r, None if lone else i, -s) for r, (s, lone, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("postings,block", [(1, 1), (1 << 20, 1 << 20)])
def test_search(spark, docs, items, postings, block):
    """Odd rows, a shard a document, a block a query."""
    index = search.build(docs, Folder(spark, "index").path, shard_postings=postings)
    for k in (1, 3, 50):
        got = search.search(index, items, k=k, block_bytes=block)
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted(map(tuple, got.collect()), key=str) == ranked_by_force(ROWS, [(r["item_id"], r["text"]) for r in items.collect()], k)


def test_search_of_nothing(spark, docs, items):
    assert search.rank(docs.limit(0), items).collect() == [] and search.rank(docs, items.limit(0)).collect() == []
    assert search.rank(docs.where("text IS NULL OR text = ' '"), items).collect() == []


def test_search_of_whole_tables(spark, small, monkeypatch):
    monkeypatch.setattr(search, "SHARD_POSTINGS", 500)
    got = sorted(map(tuple, queries.QUERIES["op12_search"](spark, small).select("item_id", "rank", "doc_id", "score").collect()), key=str)
    docs, items = ([(r[i], r["text"]) for r in brute.rows(small, name)] for name, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert got == ranked_by_force(docs, items)


def test_best_takes_the_first_of_ties():
    rng = np.random.default_rng(1)
    for _ in range(500):
        scores = rng.integers(0, 5, int(rng.integers(0, 40)))
        k = int(rng.integers(1, 12))
        want = sorted((i for i in range(len(scores)) if scores[i] > 0), key=lambda i: (-scores[i], i))[:k]
        assert sorted(search.best(scores, k).tolist()) == sorted(want)


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def crcs(text):
    w = [x.encode() for x in WORDS.findall(brute.low(text or ""))]
    return [zlib.crc32(x) for x in w], [zlib.crc32(a + b" " + b) for a, b in zip(w, w[1:])]


def test_hashes_of_a_buffer():
    """Words across texts, nulls, bytes beyond ASCII, slices, and texts in pieces of any size."""
    rng = random.Random(1)
    letters = "aB9 .-éß語\x7f\x00Z\n"
    for trial in range(300):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 30, 300]))) for _ in range(rng.randint(0, 6))]
        if trial % 5 == 0:
            texts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 200))) + " " + "".join(rng.choice(letters) for _ in range(300))]
        column = pa.array(["before", *texts], pa.string())[1:]
        for limit in (1 << 20, 50, 7, 1):
            ones, twos = [[] for _ in texts], [[] for _ in texts]
            for text, one, pair, two in resample.features(column, limit):
                for i, c in zip(text, one):
                    ones[i].append(int(c))
                for i, c in zip(pair, two):
                    twos[i].append(int(c))
            assert list(zip(ones, twos)) == [crcs(t) for t in texts]


def test_slices_by_bytes():
    batch = pa.RecordBatch.from_arrays([pa.array(["aaa", None, "bb", "c" * 50, "", "d"])], ["t"])
    for limit in (1, 3, 5, 100):
        parts = [p.column("t").to_pylist() for p in byte_slices(iter([batch]), "t", limit)]
        assert sum(parts, []) == batch.column("t").to_pylist() and all(len(p) == 1 or sum(len(x or "") for x in p) <= limit for p in parts)


def drawn_by_force(docs, target):
    s, t = Counter(), Counter()
    for count, rows in ((s, docs), (t, target)):
        for _, text in rows:
            count.update(c % 10000 for part in crcs(text) for c in part)
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log(((t[b] + 1) * (big_s + 10000)) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    out, able = [], []
    for i, text in docs:
        one, two = crcs(text)
        found = [gain[c % 10000] for c in (*one, *two)]
        weight = sum(found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        row = [i, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None]
        out.append(row)
        if len(one) >= 20:
            able.append(row)
    able.sort(key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for place, row in enumerate(able[: 25 * len(able) // 100], 1):
        row[4] = place
    return sorted(map(tuple, out), key=str)


def test_draw_of_odd_rows(spark, docs, items):
    more = [(100 + i, " ".join(f"w{(i * j) % 37}" for j in range(15 + i))) for i in range(30)] + [(None, "the hill " * 20), (101, "w1 w2 " * 20)]
    rows = [*ROWS, *more]
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in CLASHES})
    gain = resample.trained(frame, items)
    got = resample.rank(frame, gain)
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    want = drawn_by_force(rows, [(r["item_id"], r["text"]) for r in items.collect()])
    assert sorted(map(tuple, got.collect()), key=str) == want
    picked = resample.sample(frame, items)
    assert picked.columns == frame.columns
    assert sorted((str(r["doc_id"]), len(crcs(r["text"])[0]) * 2 - 1) for r in picked.collect()) == sorted((str(r[0]), r[1]) for r in want if r[4])
    assert resample.sample(frame, items, percent=100).count() == sum(len(crcs(t)[0]) >= 20 for _, t in rows)


def test_draw_from_nothing(spark, docs, items):
    none = docs.limit(0)
    assert resample.rank(none, resample.trained(none, items)).collect() == [] and resample.sample(none, items).collect() == []
    flat = resample.trained(docs, items.limit(0))
    assert flat.count() == resample.BUCKETS and resample.rank(docs, flat).count() == len(ROWS)


def test_draw_of_whole_tables(spark, small):
    got = queries.QUERIES["op13_resample"](spark, small).select("doc_id", "n_features", "weight", "score", "rank")
    docs, target = ([(r[i], r["text"]) for r in brute.rows(small, name)] for name, i in (("documents", "doc_id"), ("benchmark", "item_id")))
    assert sorted(map(tuple, got.collect()), key=str) == drawn_by_force(docs, target)
