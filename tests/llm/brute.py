"""Plain single-process versions of the corpus operators' results, written from their contracts."""

from __future__ import annotations

import base64
import bisect
import hashlib
import math
import re
from collections import defaultdict

import pyarrow.parquet as pq
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def rows(sf_dir: str, name: str) -> list[dict]:
    return pq.read_table(f"{sf_dir}/{name}.parquet").to_pylist()


def low(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def target_words(docs, weights=(5, 2, 1), most=3.0):
    size = defaultdict(int)
    for d in docs:
        size[d["source"]] += len(WORD.findall(d["text"] or ""))
    names = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, free, rest = {}, set(names), float(sum(size.values()))
    while free:
        total = sum(weight[s] for s in free)
        over = {s for s in free if rest * weight[s] / total > most * size[s]}
        if not over:
            target |= {s: rest * weight[s] / total for s in free}
            break
        for s in over:
            target[s] = most * size[s]
        rest -= sum(target[s] for s in over)
        free -= over
    return size, target


def near(docs, k, percent):
    sets = {}
    for d in docs:
        w = WORD.findall(low(d["text"] or ""))
        sets[d["doc_id"]] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = [d for d in sorted(sets) if sets[d]]
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                continue
            both = len(x & y)
            if 100 * both >= percent * (len(x) + len(y) - both):
                r, s = sorted((find(a), find(b)))
                parent[s] = r
    return {d: (len(sets[d]), find(d)) for d in sets}


ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(s, e, k) for s, _, e, k in sorted(found)]


def warc(pages):
    body = {p["page_id"]: (p["html"] or "").encode() for p in pages}
    first: dict[bytes, int] = {}
    for i in sorted(body):
        first.setdefault(body[i], i)
    return {i: (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first[b] == i else "revisit", None if first[b] == i else first[b]) for i, b in body.items()}


BENCH_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def leaks(docs, items, window=10):
    wins = defaultdict(set)
    for it in items:
        w = BENCH_WORD.findall(low(it["text"] or ""))
        for i in range(max(1, len(w) - window + 1)) if w else ():
            wins[tuple(w[i : i + window])].add(str(it["item_id"]))
    out = {}
    for d in docs:
        w = BENCH_WORD.findall(low(d["text"] or ""))
        hit, who = set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if (x := wins.get(tuple(w[i : i + n]))):
                    hit.update(range(i, i + n))
                    who |= x
        out[d["doc_id"]] = (len(w), len(hit), len(who), sha(",".join(sorted(who))))
    return out


def repeats(docs, size=50):
    """Per document: bytes, removed bytes, removed runs, digest of the rest."""
    first: dict[bytes, int] = {}
    data = {d["doc_id"]: (d["text"] or "").encode() for d in docs}
    for i in sorted(data):
        for k in range(len(data[i]) - size + 1):
            first.setdefault(data[i][k : k + size], i)
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if first[b[k : k + size]] < i:
                gone[k : k + size] = b"\x01" * size
        marks = bytes(gone)
        kept = bytes(c for c, g in zip(b, marks) if not g)
        out[i] = (len(b), sum(marks), len(re.findall(b"\x01+", marks)), hashlib.sha256(kept).hexdigest())
    return out


def quality_counts(text):
    text = text or ""
    words = WORD.findall(text)
    wins = defaultdict(list)
    for i in range(len(words) - 7):
        wins[tuple(words[i : i + 8])].append(i)
    hit = {j for at in wins.values() if len(at) > 1 for i in at for j in range(i, i + 8)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


def pieces(text):
    """(piece, whether a sentence ends with it) by plain scanning: stops, line ends and every eighth word by its hash."""
    out, at, held = [], 0, ""
    words = list(re.finditer(r"\S+", text or ""))
    if text and (not words or "\n" in text[: words[0].start()]):
        out.append((text[: words[0].start()] if words else text, True))
        at = len(out[0][0])
    for k, m in enumerate(words):
        end = words[k + 1].start() if k + 1 < len(words) else len(text)
        gap = text[m.end() : end]
        held += text[at:end]
        at = end
        stop = bool(gap) and (m[0].endswith((".", "!", "?")) or "\n" in gap) or k + 1 == len(words)
        if stop or xxhash.xxh3_64_intdigest(m[0].encode()) % 8 == 0:
            out.append((held, stop))
            held = ""
    return out


def spans_removed(docs, sentences=3, least=2, words=20):
    """Pieces of each document that a non-first repeated run covers, over all runs that are long enough."""
    first, runs = {}, []
    for d, text in sorted(docs):
        parts = pieces(text)
        for i in range(len(parts)):
            h, n, whole = xxhash.xxh3_128(), 0, 0
            starts = i == 0 or parts[i - 1][1]
            for e in range(i, len(parts)):
                own = parts[e][0].split()
                h.update("".join(w + " " for w in own))
                n += len(own)
                whole += parts[e][1]
                if e + 1 - i >= least and n >= words or starts and parts[e][1] and whole >= sentences and parts[i][0].strip():
                    key = h.digest()
                    first.setdefault(key, (d, i))
                    runs.append((key, d, i, e + 1))
    gone = {d: set() for d, _ in docs}
    for key, d, i, e in runs:
        if first[key] != (d, i):
            gone[d].update(range(i, e))
    return {d: len(g) for d, g in gone.items()}


class Parser:
    """Greedy longest-match parsing against a sample, by bisection in its sorted suffixes."""

    def __init__(self, texts):
        self.source = "".join(t.lower() + "\n" for t in texts)
        self.starts = sorted(range(len(self.source)), key=lambda i: self.source[i : i + 400])

    def longest(self, text, at):
        """Length of the longest prefix of text[at:] that occurs in the sample; the suffix next to it in order has it."""
        piece = text[at : at + 400]
        place = bisect.bisect_left(self.starts, piece, key=lambda i: self.source[i : i + 400])
        best = 0
        for i in self.starts[max(0, place - 1) : place + 1]:
            n = 0
            while at + n < len(text) and i + n < len(self.source) and text[at + n] == self.source[i + n]:
                n += 1
            best = max(best, n)
        return best

    def phrases(self, text):
        text, at, n = text.lower(), 0, 0
        while at < len(text):
            at += max(1, self.longest(text, at))
            n += 1
        return n


def languages(docs, samples):
    """Per document: predicted language and score."""
    parsers = {lang: Parser(samples[lang]) for lang in sorted(samples)}
    out = {}
    for d in docs:
        text = d["text"] or ""
        if not any(c.isalpha() for c in text):
            out[d["doc_id"]] = ("und", 0.0)
            continue
        cost = {lang: p.phrases(text) * math.log2(max(2, len(p.source))) / len(text.lower()) for lang, p in parsers.items()}
        best = min(cost, key=cost.get)
        out[d["doc_id"]] = (best, 1 / sum(2 ** (-2 * (c - cost[best])) for c in cost.values()))
    return out
