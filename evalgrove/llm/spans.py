"""Substring deduplication by sliding spans of sentences.

A span is a run of several consecutive sentences: SENTENCES or more of any length, or PIECES or more pieces with
at least WORDS words. Sentences end after . ! or ? before white space and at line ends. They are cut into
pieces after words whose hash says so, an eighth of all: a passage has the same cuts inside whatever stands before
or after it, pasted in mid-sentence or without stops, from the first such word on.

Every piece starts a span, extended until it has its words, and ends one that reaches back as far; every sentence
starts one of SENTENCES if that has fewer words. A run that repeats with at least as many is covered by those that
start or end within it, whole: a piece whose span forward leaves the run has its place in the one that ends with
the run. Spans are hashed with 96 bits and joined globally; of equal spans the first by (id, position) stays, and
pieces that any other one covers are removed.

A span that very many documents share is told to be no first one already where its batch of documents is read, for
all its places but the batch's first: the join sees one row of it for each batch.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged

SENTENCES = 3
PIECES = 2
WORDS = 20
LEAD = re.compile(r"\s*")
TOKEN = re.compile(r"\S+\s*")
#: Documents cut in one go.
ROWS = 500
#: Words that a worker remembers.
REMEMBERED = 200_000
_SEEN: dict[str, tuple[int, int]] = {}
#: What ends after a word: nothing, a piece, or a piece and a sentence.
GOES_ON, PIECE, SENTENCE = range(3)
#: The bases of the runs' two polynomial hashes modulo 2 ** 64, and what tells the words of the second apart.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
OTHER = 0xC2B2AE3D27D4EB4F


def _token(token: str) -> tuple[int, int]:
    """Hash of a word, and what ends after it and its white space."""
    word = token.rstrip()
    h = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
    gap = token[len(word) :]
    if len(_SEEN) >= REMEMBERED:
        _SEEN.clear()
    _SEEN[token] = found = (h, SENTENCE if gap and (word[-1] in ".!?" or "\n" in gap) else PIECE if h % 8 == 0 else GOES_ON)
    return found


def _cut(text: str | None) -> tuple[list[str], list[int], list[bool], np.ndarray]:
    """Tokens that joined are the text, where each piece ends in them and whether a sentence does, and hashes of the tokens' words."""
    lead = LEAD.match(text or "").group()
    tokens = TOKEN.findall(text or "", len(lead))
    seen = [_SEEN.get(t) or _token(t) for t in tokens]
    hashes = np.array([h for h, _ in seen], np.uint64)
    ends = [i + 1 for i, (_, what) in enumerate(seen) if what]
    whole = [what == SENTENCE for _, what in seen if what]
    if tokens and (not ends or ends[-1] < len(tokens)):
        ends.append(len(tokens))
        whole.append(True)
    elif tokens:
        whole[-1] = True
    if lead and (not tokens or "\n" in lead):  # a sentence without words
        return [lead, *tokens], [1, *(e + 1 for e in ends)], [True, *whole], np.append(np.ones(1, np.uint64), hashes)
    if lead:
        tokens[0] = lead + tokens[0]
    return tokens, ends, whole, hashes


def pieces(text: str | None) -> list[str]:
    """The text cut into pieces with the white space after them; joined they are the text."""
    tokens, ends, _, _ = _cut(text)
    return ["".join(tokens[s:e]) for s, e in zip([0, *ends], ends)]


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out)


def spans(text: str | None, sentences: int | None = SENTENCES, least: int = PIECES, words: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes of 64 and 32 bits, first piece and piece after the last of each span, and the number of pieces."""
    tokens, ends, whole, hashes = _cut(text)
    stops = np.array([0, *ends], np.int64)
    blank = int(len(tokens) > 0 and not tokens[0].strip())
    held = np.maximum(stops - blank, 0)  # words before each piece
    every = np.arange(len(stops))
    forward = np.maximum(np.searchsorted(held, held + words, "left"), every + least)
    back = np.minimum(np.searchsorted(held, held - words, "right") - 1, every - least)
    bounds = np.append(0, np.flatnonzero(whole) + 1)[blank:]  # pieces that begin a sentence, and the end
    sentences = len(bounds) if sentences is None else sentences
    from_, to = bounds[: max(0, len(bounds) - sentences)], bounds[sentences:]
    short = held[to] - held[from_] < words
    s = np.concatenate([every[forward < len(stops)], back[back >= 0], from_[short]])
    e = np.concatenate([forward[forward < len(stops)], every[back >= 0], to[short]])
    s, e = np.divmod(np.unique(s * len(stops) + e), len(stops))
    found = []
    for base, salt in zip(BASES, (0, OTHER)):
        values = hashes if not salt else (hashes ^ (hashes >> np.uint64(32))) * np.uint64(salt)
        before = np.append(np.zeros(1, np.uint64), np.cumsum(values * _powers(base, len(hashes))[:-1]))
        found.append((before[stops[e]] - before[stops[s]]) * _powers(pow(base, -1, 1 << 64), len(hashes))[stops[s]])
    return found[0].view(np.int64), (found[1] >> np.uint64(32)).astype(np.uint32).view(np.int32), s.astype(np.int32), e.astype(np.int32), len(ends)


def _again(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Whether each span equals an earlier one; spans come in order of (id, position)."""
    order = np.argsort(h, kind="stable")
    first = np.append(True, h[order][1:] != h[order][:-1])
    head = np.empty(len(h), np.int64)
    head[order] = order[np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))] if len(h) else 0
    return (head != np.arange(len(h))) & (g[head] == g)


def _spanner(sentences: int | None, least: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("id").to_numpy()
            order = np.argsort(ids, kind="stable")
            columns: list[list[np.ndarray]] = [[], [], [], []]
            sizes, number = [], []
            for at in range(0, len(order), ROWS):
                for text in batch.column("text").take(pa.array(order[at : at + ROWS])).to_pylist():
                    *found, n = spans(text, sentences, least, words)
                    for column, x in zip(columns, found):
                        column.append(x)
                    sizes.append(len(found[0]))
                    number.append(n)
            if not sizes:
                continue
            h, g, s, e = map(np.concatenate, columns)
            of = np.repeat(ids[order], sizes)
            again = _again(h, g)
            # rows that repeat an id are one document: an equal place is the same place
            same = np.flatnonzero(np.append(False, of[1:] == of[:-1]) & again) if len(set(ids.tolist())) < len(ids) else ()
            if len(same):
                first = {}
                for i in range(len(h)):
                    key = (int(h[i]), int(g[i]))
                    place = first.setdefault(key, (int(of[i]), int(s[i])))
                    again[i] = place != (int(of[i]), int(s[i]))
            # those need no join: they are dealt evenly, and so is each document's number of pieces
            spread = of * np.int64(0x5851F42D4C957F2D) + s
            h, g = np.where(again, spread, h), np.where(again, 0, g).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (of, h, g, s, e, again)], ["id", "h", "g", "s", "e", "again"])
            n = len(order)
            rows = (ids[order], ids[order], np.zeros(n, np.int32), np.full(n, -1, np.int32), np.array(number, np.int32), np.ones(n, bool))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in rows], ["id", "h", "g", "s", "e", "again"])

    return run


def _cutter(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, gone, kept, short = [], [], [], []
            for text, covered in zip(batch.column("text").to_pylist(), batch.column("covered").to_pylist()):
                number = {x["e"] for x in covered or () if x["s"] < 0}
                if all(x["s"] < 0 for x in covered or ()) and len(number) == 1:
                    n.append(number.pop()), gone.append(0), kept.append(text), short.append(0)
                    continue
                tokens, ends, _, _ = _cut(text)
                stops = [0, *ends]
                blank = int(len(tokens) > 0 and not tokens[0].strip())
                held = [max(at - blank, 0) for at in stops]  # words before each piece
                bad: set[int] = set()
                passages: set[int] = set()  # pieces that runs of enough words cover
                for x in covered or ():
                    if x["s"] >= 0:
                        bad.update(range(x["s"], x["e"]))
                        if held[min(x["e"], len(ends))] - held[min(x["s"], len(ends))] >= words:
                            passages.update(range(x["s"], x["e"]))
                n.append(len(ends))
                gone.append(len(bad))
                short.append(len(bad) - len(passages))
                kept.append("".join("".join(tokens[i:j]) for at, (i, j) in enumerate(zip(stops, ends)) if at not in bad) if text is not None else None)
            columns = [batch.column("id"), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string()), pa.array(short, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "n_pieces", "n_removed", "kept_text", "n_short"])

    return run


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: int | None = SENTENCES, least: int = PIECES, words: int = WORDS) -> DataFrame:
    """(id, n_pieces, n_removed, kept_text, n_short) of every row; n_removed counts pieces, n_short those that only runs of fewer words cover.

    Without a number of sentences only runs of at least words words count, so that license lines and the like stay.
    A span that comes again in its own text is not first either. A text of fewer sentences and words than a
    span has none and stays whole; a null text stays null. Rows that repeat an id are one document: equal
    ones both keep what the first would keep. Rows without an id are never the first and are not cut.
    Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    found = rows.where("id is not null").mapInArrow(_spanner(sentences, least, words), "id long, h long, g int, s int, e int, again boolean")
    # one exchange by hash: a rank over it takes half the shuffle of a grouping that is joined back
    order = Window.partitionBy("h", "g", "again").orderBy("id", "s")
    told = found.withColumn("nth", F.rank().over(order)).where("nth > 1 or again")
    covered = told.groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("s", "e")).alias("covered"))
    cut = rows.join(Staged(covered, "covered").df, F.col("id") == F.col("of"), "left").select("id", "text", "covered")
    return cut.mapInArrow(_cutter(words), "id long, n_pieces long, n_removed long, kept_text string, n_short long").withColumnRenamed("id", id_col)
