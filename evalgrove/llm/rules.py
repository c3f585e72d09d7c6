"""Quality rules: plain counts, and a linear-chain conditional random field over a text's lines.

The field labels each line content or boilerplate; Viterbi decoding finds the likeliest sequence, and the
share of words in content lines decides whether a text stays. Line weights and the rewards for staying in either
state are trained together, by the gradient of the sequences' likelihood, which the forward-backward sums give.
A training sequence is a labelled document's lines, in runs of at most SEQUENCE. A line that several labelled documents
hold takes the label that most of them have, any other one its document's, so labels change within a document where
clean lines stand among bad ones. The sample is bounded: DOCS documents of least id hash, and of each at most RUNS runs,
evenly spaced from its beginning to its end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .language import held_out

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A text stays if at least this share of its words stands in content lines.
MIN_CONTENT = 0.5
#: Labelled documents learned from.
DOCS = 4000
FEATURES = 10
#: Lines of a training sequence, and sequences of one document; steps, rate and ridge of the training.
SEQUENCE = 64
RUNS = 4
STEPS = 120
RATE = 0.1
RIDGE = 1e-4


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def repeated_words(words: list[bytes], known: dict, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    total = np.zeros(n, np.uint64)
    for i in range(window):
        total = (total ^ (total >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + h[i : n + i]
    _, inverse, counts = np.unique(total, return_inverse=True, return_counts=True)
    starts = np.flatnonzero(counts[inverse] > 1)
    edge = np.zeros(len(words) + 1, np.int64)
    edge[starts] += 1
    edge[starts + window] -= 1
    return int((np.cumsum(edge) > 0).sum())


def counts(text: str, known: dict) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(SPACES):
            seen.add(line)
    return len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)), dup, repeated_words(words, known)


def line_features(line: str, again: bool) -> tuple[list[float], int]:
    """Features of a line and its number of words. again: it equals an earlier line."""
    words = line.split()
    n, size = len(words), len(line)
    if not n:
        return [0.0] * FEATURES, 0
    letters = sum(map(len, words))
    odd = sum(map(line.count, SYMBOLS)) + line.count("!")
    upper = sum(map(str.isupper, words))
    runs = sum(map(str.__eq__, words, words[1:]))
    return [
        1.0,
        min(n, 60) / 60,
        min(letters / n, 20) / 10,
        odd / n if odd < n else 1.0,
        upper / n,
        1 - len(set(words)) / n,
        runs / n,
        float(line.rstrip()[-1:] in ".!?…\"”»)"),
        sum(map(str.isdecimal, line)) / size,
        float(again),
    ], n


def lines_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Features and words of all lines that have a word."""
    seen, rows, words = set(), [], []
    for line in text.split("\n"):
        f, n = line_features(line, line in seen)
        if n:
            seen.add(line)
            rows.append(f)
            words.append(n)
    return np.array(rows, float).reshape(len(rows), FEATURES), np.array(words, int)


class Field:
    """Weights of the features towards content, and the rewards of two lines in a row being both boilerplate or both content."""

    def __init__(self, weights: np.ndarray | None = None, stay: tuple[float, float] = (0.0, 0.0)):
        self.weights = np.zeros(FEATURES) if weights is None else weights
        self.stay = stay


def viterbi(content: np.ndarray, stay: tuple[float, float]) -> np.ndarray:
    """Labels of the likeliest sequence: True for content. content: log odds of each line being content.

    Only differences matter: d is the best score of ending in content less that of ending in boilerplate. A
    step moves it to max(d + stay[1], 0) - max(d, stay[0]) + odds; the maxima say where the best paths come from.
    """
    n = len(content)
    low, high = stay
    d = np.empty(n)
    now = 0.0
    for i, x in enumerate(content.tolist()):
        now = max(now + high, 0.0) - max(now, low) + x if i else x
        d[i] = now
    out = np.empty(n, bool)
    label = bool(n and d[-1] >= 0)
    for i in range(n - 1, -1, -1):
        out[i] = label
        if i:
            label = d[i - 1] + high >= 0 if label else d[i - 1] > low
    return out


def content_share(text: str, field: Field) -> float:
    """Share of words in content lines; 0 for a text without words."""
    rows, words = lines_of(text)
    if not len(words):
        return 0.0
    return float(words[viterbi(rows @ field.weights, field.stay)].sum() / words.sum())


def gradient(odds: np.ndarray, good: np.ndarray, real: np.ndarray, stay: tuple[float, float]) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood of the labels, its gradient by each line's odds and by the two rewards.

    Arrays are (sequence, place); real marks the places that hold a line, which come first.
    """
    n, length = odds.shape
    low, high = stay
    ahead, total = np.zeros((length, n, 2)), np.zeros((n, 2))
    a = np.stack([np.zeros(n), odds[:, 0]], axis=1)
    ahead[0] = a
    for t in range(1, length):
        step = np.stack([np.logaddexp(a[:, 0] + low, a[:, 1]), np.logaddexp(a[:, 0], a[:, 1] + high) + odds[:, t]], axis=1)
        a = np.where(real[:, t, None], step, a)
        ahead[t] = a
    norm = np.logaddexp(a[:, 0], a[:, 1])
    by_line, by_stay = np.zeros((n, length)), np.zeros(2)
    b = np.zeros((n, 2))
    score = -float(norm.sum()) + float((odds * (good & real)).sum())
    for t in range(length - 1, -1, -1):
        by_line[:, t] = np.where(real[:, t], good[:, t] - np.exp(ahead[t][:, 1] + b[:, 1] - norm), 0.0)
        if t:
            both = real[:, t]
            here = b + np.stack([np.zeros(n), odds[:, t]], axis=1)
            before = ahead[t - 1]
            for k, reward in enumerate(stay):
                seen = both & (good[:, t] == k) & (good[:, t - 1] == k)
                score += reward * int(seen.sum())
                by_stay[k] += seen.sum() - np.where(both, np.exp(before[:, k] + reward + here[:, k] - norm), 0.0).sum()
            step = np.stack([np.logaddexp(here[:, 0] + low, here[:, 1]), np.logaddexp(here[:, 0], here[:, 1] + high)], axis=1)
            b = np.where(both[:, None], step, b)
    return score, by_line, by_stay


def line_labels(lines: np.ndarray, of: np.ndarray, good: np.ndarray) -> np.ndarray:
    """Labels of lines, given as hashes, with their documents and these documents' labels.

    A line takes the label of most documents that hold it, each counted once. Where as many say the one as the
    other, as for a line of one document, it keeps its own document's.
    """
    _, line = np.unique(lines, return_inverse=True)
    once = np.unique(np.stack([line, of], axis=1), axis=0, return_index=True)[1]
    votes = np.bincount(line[once], np.where(good[once], 1, -1), minlength=len(lines))[line]
    return np.where(votes == 0, good, votes > 0)


def fit(rows: np.ndarray, good: np.ndarray, sizes: np.ndarray, steps: int = STEPS) -> Field:
    """The field of greatest likelihood of the lines' labels, less a ridge; both classes' lines count as they come.

    sizes: lines of each sequence, one after another. Sequences of like size are laid out side by side.
    """
    if not len(rows) or good.all() or not good.any():
        return Field()
    starts, laid = np.cumsum(sizes) - sizes, []
    size = np.maximum(1, 2 ** np.ceil(np.log2(sizes)).astype(int))
    for length in np.unique(size).tolist():
        some = np.flatnonzero(size == length)
        real = np.arange(length) < sizes[some, None]
        place = (starts[some, None] + np.arange(length))[real]
        x, y = np.zeros((*real.shape, rows.shape[1])), np.zeros(real.shape, bool)
        x[real], y[real] = rows[place], good[place]
        laid.append((x, y, real))
    at = np.zeros(rows.shape[1] + 2)
    mean, power = np.zeros_like(at), np.zeros_like(at)
    for step in range(1, steps + 1):  # Adam on the mean log likelihood
        g = -RIDGE * at
        for x, y, real in laid:
            _, by_line, by_stay = gradient(x @ at[:-2], y, real, (at[-2], at[-1]))
            g += np.append(np.tensordot(by_line, x, 2), by_stay) / len(rows)
        mean, power = 0.9 * mean + 0.1 * g, 0.999 * power + 0.001 * g**2
        at += RATE * mean / (1 - 0.9**step) / (np.sqrt(power / (1 - 0.999**step)) + 1e-8)
    return Field(at[:-2].copy(), (float(at[-2]), float(at[-1])))


def _sampler(runs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.float64())
        for batch in batches:
            ids, labels, hashes, lines = [], [], [], []
            for key, label, text in zip(*(batch.column(c).to_pylist() for c in ("_id", "quality", "text"))):
                rows, _ = lines_of(text or "")
                known = [xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) for line in (text or "").split("\n") if line.strip(SPACES)]
                known = np.array(known, np.uint64).view(np.int64)
                number = min(runs, -(-len(rows) // SEQUENCE))
                for at in np.linspace(0, max(0, len(rows) - SEQUENCE), number).astype(int).tolist():
                    ids.append(key), labels.append(label)
                    hashes.append(known[at : at + SEQUENCE])
                    lines.append(rows[at : at + SEQUENCE].ravel())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(labels, pa.int32()), pa.array(hashes, pa.list_(pa.int64())), pa.array(lines, kind)], ["_id", "quality", "hashes", "lines"])

    return run


def labelled_sample(docs: DataFrame, labels: DataFrame, limit: int, columns: list[Column], id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """At most limit labelled rows that aren't held out, of least id hash, with label and columns of docs.

    Conflicting labels of one id: the least counts. Of rows that repeat an id, the one of least columns.
    """
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("_id")).agg(F.min(label_col).cast("int").alias("quality")).orderBy(F.xxhash64("_id"), "_id").limit(limit)
    rows = docs.select(F.col(id_col).alias("_row"), *columns).join(F.broadcast(known), F.col("_row") == F.col("_id"))
    one = Window.partitionBy("_id").orderBy(*[c for c in rows.columns if c not in ("_row", "_id", "quality")])
    return rows.withColumn("_nth", F.row_number().over(one)).where("_nth = 1").drop("_row", "_nth")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", docs_limit: int = DOCS, runs: int = RUNS) -> Field:
    """A field learned from at most docs_limit labelled documents and runs * SEQUENCE lines of each."""
    sample = labelled_sample(docs, labels, docs_limit, [F.col(text_col).alias("text")], id_col).select(F.col("_id").cast("string").alias("_id"), "quality", "text")
    found = sample.mapInArrow(_sampler(runs), "_id string, quality int, hashes array<long>, lines array<double>").toPandas()
    if not len(found):
        return Field()
    found = found.iloc[np.lexsort((found["_id"], [xxhash.xxh3_64_intdigest(i) for i in found["_id"]]))]
    sizes = found["hashes"].map(len).to_numpy()
    rows = np.concatenate(found["lines"].to_list()).reshape(-1, FEATURES)
    _, of = np.unique(found["_id"], return_inverse=True)
    good = line_labels(np.concatenate(found["hashes"].to_list()), np.repeat(of, sizes), np.repeat(found["quality"].to_numpy() == 1, sizes))
    return fit(rows, good, sizes)


def _judge(field: Field):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            out = [(*counts(t or "", known), content_share(t or "", field)) for t in batch.column("text").to_pylist()]
            columns = list(zip(*out)) or [()] * 6
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.float64())], ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "content"])

    return run


def judge(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text", min_content: float = MIN_CONTENT) -> DataFrame:
    """(id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, content, base_failed, kept) of every row.

    A null text counts as empty: no words, base_failed, not kept. Rows that repeat are rows of their own.
    Without labelled lines of both kinds the weights are 0 and every line is content. Other columns of
    docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_judge(field), f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, content double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~F.col("base_failed") & (F.col("content") >= min_content)).withColumnRenamed("id", id_col)
