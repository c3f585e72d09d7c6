"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j). The pairwise sum is taken in linear time as
half of |sum_i v_i x_i|^2 - sum_i |v_i x_i|^2. Inputs are the words of the whole text, hashed to WORDS
columns with logarithmic counts of unit length, and STATS statistics in columns of their own. Training is
AdaGrad on the log loss over a bounded sample: DOCS labelled documents of least id hash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .language import held_out
from .rules import SPACES, SYMBOLS, labelled_sample

WORDS = 1 << 13
RANK = 8
DOCS = 6000
EPOCHS = 12
BATCH = 256
RATE = 0.08
RIDGE = 1e-5
THRESHOLD = 0.3
STATS = 11


class _Columns(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word) % WORDS
        return h


def statistics(text: str, words: list[bytes], n_chars: float | None) -> list[float]:
    """Structure of the text and its metadata, each about 0 to 1."""
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    upper = sum(map(bytes.isupper, words))
    return [
        1.0,
        min(1.0, math.log1p(len(words)) / 10),
        min(1.0, sum(map(len, words)) / n / 12),
        min(1.0, sum(map(text.count, SYMBOLS)) / n),
        min(1.0, text.count("!") / n),
        upper / n,
        1 - len(set(words)) / n,
        sum(map(bytes.__eq__, words, words[1:])) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        min(1.0, sum(map(text.count, "0123456789")) / size * 4),
        min(1.0, math.log1p(max(0.0, n_chars)) / 12) if n_chars is not None else 0.0,
    ]


def inputs(text: str | None, n_chars: float | None, known: dict) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values of a text."""
    text = text or ""
    words = text.encode("utf-8", "surrogatepass").split()
    at = np.fromiter((known[w.lower()] for w in words), np.int64, len(words))
    cols, times = np.unique(at, return_counts=True)
    values = np.log1p(times)
    length = math.sqrt(float((values**2).sum())) or 1.0
    return np.concatenate([cols, np.arange(WORDS, WORDS + STATS)]), np.concatenate([values / length, statistics(text, words, n_chars)])


class Machine:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.b = 0.0
        self.w = np.zeros(WORDS + STATS)
        self.v = rng.normal(0, 0.02, (WORDS + STATS, RANK))

    def raw(self, cols: np.ndarray, values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores before the sigmoid, and the sums of v x of each row; rows begin at starts and are never empty."""
        vx = self.v[cols] * values[:, None]
        sums = np.add.reduceat(vx, starts)
        pairs = 0.5 * ((sums**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), starts))
        return self.b + np.add.reduceat(self.w[cols] * values, starts) + pairs, sums

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, epochs: int = EPOCHS, seed: int = 6) -> Machine:
        rng = np.random.default_rng(seed)
        gb, gw, gv = 1e-8, np.full(self.w.shape, 1e-8), np.full(self.v.shape, 1e-8)
        for _ in range(epochs if len(rows) else 0):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                sizes = np.array([len(rows[i][0]) for i in part])
                cols, values = (np.concatenate([rows[i][k] for i in part]) for k in (0, 1))
                starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                raw, sums = self.raw(cols, values, starts)
                g = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[part]) / len(part)
                each = np.repeat(g, sizes) * values
                dw = np.bincount(cols, each, len(self.w)) + RIDGE * self.w
                dv = RIDGE * self.v
                own = self.v[cols]
                spread = np.repeat(sums, sizes, axis=0)
                for f in range(RANK):
                    dv[:, f] += np.bincount(cols, each * (spread[:, f] - own[:, f] * values), len(self.w))
                db = float(g.sum())
                gb += db**2
                gw += dw**2
                gv += dv**2
                self.b -= RATE * db / math.sqrt(gb)
                self.w -= RATE * dw / np.sqrt(gw)
                self.v -= RATE * dv / np.sqrt(gv)
        return self


def _extractor():
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Columns()
        for batch in batches:
            rows = [inputs(t, c, known) for t, c in zip(batch.column("text").to_pylist(), batch.column("n_chars").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("quality"), pa.array([r[0] for r in rows], pa.list_(pa.int64())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["_id", "quality", "cols", "vals"])

    return run


def _metadata(docs: DataFrame, meta_col: str | None):
    return F.col(meta_col).cast("double") if meta_col in docs.columns else F.lit(None).cast("double")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", meta_col: str | None = "n_chars", docs_limit: int = DOCS) -> Machine:
    sample = labelled_sample(docs, labels, docs_limit, [F.col(text_col).alias("text"), _metadata(docs, meta_col).alias("n_chars")], id_col)
    sample = sample.withColumn("_id", F.col("_id").cast("string"))
    found = sample.mapInArrow(_extractor(), "_id string, quality int, cols array<bigint>, vals array<double>").orderBy("_id").toArrow()
    rows: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in found.to_batches():  # arrays of the driver, at most a number for each of the model's columns a row
        cuts = np.cumsum(batch.column("cols").value_lengths().to_numpy(zero_copy_only=False))[:-1]
        rows += zip(*(np.split(batch.column(c).flatten().to_numpy(zero_copy_only=False), cuts) for c in ("cols", "vals"))) if batch.num_rows else []
    return Machine().fit(rows, (found.column("quality").to_numpy() == 1).astype(float))


def _scorer(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = shared.value, _Columns()
        for batch in batches:
            scores: list[float] = []
            texts, meta = batch.column("text").to_pylist(), batch.column("n_chars").to_pylist()
            for at in range(0, len(texts), 64):
                rows = [inputs(t, c, known) for t, c in zip(texts[at : at + 64], meta[at : at + 64])]
                starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
                raw, _ = machine.raw(np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows]), starts)
                scores += (1 / (1 + np.exp(-np.clip(raw, -30, 30)))).tolist()
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(scores, pa.float64())], ["id", "held_out", "score"])

    return run


def score(docs: DataFrame, machine: Machine, id_col: str = "doc_id", text_col: str = "text", meta_col: str | None = "n_chars", threshold: float = THRESHOLD) -> DataFrame:
    """(id, held_out, score, predicted) of every row.

    A null text counts as empty and is scored by its statistics; missing metadata is 0. Rows that repeat
    are rows of their own. Without labels every score is a half. Other columns of docs are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"), _metadata(docs, meta_col).alias("n_chars"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(_scorer(shared), f"id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int")).withColumnRenamed("id", id_col)
