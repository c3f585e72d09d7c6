"""Ranked lexical search over document-sharded postings with integer impacts.

An index is a folder of shards. A shard holds a bounded part of the documents, sorted by id, and their postings as
compressed sparse rows: its terms, where the postings of each begin, and for each posting the document's place in the
shard and its impact. An impact is the part of a score that doesn't depend on the query: a saturated term frequency
by document length, precomputed as an integer. The weight of a term, from its document frequency in the corpus, is
applied when searching. Shards are built where documents are read, so texts are never shuffled, and a term that every
document has is spread over all shards.

A search takes its queries in blocks of bounded size. A task walks its shards; for each query it adds weight times impact
term by term to an array with an entry for each document of the shard, and selects the k best without sorting the rest. What
a task found in all of its shards is merged before it is sent on, so k rows a query and task are merged in the end.

Scores are 64-bit integers throughout; only a weight is computed in doubles.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Folder, Staged, byte_slices

#: Terms in Spark, before A-Z are lower-cased, and in UTF-8 bytes after.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")
TOP = 50
#: Postings after which a shard is closed; a longer document is a shard of its own.
SHARD_POSTINGS = 1 << 20
#: Bytes of texts of which words are held at a time.
SLICE = 1 << 20
#: Bytes of query terms that are searched for at once; more queries take a job a block.
BLOCK_BYTES = 2 << 20
#: Parts in which a query's rows are merged before the last merge.
MERGERS = 32
SHARD = "ids binary, known binary, terms binary, ends binary, starts binary, docs binary, impacts binary"


def terms_of(text: str | None) -> list[bytes]:
    return TERMS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def impacts_of(tf: np.ndarray, n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """floor(10^9 tf / (1000 tf + 20 m)), m growing from 50 with the length n of a document against the mean."""
    m = 50 + (50 * n * documents) // terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


class _Shard:
    """Postings of some documents on their way into a row of the index."""

    def __init__(self):
        self.ids, self.lengths, self.sizes = [], array("q"), array("q")
        self.vocabulary: dict[bytes, int] = {}
        self.terms, self.tf = array("q"), array("q")

    def add(self, doc_id: int | None, words: list[bytes]) -> None:
        counts = Counter(words)
        self.ids.append(doc_id)
        self.lengths.append(len(words))
        self.sizes.append(len(counts))
        known = self.vocabulary
        self.terms.extend([known.setdefault(w, len(known)) for w in counts])
        self.tf.extend(counts.values())

    def row(self, documents: int, terms: int) -> pa.RecordBatch:
        known = np.array([x is not None for x in self.ids], bool)
        ids = np.array([0 if x is None else x for x in self.ids], np.int64)
        by_id = np.lexsort((ids, ~known))
        place = np.empty(len(ids), np.int32)
        place[by_id] = np.arange(len(ids), dtype=np.int32)
        sizes = np.array(self.sizes, np.int64)
        docs = np.repeat(place, sizes)
        impacts = impacts_of(np.array(self.tf, np.int64), np.repeat(np.array(self.lengths, np.int64), sizes), documents, terms).astype(np.int32)
        names = list(self.vocabulary)
        sorted_terms = sorted(range(len(names)), key=names.__getitem__)
        number = np.empty(len(names), np.int64)
        number[sorted_terms] = np.arange(len(names))
        term = number[np.array(self.terms, np.int64)]
        order = np.lexsort((docs, term))
        starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(names)))]).astype(np.int64)
        names = [names[i] for i in sorted_terms]
        ends = np.cumsum([len(x) for x in names], dtype=np.int64)
        columns = (ids[by_id], known[by_id], None, ends, starts, docs[order], impacts[order])
        values = [b"".join(names) if c is None else c.tobytes() for c in columns]
        return pa.RecordBatch.from_arrays([pa.array([v], pa.binary()) for v in values], [c.split()[0] for c in SHARD.split(", ")])


def _builder(documents: int, terms: int, shard_postings: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = _Shard()
        for batch in byte_slices(batches, "text", SLICE):
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                words = terms_of(text)
                if not words:
                    continue
                shard.add(doc_id, words)
                if len(shard.terms) >= shard_postings:
                    yield shard.row(documents, terms)
                    shard = _Shard()
        if shard.ids:
            yield shard.row(documents, terms)

    return run


class Index:
    """The shards in a folder, with the documents that have terms and the number of all their terms."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.documents, self.terms = spark.read.schema("documents long, terms long").parquet(f"{path}/totals").head()
        self.shards = spark.read.schema(SHARD).parquet(f"{path}/shards")


def build(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", shard_postings: int = SHARD_POSTINGS) -> Index:
    """Writes the index of all rows of docs, which is read twice: for the totals, then for the shards.

    Texts without a term, null ones too, are not documents. Rows that repeat, id included, are documents of their
    own. Ids are integers or null. No rows give an index in which nothing is found. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    n = F.coalesce(F.regexp_count("text", F.lit(TERM)), F.lit(0)).cast("long")
    totals = rows.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms"))
    totals.coalesce(1).write.parquet(f"{path}/totals")
    documents, terms = docs.sparkSession.read.parquet(f"{path}/totals").select("documents", "terms").head()
    # terms are sorted and numbers small: they are worth more effort than the default codec makes
    rows.mapInArrow(_builder(documents, terms, shard_postings), SHARD).write.option("compression", "zstd").parquet(f"{path}/shards")
    return Index(docs.sparkSession, path)


class _Open:
    """A shard's row as arrays."""

    def __init__(self, row: dict):
        view = {k: np.frombuffer(v, kind) for k, v, kind in ((k, row[k], t) for k, t in _KINDS.items() if k in row)}
        self.__dict__.update(view)
        blob, at = row["terms"], 0
        self.place: dict[bytes, int] = {}
        for i, end in enumerate(self.ends.tolist()):
            self.place[blob[at:end]] = i
            at = end


_KINDS = {"ids": np.int64, "known": bool, "ends": np.int64, "starts": np.int64, "docs": np.int32, "impacts": np.int32}


def _frequencies(wanted):
    """(term, df): in how many documents of a task's shards each wanted term is."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, found = {t for _, terms in wanted.value for t in terms}, Counter()
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Open(batch.slice(i, 1).to_pylist()[0])
                for t in vocabulary & shard.place.keys():
                    at = shard.place[t]
                    found[t] += int(shard.starts[at + 1] - shard.starts[at])
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["term", "df"])

    return run


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores above 0, of equal ones the first; in no order."""
    some = np.flatnonzero(scores > 0)
    if len(some) <= k:
        return some
    least = np.partition(scores[some], len(some) - k)[len(some) - k]
    above = some[scores[some] > least]
    return np.concatenate([above, some[scores[some] == least][: k - len(above)]])


def _searcher(wanted, weights, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight, queries = weights.value, wanted.value
        found: dict[int, tuple] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                shard = _Open(batch.slice(i, 1).to_pylist()[0])
                spread = np.zeros(len(shard.ids), np.int64)
                for q, terms in queries:
                    spread[:] = 0
                    for t in terms:
                        at = shard.place.get(t)
                        if at is not None:
                            part = slice(shard.starts[at], shard.starts[at + 1])
                            spread[shard.docs[part]] += weight[t] * shard.impacts[part].astype(np.int64)
                    top = best(spread, k)
                    if len(top):
                        found[q] = _merged(found.get(q), (spread[top], shard.ids[top], shard.known[top]), k)
        if found:
            part = TaskContext.get().partitionId() % MERGERS
            yield _rows(found, part)

    return run


def _merged(old: tuple | None, new: tuple, k: int) -> tuple:
    """The k best (score, id, known) of both, by score, then id, a null id last."""
    score, ids, known = new if old is None else (np.concatenate(x) for x in zip(old, new))
    order = np.lexsort((ids, ~known, -score))[:k]
    return score[order], ids[order], known[order]


def _rows(found: dict[int, tuple], part: int) -> pa.RecordBatch:
    q = np.repeat(np.array(list(found), np.int64), [len(x[0]) for x in found.values()])
    score, ids, known = (np.concatenate(x) for x in zip(*found.values()))
    return pa.RecordBatch.from_arrays([pa.array(q), pa.array(np.full(len(q), part)), pa.array(ids, mask=~known), pa.array(score)], ["q", "part", "id", "score"])


def _blocks(queries: DataFrame, block_bytes: int) -> Iterator[list[tuple[int, list[bytes]]]]:
    """Numbered queries as distinct terms, in parts of bounded size, read one partition at a time."""
    part, size = [], 0
    for q, text in queries.toLocalIterator():
        terms = sorted(set(terms_of(text)))
        if terms:
            part.append((q, terms))
            size += sum(map(len, terms)) + 16 * len(terms)
        if size >= block_bytes:
            yield part
            part, size = [], 0
    if part:
        yield part


def _top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, query_id_col: str = "item_id", text_col: str = "text", id_col: str = "doc_id", k: int = TOP, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query id, rank, id, score): for each row of queries its k highest-scoring documents of the index.

    Scores are above 0; of equal ones the smaller id is ranked first, a null id last. A row without terms, with null text
    or with terms that no document has finds nothing. Rows that repeat an id are queries of their own, a null id is
    carried along. No queries give no rows. Other columns are not read.
    """
    spark = index.spark
    numbered = Staged(queries.select(F.monotonically_increasing_id().alias("q"), F.col(query_id_col).alias("item"), F.col(text_col).alias("text")), "queries").df
    parts = []
    for block in _blocks(numbered.select("q", "text"), block_bytes):
        wanted = spark.sparkContext.broadcast(block)
        # rows: the distinct terms of a block
        df = index.shards.select("terms", "ends", "starts").mapInArrow(_frequencies(wanted), "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))
        ratio = F.lit(2.0 * index.documents + 2.0) / (F.lit(2.0) * F.col("df") + F.lit(1.0))
        weights = {bytes(t): w for t, w in df.select("term", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long")).collect()}
        weighed = spark.sparkContext.broadcast(weights)
        found = index.shards.mapInArrow(_searcher(wanted, weighed, k), "q long, part long, id long, score long")
        parts.append(Staged(_top(_top(found, ["q", "part"], k), ["q"], k).select("q", "rank", "id", "score"), "found").df)
        wanted.destroy()
        weighed.destroy()
    empty = spark.createDataFrame([], "q long, rank int, id long, score long")
    found = reduce(DataFrame.unionByName, parts, empty) if parts else empty
    out = found.join(numbered.select("q", "item"), "q").select(F.col("item").alias(query_id_col), F.col("rank").cast("int").alias("rank"), F.col("id").alias(id_col), "score")
    return out


def rank(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", query_id_col: str = "item_id", query_text_col: str = "text", k: int = TOP) -> DataFrame:
    """search() over an index of docs that is built on the way and goes with the other staged tables."""
    index = build(docs, Folder(docs.sparkSession, "index").path, id_col, text_col)
    return search(index, queries, query_id_col, query_text_col, id_col, k)
