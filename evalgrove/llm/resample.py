"""Target-distribution importance resampling: documents drawn by how much more their n-grams belong to a target.

Features are the runs of one and two consecutive words, hashed into buckets by CRC-32. The logarithm of a bucket's
share in the target over its share in the corpus is its gain, the mean gain of a document its weight, and the
documents of the highest weight plus Gumbel noise are a sample without replacement by weight.

Hashing works on the UTF-8 buffer of a whole Arrow batch at once. A table of 256 entries turns each byte into its
lower case, or 0 where it belongs to no word; words begin and end where that differs from its neighbour, or where
texts meet. The CRCs of all words then advance together, a byte a step, over those words that have the byte; a pair
goes on from the CRC of its first word. Memory is a multiple of SLICE, whatever the length of a text: longer ones
are taken in pieces that end between words and begin with the last word of the piece before.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged, byte_slices

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 25
SEED = 7
#: Bytes of texts that are hashed at once.
SLICE = 1 << 20
#: Bytes of a word up to which all words advance together; the few longer ones are finished one by one.
STEPS = 64

#: Lower case of the bytes of words, which are 0-9, A-Z, a-z and all of characters beyond ASCII; 0 for the others.
CLASS = np.array([b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 0 for b in range(256)], np.uint8)
_GAP = re.compile(rb"[^0-9A-Za-z\x80-\xff]")


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table


CRC = _crc_table()


def _step(state: np.ndarray, byte) -> np.ndarray:
    return CRC[(state ^ byte) & 0xFF] ^ (state >> 8)


def advance(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC registers after each of them has read the bytes from its start on."""
    order = np.argsort(-lengths, kind="stable")
    at, size, now = starts[order], lengths[order], state[order]
    steps = int(size[0]) if len(size) else 0
    live = np.searchsorted(-size, -np.arange(min(steps, STEPS)), "left")
    for k, m in enumerate(live):
        now[:m] = _step(now[:m], data[at[:m] + k])
    for i in range(int(np.searchsorted(-size, -STEPS, "left"))):
        rest = data[at[i] + STEPS : at[i] + size[i]].tobytes()
        now[i] = zlib.crc32(rest, int(now[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(now)
    out[order] = now
    return out


def hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text of each word, CRC of each word, text of each pair, CRC of each pair) of texts that lie end to end."""
    low = CLASS[data]
    word = low != 0
    edge = np.diff(word.view(np.int8), prepend=0, append=0)
    inner = np.unique(offsets[(offsets > 0) & (offsets < len(data))])
    joints = inner[word[inner - 1] & word[inner]]
    starts = np.sort(np.concatenate([np.flatnonzero(edge == 1), joints]))
    lengths = np.sort(np.concatenate([np.flatnonzero(edge == -1), joints])) - starts
    text = np.searchsorted(offsets, starts, "right") - 1
    first = advance(low, starts, lengths, np.full(len(starts), 0xFFFFFFFF, np.uint32))
    pairs = np.flatnonzero(text[1:] == text[:-1])
    second = advance(low, starts[pairs + 1], lengths[pairs + 1], _step(first[pairs], np.uint32(32)))
    return text, ~first, text[pairs], ~second


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of strings; nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return data, ends - ends[0]


def _pieces(data: bytes, limit: int) -> Iterator[tuple[int, int, bool]]:
    """(start, end, whether the first word was in the piece before) of the pieces of one text."""
    start = done = 0
    while done < len(data):
        gap = _GAP.search(data, min(done + limit, len(data)))
        end = gap.start() if gap else len(data)
        yield start, end, start < done
        last = end
        while last > start and CLASS[data[last - 1]] == 0:
            last -= 1
        if last == start:  # no word in it
            start = done = end
            continue
        while last > start and CLASS[data[last - 1]] != 0:
            last -= 1
        start, done = last, end


def features(column: pa.Array, limit: int = SLICE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """hashes() of all texts of a column, in parts of bounded size; every word and pair comes once."""
    data, offsets = _buffers(column)
    if len(column) > 1 or len(data) <= limit:
        yield hashes(data, offsets)
        return
    for start, end, seen in _pieces(data.tobytes(), limit):
        text, one, pair, two = hashes(data[start:end], np.array([0, end - start]))
        yield text[int(seen) :], one[int(seen) :], pair, two


def _counter(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(buckets, np.int64)
        for batch in byte_slices(batches, "text", SLICE):
            for _, one, _, two in features(batch.column("text")):
                for crc in (one, two):
                    count += np.bincount(crc % buckets, minlength=buckets)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], ["bucket", "n"])

    return run


def bucket_counts(docs: DataFrame, text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts, repeats counted, at most a row a bucket from each task."""
    return docs.select(F.col(text_col).alias("text")).mapInArrow(_counter(buckets), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket: floor of 1000 times the logarithm of smoothed shares in target over corpus."""
    both = corpus.select("bucket", F.col("n").alias("s"), F.lit(0).cast("long").alias("t"))
    both = both.unionByName(target.select("bucket", F.lit(0).cast("long").alias("s"), F.col("n").alias("t")))
    every = both.sparkSession.range(buckets).select(F.col("id").alias("bucket"), F.lit(0).cast("long").alias("s"), F.lit(0).cast("long").alias("t"))
    total = both.agg(F.coalesce(F.sum("s"), F.lit(0)).alias("all_s"), F.coalesce(F.sum("t"), F.lit(0)).alias("all_t"))
    rows = both.unionByName(every).groupBy("bucket").agg(F.sum("s").alias("s"), F.sum("t").alias("t")).join(F.broadcast(total))
    one = {c: F.col(c).cast("double") for c in ("s", "t", "all_s", "all_t")}
    ratio = (one["t"] + 1) * (one["all_s"] + buckets) / ((one["s"] + 1) * (one["all_t"] + buckets))
    return rows.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def _weigher(gain: np.ndarray, text_col: str, names: tuple[str, str, str]):
    buckets = len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, text_col, SLICE):
            rows = batch.num_rows
            words, pairs, total = (np.zeros(rows, np.int64) for _ in range(3))
            for text, one, pair, two in features(batch.column(text_col)):
                words += np.bincount(text, minlength=rows)
                pairs += np.bincount(pair, minlength=rows)
                for owner, crc in ((text, one), (pair, two)):
                    np.add.at(total, owner, gain[crc % buckets])
            n = words + pairs
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (words, n, weight))], [*batch.schema.names, *names])

    return run


def weigh(docs: DataFrame, gain: DataFrame, text_col: str = "text", names: tuple[str, str, str] = ("n_words", "n_features", "weight"), buckets: int = BUCKETS) -> DataFrame:
    """docs with the words, features and weight of each text under three new names; nothing is shuffled.

    gain has a row a bucket and goes along with the tasks, 8 bytes a bucket.
    """
    table = np.zeros(buckets, np.int64)
    for bucket, value in gain.collect():
        table[bucket] = value
    schema = ", ".join([*(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema), *(f"`{n}` long" for n in names)])
    return docs.mapInArrow(_weigher(table, text_col, names), schema)


def noisy(doc_id: Column, weight: Column, seed: int = SEED) -> Column:
    """Weight plus 1000 times Gumbel noise that is the same in every run; a null id has noise of its own."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return (weight + F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))).cast("long")


def trained(docs: DataFrame, target: DataFrame, text_col: str = "text", target_text_col: str = "text", buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) from a pass over docs and one over target, written."""
    return Staged(gains(bucket_counts(docs, text_col, buckets), bucket_counts(target, target_text_col, buckets), buckets), "gains").df


def rank(docs: DataFrame, gain: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row of docs; rank is null for rows that are not drawn.

    Of the rows with min_words or more so many percent of the highest scores are drawn, ties by the smaller id, a null
    id last. Rows that repeat an id are rows of their own. A null or wordless text has no features and weight 0.
    No rows give no rows; an empty target or corpus leaves all gains to the smoothing. Other columns are not read.

    Ranks come from one range exchange of narrow rows and the row counts of its partitions.
    """
    rows = weigh(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), gain, buckets=buckets)
    rows = Staged(rows.select("id", "n_words", "n_features", "weight", noisy(F.col("id"), F.col("weight"), seed).alias("score")), "scores").df
    long_enough = rows.where(F.col("n_words") >= min_words)
    order = [F.desc("score"), F.asc_nulls_last("id"), F.asc("n_features"), F.asc("weight")]
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = long_enough.repartitionByRange(n, *order).sortWithinPartitions(*order)
    ranged = Staged(ranged.withColumn("at", F.monotonically_increasing_id()), "ranks").df.withColumn("part", F.shiftright("at", 33))
    parts = ranged.groupBy("part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    parts = parts.select(F.col("part").alias("p"), "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    ranged = ranged.join(F.broadcast(parts), F.col("part") == F.col("p"))
    place = F.col("before") + F.col("at") - F.col("first") + 1
    drawn = F.when(place <= F.floor(F.col("all") * percent / F.lit(100)), place).cast("long")
    out = ranged.select("id", "n_features", "weight", "score", drawn.alias("rank"))
    short = rows.where(F.col("n_words") < min_words).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    return out.unionByName(short).withColumnRenamed("id", id_col)


_NAMES = ("_evalgrove_words", "_evalgrove_features", "_evalgrove_weight")


def sample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The rows of docs, all columns, that are drawn for the target.

    The score and id drawn last are a threshold, by which rows are chosen where they are read: texts are not shuffled.
    Rows equal in id and score, if the threshold falls on them, are all drawn.
    """
    gain = trained(docs, target, text_col, buckets=buckets)
    ranked = rank(docs, gain, id_col, text_col, percent, min_words, seed, buckets)
    last = ranked.where("rank IS NOT NULL").agg(F.max_by(F.struct(F.col("score"), F.col(id_col).alias("id")), "rank").alias("last")).head()[0]
    if last is None:
        return docs.limit(0)
    found = weigh(docs, gain, text_col, _NAMES, buckets)
    score, who = noisy(F.col(id_col), F.col(_NAMES[2]), seed), F.col(id_col)
    first = who.isNotNull() if last["id"] is None else who <= F.lit(last["id"])
    tied = who.isNull() | first if last["id"] is None else first
    drawn = (F.col(_NAMES[0]) >= min_words) & ((score > last["score"]) | ((score == last["score"]) & F.coalesce(tied, F.lit(False))))
    return found.where(drawn).select(*docs.columns)
