"""Benchmark decontamination by Wu-Manber search over words.

The test strings are the windows of 10 consecutive words of the benchmark's items; an item of fewer words
is one string. Symbols are words and a block is two of them. For the strings of one length m, the shift
table says how far a block lies from the end of any string, m - 1 where it lies in none: most positions
are skipped without a look. Blocks with shift 0 have a bucket of the strings that end in them; a bucket's
strings are compared word by word at the position. Strings of other lengths have tables of their own.
"""

from __future__ import annotations

import hashlib
import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices

WINDOW = 10
#: Words after A-Z have become a-z: what is left is 0-9, a-z and all beyond ASCII, here as UTF-8 bytes.
WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
#: Bytes of benchmark words searched for at once; a larger benchmark is walked block by block. Tables take about a hundred times as much.
BLOCK_BYTES = 2 << 20
#: Bytes of texts that a task holds while it walks the blocks of a benchmark that has several.
HELD_BYTES = 32 << 20


def words_of(text: str | None) -> list[bytes]:
    return WORDS.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


def windows_of(words: list[bytes], window: int = WINDOW) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))] if words else []


class WuManber:
    """Finds all places where any of the strings, tuples of words, occurs in a list of words."""

    def __init__(self, strings: dict[tuple[bytes, ...], list]):
        self.by_length = []
        lengths = defaultdict(list)
        for s in strings:
            lengths[len(s)].append(s)
        for m, group in sorted(lengths.items()):
            b = min(2, m)
            shift: dict = {}
            bucket = defaultdict(list)
            for s in group:
                for end in range(b, m + 1):
                    key = s[end - b : end]
                    shift[key] = min(shift.get(key, m), m - end)
                bucket[s[m - b :]].append(s)
            self.by_length.append((m, b, m - b + 1, shift, dict(bucket)))

    def find(self, words: list[bytes]) -> Iterator[tuple[int, tuple[bytes, ...]]]:
        for m, b, far, shift, bucket in self.by_length:
            at, n = m, len(words)
            while at <= n:
                key = tuple(words[at - b : at])
                step = shift.get(key, far)
                if step:
                    at += step
                    continue
                for s in bucket[key]:
                    if words[at - m] == s[0] and tuple(words[at - m : at]) == s:
                        yield at - m, s
                at += 1


def _covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint spans of the same words."""
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


SPANS = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))


#: The tables of a worker process, kept from task to task: those of the latest blocks.
_BUILT: dict[tuple, tuple[dict, WuManber]] = {}
KEPT = 2


def _tables(shared, key: str, window: int) -> tuple[dict, WuManber]:
    """Whose each window of a block is, and the search for them. The block travels compressed and is opened to build the tables only."""
    if (key, window) not in _BUILT:
        while len(_BUILT) >= KEPT:
            del _BUILT[next(iter(_BUILT))]
        owners = defaultdict(list)
        for item, words in pickle.loads(zlib.decompress(shared.value)):
            for w in windows_of(words, window):
                owners[w].append(item)
        _BUILT[key, window] = dict(owners), WuManber(owners)
    return _BUILT[key, window]


def _held(batches: Iterator[pa.RecordBatch], column: str, blocks: int) -> Iterator[list[pa.RecordBatch]]:
    """Slices of the batches, one at a time for one block, else so many that blocks are changed seldom."""
    part, size = [], 0
    for batch in slices(batches):
        part.append(batch)
        size += batch.column(column).nbytes
        if blocks == 1 or size >= HELD_BYTES:
            yield part
            part, size = [], 0
    if part:
        yield part


def _searcher(shared: list[tuple], window: int):
    """Spans and items of all blocks; one worker walks them, with the tables of one block or two at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _held(batches, "text", len(shared)):
            rows = sum(b.num_rows for b in part)
            hits, items, n = [[] for _ in range(rows)], [set() for _ in range(rows)], [0] * rows
            for block, key in shared:
                owners, search = _tables(block, key, window)
                at = 0
                for batch in part:
                    for text in batch.column("text").to_pylist():
                        words = words_of(text)
                        n[at] = len(words)
                        for place, s in search.find(words):
                            hits[at].append((place, place + len(s)))
                            items[at].update(owners[s])
                        if hits[at]:
                            hits[at] = _covered(hits[at])
                        at += 1
            ids = pa.concat_arrays([b.column("id") for b in part])
            spans = pa.array([[{"s": s, "e": e} for s, e in row] for row in hits], SPANS)
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), spans, pa.array([sorted(i) for i in items], pa.list_(pa.string()))], ["id", "n_words", "spans", "items"])

    return run


def _shared(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> list[tuple]:
    """The benchmark's blocks as broadcasts with their keys, read one row at a time; an empty benchmark is one empty block."""
    items = benchmark.where(F.col(item_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    out = []
    for part in _blocks(items, block_bytes):
        packed = zlib.compress(pickle.dumps(part), 1)
        out.append((benchmark.sparkSession.sparkContext.broadcast(packed), hashlib.blake2b(packed, digest_size=16).hexdigest()))
    return out


def _blocks(items: DataFrame, block_bytes: int) -> Iterator[list[tuple[str, list[bytes]]]]:
    """The benchmark in parts of bounded size."""
    part, size, none = [], 0, True
    for item, text in items.toLocalIterator():
        words = words_of(text)
        if not words:
            continue
        part.append((item, words))
        size += sum(map(len, words))
        if size >= block_bytes:
            yield part
            part, size, none = [], 0, False
    if part or none:
        yield part


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, n_words, spans, items): where windows of the benchmark occur in each text, and whose they are.

    spans are disjoint word positions, end exclusive; items are item ids as strings, sorted. A null or
    wordless text has no spans; items without words or id are left out; an empty benchmark hits nothing.
    Items that repeat an id count as one. Other columns of docs are not read. Documents that repeat an id
    are rows of their own, however large the benchmark; nothing is shuffled.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_words long, spans array<struct<s:bigint,e:bigint>>, items array<string>"
    found = rows.mapInArrow(_searcher(_shared(benchmark, item_col, item_text_col, block_bytes), window), schema)
    return found.withColumnRenamed("id", id_col)


def _cleaner(shared: list[tuple], window: int, text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _held(batches, text_col, len(shared)):
            for block, key in shared:
                _, search = _tables(block, key, window)
                for i, batch in enumerate(part):
                    clean = [next(search.find(words_of(t)), None) is None for t in batch.column(text_col).to_pylist()]
                    part[i] = batch.filter(pa.array(clean, pa.bool_()))
            yield from part

    return run


def without_contamination(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs, all columns, in which no window of the benchmark occurs; one pass, nothing is shuffled.

    Null and wordless texts stay; rows that repeat are judged alike; an empty benchmark drops nothing. Ids are not read.
    """
    return docs.mapInArrow(_cleaner(_shared(benchmark, item_col, item_text_col, block_bytes), window, text_col), docs.schema)


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, n_words, n_hit, n_items, items_sha256, contaminated) from contamination()."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + x["e"] - x["s"])
    return found.select(id_col, "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (hit > 0).alias("contaminated"))


def sha256(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
