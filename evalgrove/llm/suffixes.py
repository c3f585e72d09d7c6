"""Suffix arrays by linear grouping, and the removal of byte strings that earlier documents hold.

suffix_array() sorts suffixes in two phases. The first groups them by their longest Lyndon prefix. It starts
from groups of equal first symbols and takes the groups from the largest to the smallest; each suffix of
the group at hand points to the previous suffix of a smaller group, and the suffixes pointed to move to
new groups right behind their own, those pointed to more often further behind. The second goes through
the suffixes in ascending order; each lets the suffixes whose Lyndon prefix ends where it starts take the
next place of their group, found along the same pointers. Nothing is renamed or sorted again.

remove_repeats() has to bring equal strings of SIZE bytes of a corpus together without bringing the
corpus together. Every such string has a least hash among its GRAM-byte substrings, which equal strings
share. Neighbouring strings of a document mostly share it too, so a document falls into runs, a run being
the text that all strings with one least hash cover. Then
1. runs are known by least hash and digest. Batches of documents send each run's numbers, not its text, to
   the part of its least hash, and a run that several documents of the batch have only once. Runs whose
   least hash one document alone has are dropped;
2. equal runs are removed from all documents but the one of least id;
3. runs of one least hash that differ may still share strings. Their texts are fetched, cut to where
   fingerprints of strings occur twice, and put into one text, whose suffix array brings equal strings
   side by side; a string of larger id than the least of its neighbours is removed. More runs than PART
   of one least hash are dealt over several texts, whose strings are then merged by digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, byte_slices, release, small_batches

SIZE = 50
GRAM = 16
#: Strings in a run at most, so that periodic text makes no endless runs.
RUN = 256
#: Runs of one least hash that are sorted in one text, about.
PART = 4096
#: Bytes of runs whose fingerprints are compared together, and symbols that are sorted together, if not of one least hash.
FETCHED = 1 << 20
TEXT = 1 << 15
#: Bytes of text whose runs' numbers make up a part, about: a part is held in memory at a time, at about three bytes a byte.
PART_BYTES = 16 << 20
#: Runs a batch of documents holds before it is sent.
HELD = 400_000
#: Bytes of text that a worker turns into Python objects at a time, and rows that it sends at a time.
TEXTS = 1 << 20
SENT = 50_000


#: A suffix whose previous smaller group is not known yet.
UNSET = -2


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes in ascending order. The last symbol must be smaller than all others."""
    n = len(text)
    width = max(text) + 1
    count = [0] * (width + 1)
    for c in text:
        count[c + 1] += 1
    for c in range(width):
        count[c + 1] += count[c]
    start = count[:width]  # of each symbol's group
    place = start[:]
    order, at = [0] * n, [0] * n  # suffixes by group, and each suffix's place there
    for i, c in enumerate(text):
        p = place[c]
        place[c] = p + 1
        order[p] = i
        at[i] = p
    group = [start[c] for c in text]  # a group is known by its first place
    size = [0] * n
    for c in range(width):
        if place[c] > start[c]:
            size[start[c]] = place[c] - start[c]
    previous = [UNSET] * n

    end = n - 1
    while end >= 0:
        first = group[order[end]]
        members = order[first : end + 1]
        pointed: dict[int, int] = {}
        for i in members:  # in any order: one that another waits for is settled before it
            if previous[i] != UNSET:
                continue
            waiting, p = [i], i - 1
            while waiting:
                while p >= 0 and group[p] >= first and previous[p] != UNSET:
                    p = previous[p]
                if p >= 0 and group[p] >= first:  # of the same group, not yet settled
                    waiting.append(p)
                    p -= 1
                    continue
                i = waiting.pop()
                previous[i] = p
                if p >= 0:
                    pointed[p] = pointed.get(p, 0) + 1
        end = first - 1
        if not pointed:
            continue
        if len(pointed) == 1:
            rounds = [list(pointed)]
        else:
            by_times: dict[int, list[int]] = {}
            for p, times in pointed.items():
                by_times.setdefault(times, []).append(p)
            rounds = [by_times[times] for times in sorted(by_times, reverse=True)]
        for moving in rounds:
            touched: dict[int, list[int]] = {}
            for p in moving:
                g = group[p]
                if g in touched:
                    touched[g].append(p)
                else:
                    touched[g] = [p]
            for g, those in touched.items():
                left = size[g]
                if left == len(those):
                    continue  # the whole group moves, which changes nothing
                for p in those:  # to the end of the group, in exchange with what stands there
                    left -= 1
                    a, q = at[p], order[g + left]
                    order[a], order[g + left] = q, p
                    at[q], at[p] = a, g + left
                size[g] = left
                new = g + left
                size[new] = len(those)
                for p in those:
                    group[p] = new

    free = group[:]  # free[g]: next place of the group that starts at place g
    for g in range(n):
        free[g] = g
    done = [False] * n
    last = n - 1
    order[0] = last
    done[last] = True
    for i in range(n):
        s = order[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            order[free[g]] = s
            free[g] += 1
            done[s] = True
            s = previous[s]
    return order


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def runs(data: bytes, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Least hash, first string and number of strings of each run. gram is a power of two below size."""
    n = len(data)
    if n < size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.frombuffer(data, np.uint8).astype(np.uint64) + np.uint64(1)
    step = 1
    while step < gram:
        h = h[:-step] * np.uint64(0x9E3779B97F4A7C15 + 2 * step) + h[step:]
        h ^= h >> np.uint64(31)
        step *= 2
    least, have, window = _mixed(h), 1, size - gram + 1
    while have < window:  # least over the next have hashes, doubled up to the window
        shift = min(have, window - have)
        least = np.minimum(least[:-shift], least[shift:])
        have += shift
    begins = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
    ends = np.append(begins[1:], len(least))
    if (ends - begins).max() > RUN:
        begins = np.unique(np.concatenate([begins, *(np.arange(b, e, RUN) for b, e in zip(begins, ends) if e - b > RUN)]))
        ends = np.append(begins[1:], len(least))
    return least[begins].view(np.int64), begins, ends - begins


def _bytes(text: str | None) -> bytes:
    return text.encode("utf-8", "surrogatepass") if text else b""


# 1. runs by least hash

NUMBERS = np.dtype([("h", "<i8"), ("g", "<i8"), ("id", "<i8"), ("start", "<i4"), ("n", "<i2"), ("many", "?")])
FULL, CLASS, MEMBER, ASKED = range(4)
ROWS = "kind int, h long, g long, id long, start int, n int, of int"


#: Hashes travel with six bytes each: least hash and digest together tell runs apart by 96 bits.
MASK = np.int64((1 << 48) - 1)


def _pack(rows: np.ndarray) -> bytes:
    """Byte planes, one column after another: the upper planes are mostly zeros, which shuffles compress away."""
    planes = [np.ascontiguousarray(rows[c]).view(np.uint8).reshape(len(rows), -1).T.tobytes() for c in NUMBERS.names]
    return len(rows).to_bytes(4, "little") + b"".join(planes)


def _unpack(data: bytes) -> np.ndarray:
    n, at = int.from_bytes(data[:4], "little"), 4
    rows = np.empty(n, NUMBERS)
    for c in NUMBERS.names:
        size = NUMBERS[c].itemsize
        planes = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n)
        rows[c] = np.ascontiguousarray(planes.T).reshape(-1).view(NUMBERS[c])
        at += n * size
    return rows


def _cuts(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows change in any of the columns, the first row included."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    change = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, change))


def _scanner(parts: int, size: int):
    def send(held: list[np.ndarray]) -> pa.RecordBatch:
        rows = np.concatenate(held)
        rows = rows[np.lexsort((rows["start"], rows["id"], rows["g"], rows["h"]))]
        cuts = _cuts(rows["h"], rows["g"])
        times = np.diff(np.append(cuts, len(rows)))
        several = rows["id"][cuts] != rows["id"][cuts + times - 1]
        in_several = np.repeat(several, times)
        once = rows[cuts[several]]
        once["many"] = True
        sent = np.concatenate([rows[~in_several], once])
        part = (sent["h"].view(np.uint64) % np.uint64(parts)).astype(np.int64)
        by = np.argsort(part, kind="stable")
        sent, part = sent[by], part[by]
        cuts = _cuts(part)
        out = [(int(part[a]), _pack(sent[a:b])) for a, b in zip(cuts, np.append(cuts[1:], len(sent)))]
        # the documents that have them stay out of the parts; they are told by class, see CLASS
        members = rows[in_several]
        out += [(-1 - int(abs(int(members["g"][a])) % parts), _pack(members[a : a + 20_000])) for a in range(0, len(members), 20_000)]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int64()), pa.array([x for _, x in out], pa.binary())], ["part", "rows"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        count = 0
        for batch in byte_slices(batches, "text", TEXTS):
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                data = _bytes(text)
                h, starts, n = runs(data, size)
                if not len(h):
                    continue
                rows = np.empty(len(h), NUMBERS)
                rows["h"], rows["id"], rows["start"], rows["n"], rows["many"] = h & MASK, i, starts, n, False
                rows["g"] = np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), (starts + n + size - 1).tolist())), np.uint64, len(h)).view(np.int64) & MASK
                held.append(rows)
                count += len(rows)
                if count >= HELD:
                    yield send(held)
                    held, count = [], 0
        if held:
            yield send(held)

    return run


def _rows(kind: int, rows: np.ndarray, of) -> Iterator[pa.RecordBatch]:
    of = np.broadcast_to(np.asarray(of, np.int32), len(rows))
    for at in range(0, len(rows), SENT):
        some = rows[at : at + SENT]
        columns = [np.full(len(some), kind, np.int32), some["h"], some["g"], some["id"], some["start"], some["n"].astype(np.int32), of[at : at + SENT]]
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in columns], ["kind", "h", "g", "id", "start", "n", "of"])


def _decide(held: list[np.ndarray], per_part: int) -> Iterator[pa.RecordBatch]:
    """What becomes of the runs of a part: FULL to remove, ASKED to compare by text, CLASS to tell members. Empties held."""
    rows = np.concatenate(held)
    held.clear()
    rows = rows[np.lexsort((rows["start"], rows["id"], rows["g"], rows["h"]))]
    heads = _cuts(rows["h"])
    lengths = np.diff(np.append(heads, len(rows)))
    shared = np.maximum.reduceat(rows["many"], heads) | (np.maximum.reduceat(rows["id"], heads) != np.minimum.reduceat(rows["id"], heads))
    rows = rows[np.repeat(shared, lengths)]
    if not len(rows):
        return
    classes = _cuts(rows["h"], rows["g"])
    members = np.diff(np.append(classes, len(rows)))
    first = rows["id"][classes]
    of_h = _cuts(rows["h"][classes])
    number = np.diff(np.append(of_h, len(classes)))
    differ = (number > 1) & (np.maximum.reduceat(first, of_h) != np.minimum.reduceat(first, of_h))
    of = np.repeat(np.where(differ, -(-number // per_part), 0), number)  # by class; 0: nothing to compare
    first_of, of_of = np.repeat(first, members), np.repeat(of, members)
    plain = ~rows["many"]
    whole = rows[plain & (rows["id"] > first_of)]
    whole["h"] = whole["g"] = 0  # not needed any more
    yield from _rows(FULL, whole, 0)
    ask = plain & (rows["id"] == first_of) & (of_of > 0)
    yield from _rows(ASKED, rows[ask], of_of[ask])
    told = np.maximum.reduceat(rows["many"], classes)
    yield from _rows(CLASS, rows[classes][told], of[told])


def _decider(per_part: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []
        for batch in batches:
            for part, data in zip(batch.column("part").to_pylist(), batch.column("rows").to_pylist()):
                if part < 0:
                    yield from _rows(MEMBER, _unpack(data), 0)
                    continue
                if part != at and held:
                    yield from _decide(held, per_part)
                at = part
                held.append(_unpack(data))
        if held:
            yield from _decide(held, per_part)

    return run


# 2. texts of the runs to compare


def _lists(column: pa.Array) -> tuple[list[int], dict[str, pa.Array]]:
    """Number of structs in each list of a column, and the structs' fields, one list after another."""
    flat = column.flatten()
    names = [f.name for f in flat.type]
    return pc.fill_null(pc.list_value_length(column), 0).to_pylist(), dict(zip(names, flat.flatten()))


def _fetcher(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in byte_slices(batches, "text", TEXTS):
            counts, asked = _lists(batch.column("asked"))
            owner = pa.array(np.repeat(batch.column("id").to_numpy(), counts))
            starts = asked["start"].to_numpy()
            stops = (starts + asked["n"].to_numpy() + (size - 1)).tolist()
            starts, out, at = starts.tolist(), [], 0
            for text, n in zip(batch.column("text").to_pylist(), counts):
                data = _bytes(text)
                out += [data[a:b] for a, b in zip(starts[at : at + n], stops[at : at + n])]
                at += n
            columns = [asked["h"], asked["part"], asked["of"], owner, asked["start"], pa.array(out, pa.binary())]
            whole = pa.RecordBatch.from_arrays(columns, ["h", "part", "of", "id", "start", "s"])
            for at in range(0, whole.num_rows, SENT):
                yield whole.slice(at, SENT)

    return run


# 3. equal strings by suffix array


def _equal(data: bytes, order: np.ndarray, size: int) -> np.ndarray:
    """Whether the strings of size bytes at neighbouring places of order are equal, compared in words of 8 bytes, 4, 2 or 1."""
    words, step = np.frombuffer(data, np.uint8).astype(np.uint64), 1
    while step < 8 and 2 * step <= size:
        words = words[:-step] | (words[step:] << np.uint64(8 * step))
        step *= 2
    same = np.ones(max(0, len(order) - 1), bool)
    for k in [*range(0, size - step + 1, step), size - step]:  # the last one may overlap
        at = words[order + k]
        same &= at[1:] == at[:-1]
    return same


def _least_of(strings: list[bytes], firsts: list[int], size: int) -> list[np.ndarray]:
    """For each of the runs the least first id of the runs that have each of its strings."""
    text: list[int] = []
    begin = []
    for s in strings:
        begin.append(len(text))
        text.extend([b + 2 for b in s])
        text.append(1)
    text.append(0)
    owner = np.full(len(text), -1, np.int64)
    for k, (b, s) in enumerate(zip(begin, strings)):
        owner[b : b + len(s) - size + 1] = k
    order = np.array(suffix_array(text), np.int64)
    order = order[owner[order] >= 0]  # the starts of whole strings, equal ones side by side
    same = _equal(b"\0".join(strings) + bytes(2), order, size)
    classes = np.cumsum(np.append(0, ~same))
    first = np.array(firsts, np.int64)[owner[order]]
    least = np.full(classes[-1] + 1, np.iinfo(np.int64).max)
    np.minimum.at(least, classes, first)
    at = np.empty(len(text), np.int64)
    at[order] = least[classes]
    return [at[b : b + len(s) - size + 1] for b, s in zip(begin, strings)]


def _twice(strings: list[bytes], size: int) -> list[tuple[int, int]]:
    """Of each run the first string and the one after the last whose fingerprint occurs twice; (0, 0) if none does."""
    data = np.frombuffer(b"".join(strings), np.uint8).astype(np.uint64) + np.uint64(1)
    doubled, step = [(1, data)], 1
    while 2 * step <= size:
        h = doubled[-1][1]
        h = h[:-step] * np.uint64(0xC2B2AE3D27D4EB4F + 2 * step) + h[step:]
        h ^= h >> np.uint64(30)
        step *= 2
        doubled.append((step, h))
    have, h = doubled[-1]
    for step, g in reversed(doubled):
        while have + step <= size:
            n = len(data) - have - step + 1
            h = h[:n] * np.uint64(0xD6E8FEB86659FD93) + g[have : have + n]
            h ^= h >> np.uint64(29)
            have += step
    lengths = np.array([len(s) for s in strings])
    begin = np.cumsum(lengths) - lengths
    counts = lengths - size + 1
    at = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())  # starts of whole strings
    _, inverse, times = np.unique(h[at], return_inverse=True, return_counts=True)
    hit = np.flatnonzero(times[inverse] > 1)
    owner = np.repeat(np.arange(len(strings)), counts)[hit]
    place = at[hit] - begin[owner]
    out = [(0, 0)] * len(strings)
    cuts = _cuts(owner)
    for a, b in zip(cuts, np.append(cuts[1:], len(owner))):
        out[int(owner[a])] = (int(place[a]), int(place[b - 1]) + 1)
    return out


def _solved(rows: list[tuple], size: int) -> Iterator[tuple[tuple, int, np.ndarray]]:
    """(row, from, least) of each run (h, part, of, id, start, s) that has strings twice: least ids from there on.

    Rows are sorted by (h, part). Runs of one such group share a text; groups share one too while it is short.
    """
    jobs: dict[bytes, int] = {}  # cut runs and their least id
    pending: list[tuple[tuple, int, bytes]] = []
    held = 0

    def flush():
        strings = list(jobs)
        least = dict(zip(strings, _least_of(strings, [jobs[s] for s in strings], size)))
        yield from ((row, a, least[cut]) for row, a, cut in pending)

    at = None
    for row, (a, b) in zip(rows, _twice([r[5] for r in rows], size)):
        if b <= a:
            continue
        if row[:2] != at and held > TEXT:
            yield from flush()
            jobs, pending, held = {}, [], 0
        at = row[:2]
        cut = row[5][a : b + size - 1]
        if cut not in jobs:
            held += len(cut) + 1
        jobs[cut] = min(jobs.get(cut, row[3]), row[3])
        pending.append((row, a, cut))
    if pending:
        yield from flush()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """Rows sorted by (h, part), some groups at a time, none of them torn."""
    held: list[tuple] = []
    length, at = 0, None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("h", "part", "of", "id", "start", "s"))):
            if row[:2] != at and length > FETCHED:
                yield held
                held, length = [], 0
            at = row[:2]
            held.append(row)
            length += len(row[5])
    if held:
        yield held


def _spans_of(i: int, start: int, hit: np.ndarray, size: int) -> Iterator[tuple[int, int, int]]:
    """Byte spans that the strings at the given places of a run cover."""
    if len(hit):
        cut = np.flatnonzero(np.diff(hit) > size)
        for a, b in zip(np.append(hit[0], hit[cut + 1]).tolist(), np.append(hit[cut], hit[-1]).tolist()):
            yield i, start + a, start + b + size


SPAN_COLUMNS = "id long, s int, e int"


def _span_batch(found: list[tuple[int, int, int]]) -> pa.RecordBatch:
    columns = list(zip(*found)) or [()] * 3
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32()))], ["id", "s", "e"])


def _sorter(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            yield _span_batch([x for r, a, least in _solved(rows, size) for x in _spans_of(r[3], r[4] + a, np.flatnonzero(least < r[3]), size)])

    return run


def _part_sorter(size: int):
    """For groups dealt over several texts: each string with its digest and least id so far, strings of one text once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _groups(batches):
            known = {id(r): (a, least) for r, a, least in _solved(rows, size)}
            out = []
            for r in rows:
                a, least = known.get(id(r), (0, ()))
                for k in range(len(r[5]) - size + 1):
                    best = int(least[k - a]) if a <= k < a + len(least) else r[3]
                    out.append((r[3], r[4] + k, best, xxhash.xxh3_128_digest(r[5][k : k + size])))
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.binary()))], ["id", "at", "least", "digest"])

    return run


# 4. what to remove


def _merged(s: np.ndarray, e: np.ndarray) -> tuple[list[int], list[int]]:
    """Starts and ends of the runs that the spans cover."""
    order = np.argsort(s, kind="stable")
    s, e = s[order], np.maximum.accumulate(e[order])
    first = np.flatnonzero(np.append(True, s[1:] > e[:-1]))
    return s[first].tolist(), e[np.append(first[1:] - 1, len(e) - 1)].tolist()


def _cutter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in byte_slices(batches, "text", TEXTS):
        n, gone, count, digest = [], [], [], []
        counts, spans = _lists(batch.column("spans"))
        begins, ends, upto = spans["s"].to_numpy(), spans["e"].to_numpy(), 0
        for text, m in zip(batch.column("text").to_pylist(), counts):
            data = _bytes(text)
            left, right = _merged(begins[upto : upto + m], ends[upto : upto + m]) if m else ([], [])
            upto += m
            whole, at = hashlib.sha256(), 0
            for s, e in zip(left, right):
                whole.update(data[at:s])
                at = e
            whole.update(data[at:])
            n.append(len(data))
            gone.append(sum(right) - sum(left))
            count.append(len(left))
            digest.append(whole.hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, pa.int64()) for c in (n, gone, count)), pa.array(digest, pa.string())], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, s, e): byte spans, possibly overlapping, of strings of size bytes that start in a document of smaller id."""
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    total = rows.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    parts = max(2 * n, -(-total // PART_BYTES))
    sent = rows.mapInArrow(_scanner(parts, size), "part long, rows binary")
    sent = sent.repartition(n, "part").sortWithinPartitions("part")
    found = Staged(sent.mapInArrow(_decider(PART), ROWS), "runs")
    release(spark)

    told = found.df.where(F.col("kind") == CLASS).select(F.col("h").alias("h1"), F.col("g").alias("g1"), F.col("id").alias("first"), F.col("of").alias("of1"))
    members = found.df.where(F.col("kind") == MEMBER).drop("of").join(told, (F.col("h") == F.col("h1")) & (F.col("g") == F.col("g1")))
    whole = found.df.where(F.col("kind") == FULL).unionByName(members.where("id > first").select(*[c for c in found.df.columns if c != "of"], F.lit(0).alias("of")))
    whole = whole.select("id", F.col("start").alias("s"), (F.col("start") + F.col("n") + (size - 1)).alias("e"))

    asked = found.df.where(F.col("kind") == ASKED).select("h", "g", "id", "start", "n", "of")
    asked = asked.unionByName(members.where("id = first and of1 > 0").select("h", "g", "id", "start", "n", F.col("of1").alias("of")))
    asked = asked.withColumn("part", F.pmod("g", "of").cast("int")).groupBy(F.col("id").alias("of_id")).agg(F.collect_list(F.struct("h", "part", "of", "start", "n")).alias("asked"))
    held = rows.join(asked, F.col("id") == F.col("of_id")).select("id", "text", "asked")
    strings = Staged(held.mapInArrow(_fetcher(size), "h long, part int, of int, id long, start int, s binary"), "strings")
    release(spark)

    dealt = lambda some: strings.df.where(some).repartition(n, "h", "part").sortWithinPartitions("h", "part")
    compared = dealt("of = 1").mapInArrow(_sorter(size), SPAN_COLUMNS)
    parted = Staged(dealt("of > 1").mapInArrow(_part_sorter(size), "id long, at int, least long, digest binary"), "parted")
    best = parted.df.groupBy("digest").agg(F.min("least").alias("best")).withColumnRenamed("digest", "d")
    merged = parted.df.join(best, F.col("digest") == F.col("d")).where("best < id").select("id", F.col("at").alias("s"), (F.col("at") + size).alias("e"))
    spans = Staged(whole.unionByName(compared).unionByName(merged), "spans")
    for done in (found, strings, parted):
        done.drop()
    release(spark)
    return spans.df


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256) of every row.

    Each byte goes that a string of size bytes covers which also starts in a document of smaller id; strings
    are those of the input. A null text is empty. Texts shorter than size keep everything. Rows that repeat
    an id are one document: none removes from the other, and all lose the same spans, which is right for equal
    texts. Rows without an id remove nothing and lose nothing. Other columns of docs are not read.
    """
    spans = repeated_spans(docs, id_col, text_col, size).groupBy(F.col("id").alias("of")).agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    cut = rows.join(spans, F.col("id") == F.col("of"), "left").select("id", "text", "spans")
    return cut.mapInArrow(_cutter, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("id", id_col)
