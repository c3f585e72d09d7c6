"""MinHash near-duplicates: minima of many universal hashes, bands, verified signatures, whole sets, components.

1. mapInArrow turns each text into its number of distinct shingles, a 128-bit digest of the set, its signature
   of minima and a hash for each band of it. Only these leave the scan, and rows get numbers.
2. Texts with equal digests form a class, represented by the row of its least id: a group of exact copies,
   however large, goes on as one row. Nodes of all links are row numbers, so rows without an id have links too.
3. A band value that several classes share is a bucket. Each member is paired with the bucket's least
   member only, so a bucket gives as many pairs as members.
4. Pairs are verified by their signatures: those that agree in too few minima to be similar go. What is left
   is confirmed on full shingle sets, which only their texts are fetched for, and joined to components.
5. Buckets that still hold several components are compared in full, so that no pair of a bucket stays
   untested unless its classes are already connected. Signatures are dealt into blocks, each pair of blocks
   goes to a task, which returns the members that agree enough with a member of another component. Of these
   the texts are fetched and dealt into blocks likewise; a task counts common shingles by an index of
   shingles and returns only links that join components: never more than members, however many pairs.
   These links are confirmed too.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Staged, slices, words_of
from .components import components

ROWS = 5
#: Parts that a leader's pairs are dealt over for confirmation.
SALTS = 4096
#: Keys up to this number (id and digest, 32 bytes each) may be broadcast; beyond it texts are fetched by a shuffle join.
BROADCAST_KEYS = 500_000
BLOCK = 4096
#: Signatures of a bucket that are compared with each other in one task, about.
SIGNATURES = 2048
#: Members of a bucket whose sets are compared with each other in one task, and shingles in them, about.
MEMBERS = 512
SHINGLES = 1 << 20
#: Chance that a pair right at the threshold agrees in fewer minima than are asked for.
MISS = 1e-9

#: Names that no column of documents has.
_ID, _KEY = "_evalgrove_id", "_evalgrove_key"


def bands_for(threshold: float, rows: int = ROWS, miss: float = 1e-6) -> int:
    """Bands needed to miss a pair right at the threshold with a chance of at most miss."""
    return math.ceil(math.log(miss) / math.log(1 - threshold**rows))


def least_agreement(threshold: float, minima: int, miss: float = MISS) -> int:
    """Minima that two signatures agree in at least, but for a chance of miss, if the sets are at least so similar."""
    below = 0.0
    for agree in range(minima + 1):
        below += math.comb(minima, agree) * threshold**agree * (1 - threshold) ** (minima - agree)
        if below > miss:
            return agree
    return minima


def text_key(text):
    """Column: a digest that tells texts apart; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _hashes(words: list[bytes], k: int, known: _Words) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the k-word shingles; of the whole sequence if it is shorter."""
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    k = min(k, len(h))
    total = np.zeros(len(h) - k + 1, np.uint64)
    for i in range(k):
        total = total * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - k + 1 + i]
    return np.unique(_mix(total))


def _signer(k: int, bands: int, rows: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        a = rng.integers(0, 2**63, bands * rows, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        b = rng.integers(0, 2**64, bands * rows, dtype=np.uint64)[:, None]
        fold = rng.integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        tag = rng.integers(0, 2**64, bands, dtype=np.uint64)
        known = _Words()
        for batch in slices(batches):
            n, digest, band, signature = [], [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                if not words:
                    n.append(0), digest.append(None), band.append(None), signature.append(None)
                    continue
                x = _hashes(words, k, known)
                least = None
                for i in range(0, len(x), BLOCK):  # the table of a block stays in the processor's cache
                    y = ((x[i : i + BLOCK] * a + b) >> np.uint64(32)).min(axis=1)
                    least = y if least is None else np.minimum(least, y)
                n.append(len(x))
                digest.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                signature.append(least.astype("<u4").tobytes())
                band.append(_mix((least.reshape(bands, rows) * fold).sum(axis=1, dtype=np.uint64) + tag).view(np.int64))
            columns = [pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(band, pa.list_(pa.int64())), pa.array(signature, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("t"), *columns], ["id", "t", "n_shingles", "digest", "bands", "signature"])

    return run


def _shingles(text: str | None, k: int) -> set:
    words = words_of(text)
    return set(zip(*(words[i:] for i in range(k)))) if len(words) >= k else {tuple(words)} if words else set()


def _confirmer(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, set()
        for batch in batches:
            u, v = [], []
            for a, salt, member, x, text in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "member", "x", "text"))):
                if not member:
                    at, own = (a, salt), _shingles(text, k)
                elif at == (a, salt):
                    other = _shingles(text, k)
                    both = len(own & other)
                    if 100 * both >= percent * (len(own) + len(other) - both) and both:
                        u.append(a), v.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return run


def _few(keys: DataFrame) -> DataFrame:
    """The keys, to be broadcast if they are few enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def texts_of(nodes: DataFrame, signed: DataFrame, base: DataFrame) -> DataFrame:
    """(node, text) of the nodes; signed: (row, id, t, ...); base: (id, text). Rows equal in id and text may each come."""
    wanted = Staged(signed.join(_few(nodes), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), F.col("id").alias("of"), F.col("t").alias("key")), "wanted").df
    keyed = base.withColumn("t", text_key(F.col("text")))
    with_id = keyed.join(_few(wanted.where("of is not null")), (F.col("id") == F.col("of")) & (F.col("t") == F.col("key"))).select("node", "text")
    without = wanted.where("of is null")
    if not without.isEmpty():  # any number of rows may have the key of a node
        found = keyed.where("id is null").join(_few(without), F.col("t") == F.col("key")).select("node", "text")
        with_id = with_id.unionByName(found.dropDuplicates(["node"]))
    return Staged(with_id, "texts").df


def _verifier(agree: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), "<u4").reshape(batch.num_rows, -1) for c in ("sig_a", "sig_b"))
                yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= agree))

    return run


def verified(pairs: DataFrame, signed: DataFrame, agree: int) -> DataFrame:
    """Those of the pairs (a, b) whose signatures agree in enough minima. signed: (row, signature, ...)."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    known = signed.join(_few(nodes), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "signature")
    held = pairs.join(known.select(F.col("node").alias("a"), F.col("signature").alias("sig_a")), "a")
    held = held.join(known.select(F.col("node").alias("b"), F.col("signature").alias("sig_b")), "b")
    return held.select("a", "b", "sig_a", "sig_b").mapInArrow(_verifier(agree), "a long, b long")


def confirmed(pairs: DataFrame, signed: DataFrame, base: DataFrame, k: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b) that are similar, as (u, v).

    The pairs of a are dealt over parts; each part gets a's text once and streams past the texts of its
    partners, so a task holds two sets, whatever the number of pairs.
    """
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), signed, base)
    leaders = pairs.select("a", "salt").distinct().join(texts, F.col("a") == F.col("node")).select("a", "salt", F.lit(0).alias("member"), F.col("a").alias("x"), "text")
    members = pairs.join(texts, F.col("b") == F.col("node")).select("a", "salt", F.lit(1).alias("member"), F.col("b").alias("x"), "text")
    n = int(base.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = leaders.unionByName(members).repartition(n, "a", "salt").sortWithinPartitions("a", "salt", "member")
    return dealt.mapInArrow(_confirmer(k, percent), "u long, v long")


def _groups(batches: Iterator[pa.RecordBatch], value: str, ready) -> Iterator[tuple[tuple, list]]:
    """((key, p, q), [(node, comp, block, ready(value))]) of each pair of blocks; rows come sorted by the former."""
    at, held = None, []
    for batch in batches:
        for key, p, q, node, comp, block, x in zip(*(batch.column(c).to_pylist() for c in ("key", "p", "q", "node", "comp", "block", value))):
            if (key, p, q) != at:
                if len(held) > 1:
                    yield at, held
                at, held = (key, p, q), []
            held.append((node, comp, block, ready(x)))
    if len(held) > 1:
        yield at, held


def _alike(agree: int):
    """Members of buckets that agree enough with a member of another component, of the other block if there are two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, p, q), rows in _groups(batches, "signature", lambda x: np.frombuffer(x, "<u4")):
            signatures = np.array([r[3] for r in rows])
            comp, block = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
            hit = np.zeros(len(rows), bool)
            for i in range(len(rows)):
                rest = slice(i + 1, None)
                other = (comp[rest] != comp[i]) & ((block[rest] != block[i]) | (p == q))
                near = np.flatnonzero(other) + i + 1
                near = near[(signatures[near] == signatures[i]).sum(axis=1) >= agree]
                hit[near] = True
                hit[i] |= len(near) > 0
            found = [rows[i][0] for i in np.flatnonzero(hit).tolist()]
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(found), pa.int64()), pa.array(found, pa.int64())], ["key", "node"])

    return run


def _joining(rows: list[tuple], crossed: bool, percent: int) -> Iterator[tuple[int, int]]:
    """Links between components among the rows (node, comp, block, hashes); only between blocks if crossed."""
    sets = [r[3] for r in rows]
    sizes = np.array([len(x) for x in sets])
    owner = np.repeat(np.arange(len(rows)), sizes)
    _, code, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    holders = np.split(owner[np.argsort(code, kind="stable")], np.cumsum(times)[:-1])
    of = np.split(code, np.cumsum(sizes)[:-1])
    block = np.array([r[2] for r in rows])
    parent: dict[int, int] = {}

    def root(c: int) -> int:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    for i, r in enumerate(rows):
        both = np.bincount(np.concatenate([holders[c] for c in of[i].tolist()]), minlength=len(rows))
        near = 100 * both >= percent * (sizes + sizes[i] - both)
        near[: i + 1] = False
        if crossed:
            near &= block != block[i]
        for j in np.flatnonzero(near).tolist():
            x, y = root(r[1]), root(rows[j][1])
            if x != y:
                parent[max(x, y)] = min(x, y)
                yield (r[0], rows[j][0])


def _joiner(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Words()
        for (_, p, q), rows in _groups(batches, "text", lambda x: _hashes(words_of(x), k, known)):
            found = list(_joining(rows, p != q, percent))
            yield pa.RecordBatch.from_arrays([pa.array([min(x) for x in found], pa.int64()), pa.array([max(x) for x in found], pa.int64())], ["a", "b"])

    return run


def _dealt(buckets: DataFrame, values: DataFrame, value: str, members: int, shingles: int | None = None) -> DataFrame:
    """Each pair of blocks of a bucket, with its members' values. buckets: (key, node, comp, n_shingles)."""
    size = F.ceil(F.count("*") / members)
    size = F.greatest(size, F.ceil(F.sum("n_shingles") / shingles)) if shingles else size
    blocks = buckets.groupBy("key").agg(size.cast("int").alias("blocks")).withColumnRenamed("key", "k")
    dealt = buckets.join(blocks, F.col("key") == F.col("k")).withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.least("block", j).alias("p"), F.greatest("block", j).alias("q")))
    dealt = dealt.select("key", "node", "comp", "block", F.inline(pairs)).join(values.withColumnRenamed("node", "of"), F.col("node") == F.col("of"))
    n = int(buckets.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return dealt.select("key", "p", "q", "node", "comp", "block", value).repartition(n, "key", "p", "q").sortWithinPartitions("key", "p", "q", "node")


def joining(buckets: DataFrame, signed: DataFrame, base: DataFrame, k: int, percent: int, agree: int) -> DataFrame:
    """Pairs (a, b) that join components of the same bucket. buckets: (key, node, comp)."""
    buckets = buckets.join(signed.select(F.col("row"), "n_shingles"), F.col("node") == F.col("row")).drop("row")
    buckets = Staged(buckets, "members").df
    nodes = buckets.select("node").distinct()
    known = signed.join(_few(nodes), F.col("row") == F.col("node"), "left_semi").select(F.col("row").alias("node"), "signature")
    alike = Staged(_dealt(buckets, known, "signature", SIGNATURES).mapInArrow(_alike(agree), "key long, node long").distinct(), "alike").df
    left = Staged(buckets.join(alike, ["key", "node"], "left_semi"), "left").df
    texts = texts_of(left.select("node").distinct(), signed, base)
    return _dealt(left, texts, "text", MEMBERS, SHINGLES).mapInArrow(_joiner(k, percent), "a long, b long")


def _found(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int, rows: int, seed: int) -> DataFrame:
    """(row, id, t, n_shingles, component, lead) of every row: lead is a row number, the component's for all its rows."""
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    bands = bands_for(percent / 100, rows)
    agree = least_agreement(percent / 100, bands * rows)
    schema = "id long, t binary, n_shingles long, digest binary, bands array<long>, signature binary"
    signed = base.withColumn("t", text_key(F.col("text"))).mapInArrow(_signer(shingle_words, bands, rows, seed), schema)
    signed = Staged(signed.withColumn("row", F.monotonically_increasing_id()), "minhash").df
    least = F.min(F.struct(F.isnull("id").alias("none"), "id", "row")).alias("least")
    classes = signed.where("n_shingles > 0").groupBy("digest").agg(least).select("digest", F.col("least.row").alias("node"), F.col("least.id").alias("least"))
    classes = Staged(classes, "classes").df
    values = Staged(signed.join(classes.select("node"), F.col("row") == F.col("node")).select("node", F.explode("bands").alias("key")), "bands")
    leaders = values.df.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("size")).where("size > 1")
    buckets = Staged(values.df.join(leaders.drop("size"), "key"), "buckets")
    values.drop()

    stars = Staged(buckets.df.where("node <> lead").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "stars").df
    pairs = Staged(verified(stars, signed, agree), "verified").df
    links = Staged(confirmed(pairs, signed, base, shingle_words, percent), "links")
    found = components(links.df)

    left = Staged(buckets.df.join(found.df, F.col("node") == F.col("u"), "left").select("key", "node", F.coalesce("v", "node").alias("comp")), "left")
    split = left.df.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 < c1").select("key")
    open_ = Staged(left.df.join(split, "key"), "open")
    if not open_.df.isEmpty():
        pairs = Staged(joining(open_.df, signed, base, shingle_words, percent, agree).distinct(), "pairs").df
        if not pairs.isEmpty():
            more = confirmed(pairs, signed, base, shingle_words, percent)
            found = components(Staged(links.df.unionByName(more), "links").df)
    for done in (left, open_, buckets):
        done.drop()

    # a component's id is the least of its classes' ids, of which there may be none
    linked = found.df.unionByName(found.df.select(F.col("v").alias("u"), "v").distinct())
    ids = linked.join(classes, F.col("u") == F.col("node")).groupBy(F.col("v").alias("lead")).agg(F.min("least").alias("component"))
    named = linked.join(ids, F.col("v") == F.col("lead")).select("u", "lead", "component")
    of_class = classes.join(named, F.col("node") == F.col("u"), "left")
    of_class = of_class.select(F.col("digest").alias("d"), F.coalesce("lead", "node").alias("lead"), F.coalesce("component", "least").alias("component"))
    return signed.select("row", "id", "t", "n_shingles", "digest").join(of_class, F.col("digest") == F.col("d"), "left").drop("digest", "d")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row.

    Texts are linked when 100 * intersection >= percent * union of their sets of shingles. A text of fewer
    words than a shingle is one shingle; a null, empty or blank text has none and is linked with nothing.
    component_id is the least id reachable, a lone row's own id; kept says that they are equal. Repeated
    rows are copies of each other and all have the same component. Rows without an id are linked like others,
    but no component has a null id unless all its rows do, and none of them is kept. Other columns of docs are
    not read.
    """
    out = _found(docs, id_col, text_col, shingle_words, percent, rows, seed)
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def first_of_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80, rows: int = ROWS, seed: int = 7) -> DataFrame:
    """The rows of docs, all columns, without those whose component has a smaller id.

    Of a component without ids one text stays. Rows equal in id and text stay or go together; of rows that
    share an id but no text each has its own component. Rows without words stay. The keys to drop are
    broadcast up to BROADCAST_KEYS, so that no text moves; beyond that the join shuffles.
    """
    found = _found(docs, id_col, text_col, shingle_words, percent, rows, seed)
    stays = (F.col("n_shingles") == 0) | F.coalesce(F.col("id") == F.col("component"), F.lit(False)) | (F.col("component").isNull() & (F.col("row") == F.col("lead")))
    drop = found.groupBy(F.col("id").alias(_ID), F.col("t").alias(_KEY)).agg(F.max(stays).alias("stays")).where("not stays").drop("stays")
    drop = _few(Staged(drop, "copies").df)
    return docs.join(drop, F.col(id_col).cast("long").eqNullSafe(F.col(_ID)) & (text_key(F.col(text_col)) == F.col(_KEY)), "left_anti")
