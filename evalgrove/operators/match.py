"""Mapping answers to taxonomy nodes: direct measures, nearest neighbours, and the cascade.

nodes: (label, path, depth, ord, norm), ord being the place of the label in code-point order. It is a
reference table; it is broadcast only while it has at most BROADCAST_NODES rows. Beyond it equi-joins shuffle, and
searches take the nodes in blocks of that size.
Predictions are matched once per distinct text.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from evalgrove.functions import metrics as M
from evalgrove.functions import text as T
from evalgrove.functions.stem import stem_words
from evalgrove.sources.staging import staged

BROADCAST_NODES = 200_000
#: Vectors of nodes that are broadcast at once, and numbers in them: 16 MB.
BLOCK_VECTORS = 50_000
BLOCK_NUMBERS = 2_000_000


def hinted(nodes: DataFrame) -> DataFrame:
    """nodes with a broadcast hint if they are few enough; the count reads one narrow column."""
    return F.broadcast(nodes) if nodes.limit(BROADCAST_NODES + 1).count() <= BROADCAST_NODES else nodes


def attached(rows: DataFrame, mapped: DataFrame) -> DataFrame:
    """rows with what their texts were mapped to, null where that is nothing; mapped has a row for each distinct text.

    It is written and, under the bound, broadcast: rows stay where they are, and a text that very many of them have
    doesn't bring them all to one task.
    """
    return rows.join(hinted(staged(mapped, "mapped")), "text", "left")


def _compared(text: Column, stem: bool) -> Column:
    """A text as direct measures compare it, or the stems of its words."""
    key = T.normalize_scores(text)
    return stem_words(key) if stem else key


def exact_hits(texts: DataFrame, nodes: DataFrame, stem: bool = False) -> DataFrame:
    """(text, label, path, ord, score) where cleaned text and label are equal after normalisation: an equi-join."""
    keyed = nodes.select("label", "path", "ord", _compared(F.col("label"), stem).alias("_k"))
    asked = texts.withColumn("_t", _compared(T.clean_full(F.col("text")), stem))
    return asked.join(keyed, F.col("_t") == F.col("_k")).select("text", "label", "path", "ord", F.lit(1.0).alias("score"))


def _in_blocks(nodes: DataFrame, size: int) -> Iterator[DataFrame]:
    """The rows of a reference table with ord, at most about size of them at a time."""
    blocks = max(1, -(-nodes.count() // size))
    for b in range(blocks):
        yield nodes.where(F.pmod(F.xxhash64("ord"), F.lit(blocks)) == b) if blocks > 1 else nodes


def _tuples(block: DataFrame) -> list[tuple]:
    return [tuple(r) for r in block.collect()]


def _by_blocks(rows: DataFrame, nodes: DataFrame, task: Callable, schema: str, size: int, pack: Callable = _tuples) -> DataFrame:
    """rows through task(shared) for each block of nodes, which goes out packed as one broadcast; several blocks are written one by one."""
    parts = []
    for block in _in_blocks(nodes, size):
        shared = rows.sparkSession.sparkContext.broadcast(pack(block))
        parts.append(rows.mapInArrow(task(shared), schema))
    return parts[0] if len(parts) == 1 else reduce(DataFrame.unionByName, [staged(p, "block") for p in parts])


def _spotter(shared):
    """Adds to each text the ords of the labels that are part of it, found in one scan by an automaton over all labels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        owners: dict[str, list[int]] = {}
        for ord_, label in shared.value:
            owners.setdefault(label, []).append(ord_)
        everywhere = owners.pop("", [])
        automaton = ahocorasick.Automaton()
        for label, ords in owners.items():
            automaton.add_word(label, ords)
        automaton.make_automaton()
        for batch in batches:
            found = []
            for t in batch.column("_t").to_pylist():
                # the lists themselves are few and shared: each is counted once a text
                seen = {id(ords): ords for _, ords in automaton.iter(t)} if owners and t else {}
                found.append([o for ords in (everywhere, *seen.values()) for o in ords])
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(found, pa.list_(pa.int64()))], ["text", "ords"])

    return run


def contained_hits(texts: DataFrame, nodes: DataFrame, stem: bool = False) -> DataFrame:
    """The same where the label is part of the text, inside words too; the empty label is part of every text.

    An automaton over the labels goes out under the bound of BROADCAST_NODES, in blocks beyond it, and each text is
    scanned once a block. A row holds a text and what was found; only hits become rows of their own.
    """
    labels = nodes.select("ord", _compared(F.col("label"), stem).alias("_k"))
    asked = texts.select("text", _compared(T.clean_full(F.col("text")), stem).alias("_t"))
    found = _by_blocks(asked, labels, _spotter, "text string, ords array<long>", BROADCAST_NODES)
    hits = found.select("text", F.explode("ords").alias("_o"))
    named = nodes.select("label", "path", "ord")
    return hits.join(hinted(named), F.col("_o") == F.col("ord")).select("text", "label", "path", "ord", F.lit(1.0).alias("score"))


MEASURES = {"exact_match": exact_hits, "contained": contained_hits}


def direct(texts: DataFrame, nodes: DataFrame, measure: str = "exact_match", stem: bool = False) -> DataFrame:
    """(text, predicted_node, predicted_path, mapping_method): of the nodes that hit the last in order; null without a hit.

    With stem the stems of words are compared.
    """
    best = MEASURES[measure](texts, nodes, stem).groupBy("text").agg(F.max_by(F.struct("label", "path"), "ord").alias("b"))
    best = best.select(F.col("text").alias("_m"), F.col("b.label").alias("predicted_node"), F.col("b.path").alias("predicted_path"))
    method = F.when(F.col("predicted_node").isNotNull(), measure)
    return texts.join(best, F.col("text") == F.col("_m"), "left").drop("_m").withColumn("mapping_method", method)


def top_k(texts: DataFrame, nodes: DataFrame, hits: DataFrame, k: int, last_wins: bool = True) -> DataFrame:
    """(text, rank, label, path, score): the k best nodes of each text, those without a hit at score 0.

    Only hits and the k nodes that ties at 0 fall to are ranked, never all nodes.
    """
    order = F.col("ord").desc() if last_wins else F.col("ord").asc()
    rest = nodes.orderBy(order).limit(k).select("label", "path", "ord", F.lit(0.0).alias("score"))
    pool = hits.select("text", "label", "path", "ord", "score").unionByName(texts.select("text").crossJoin(F.broadcast(rest)))
    pool = pool.groupBy("text", "ord").agg(F.max("score").alias("score"), F.first("label").alias("label"), F.first("path").alias("path"))
    place = F.row_number().over(Window.partitionBy("text").orderBy(F.col("score").desc(), order))
    return pool.withColumn("rank", place).where(F.col("rank") <= k).select("text", "rank", "label", "path", "ord", "score")


def _overlapper(shared, k: int | None):
    """The k labels of each text, or all, that have the largest share of their n-grams in it, ties by ord."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = sorted(shared.value)
        ords, size = np.array([n[0] for n in nodes], np.int64), np.array([len(n[1]) for n in nodes], np.int64)
        holders: dict[str, list[int]] = {}
        for i, (_, grams) in enumerate(nodes):
            for g in grams:
                holders.setdefault(g, []).append(i)
        places = {g: np.array(p) for g, p in holders.items()}
        met = np.zeros(len(nodes), np.int64)
        for batch in batches:
            found = []
            for grams in batch.column("grams").to_pylist():
                lists = [places[g] for g in grams or () if g in places]
                for p in lists:
                    met[p] += 1
                some = np.unique(np.concatenate(lists)) if lists else np.empty(0, np.int64)
                score = met[some] / size[some]
                met[some] = 0
                if k and len(some) > k:
                    least = np.partition(score, len(some) - k)[len(some) - k]
                    some, score = some[score >= least], score[score >= least]
                best = np.lexsort((some, -score))[:k]
                found.append([{"ord": o, "score": x} for o, x in zip(ords[some[best]].tolist(), score[best].tolist())])
            kind = pa.list_(pa.struct([("ord", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("text"), pa.array(found, kind)], ["text", "best"])

    return run


def lexical_hits(texts: DataFrame, nodes: DataFrame, k: int | None = None, n: int = 2) -> DataFrame:
    """(text, label, path, ord, score): the nodes that share an n-gram with the text, or the k of them with the largest share of the label's n-grams.

    The nodes' n-grams go out under the bound of BROADCAST_NODES, in blocks beyond it, each block's k best being
    candidates. Shares are counted in the task that holds the text, so an n-gram that very many labels and texts have costs
    additions but no rows: nothing is shuffled by n-gram.
    """
    of_nodes = nodes.select("ord", T.ngrams(F.col("norm"), n).alias("grams")).where(F.size("grams") > 0)
    asked = texts.select("text", T.ngrams(T.normalize_match(T.clean_light(F.col("text"))), n).alias("grams"))
    found = _by_blocks(asked, of_nodes, lambda shared: _overlapper(shared, k), "text string, best array<struct<ord:bigint,score:double>>", BROADCAST_NODES)
    hits = found.select("text", F.inline("best")).withColumnRenamed("ord", "_o")
    return hits.join(hinted(nodes.select("label", "path", "ord")), F.col("_o") == F.col("ord")).select("text", "label", "path", "ord", "score")


#: Ways to find the candidates of the cascade: functions of (texts, nodes, k) that return (text, label, path, ord, score).
SIMILARITIES = {"bigrams": lexical_hits}


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(length > 0, length, 1)


class _Cells:
    """Vectors by the pivot of least angle, with the range of angles of each cell.

    By the triangle inequality no vector of a cell is nearer to a query than the query's angle to the pivot is outside that
    range: a cell whose bound lies beyond the k-th best so far is skipped, and no answer is lost.
    """

    def __init__(self, rows: list[tuple] | tuple[np.ndarray, np.ndarray], pivots: int):
        ords, raw = rows if isinstance(rows, tuple) else (np.array([r[0] for r in rows], np.int64), np.array([r[1] for r in rows], np.float64))
        order = np.argsort(ords, kind="stable")
        self.ords, self.raw = ords[order], raw[order]
        self.unit = _unit(self.raw)
        count = max(1, min(pivots, len(ords)))
        # every so-many-th vector, and once more the mean of its cell, which lies in its middle
        centre = self.unit[np.linspace(0, len(ords) - 1, count).astype(int)]
        of, _ = self._dealt(centre)
        members = [np.flatnonzero(of == c) for c in range(count)]
        self.centre = _unit(np.stack([self.unit[m].sum(axis=0) if len(m) else centre[c] for c, m in enumerate(members)]))
        of, angle = self._dealt(self.centre)
        self.members = [np.flatnonzero(of == c) for c in range(count)]
        self.low = np.array([angle[m].min() if len(m) else np.inf for m in self.members])
        self.high = np.array([angle[m].max() if len(m) else -np.inf for m in self.members])

    def _dealt(self, centre: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest pivot of each vector and its angle to it, a few vectors at a time."""
        of, angle = np.empty(len(self.raw), np.int64), np.empty(len(self.raw))
        for at in range(0, len(self.raw), 2048):
            near = self.unit[at : at + 2048] @ centre.T
            of[at : at + 2048] = near.argmax(axis=1)
            angle[at : at + 2048] = _angles(near.max(axis=1))
        return of, angle

    def search(self, queries: np.ndarray, k: int) -> tuple[list, int]:
        """((ord, score) of the k best of each query, pairs computed)."""
        unit = _unit(queries)
        to = _angles(unit @ self.centre.T)
        most = np.cos(np.clip(np.maximum(to - self.high, self.low - to), 0, np.pi))  # the largest cosine that a cell allows
        most[:, [len(m) == 0 for m in self.members]] = -np.inf
        best: list[list] = [[] for _ in queries]
        limit = np.full(len(queries), -2.0)
        pairs = 0
        order = np.argsort(-most, axis=1, kind="stable")
        for turn in range(len(self.members)):
            cell = order[:, turn]
            allowed = most[np.arange(len(queries)), cell]
            within = np.isfinite(allowed) & (allowed >= limit - SLACK)
            if not within.any():
                break
            for c in np.unique(cell[within]):
                who = np.flatnonzero(within & (cell == c))
                members = self.members[c]
                cosine = unit[who] @ self.unit[members].T
                pairs += cosine.size
                for row, q in zip(cosine, who):
                    some = np.flatnonzero(row >= limit[q] - SLACK)
                    best[q] = sorted(best[q] + list(zip((-row[some]).tolist(), members[some].tolist())))
                    if len(best[q]) >= k:
                        limit[q] = -best[q][k - 1][0]
                        best[q] = [x for x in best[q] if -x[0] >= limit[q] - SLACK]
        return [self._scored(q, [i for _, i in found], k) for q, found in zip(queries, best)], pairs

    def _scored(self, query: np.ndarray, places: list[int], k: int) -> list[tuple[int, float]]:
        """Candidates, near ties of the k-th among them, by the dot product in a fixed order of summation, ties by ord."""
        score = (self.raw[places] * query).sum(axis=1)
        order = np.lexsort((self.ords[places], -score))[:k]
        return [(int(self.ords[places[i]]), float(score[i])) for i in order]


#: Cosines nearer than this to the k-th best are compared anew: more than rounding and lengths near 1 can change.
SLACK = 1e-6
#: Pivots that a block of vectors is dealt by.
PIVOTS = 256


def _angles(cosines: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosines, -1, 1))


def _vectors(block: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ords and vectors of a block as two arrays: a list of numbers takes four times the room."""
    found = block.toArrow().combine_chunks()
    values = found.column("_v").combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return found.column("ord").to_numpy(), flat.reshape(len(values), -1) if len(values) else np.empty((0, 1))


def _seeker(shared, key: str, vector: str, k: int, pivots: int, count):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = _Cells(shared.value, pivots) if len(shared.value[0]) else None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                vectors = np.array(batch.column(vector).to_pylist(), np.float64)
                found, pairs = cells.search(vectors, k) if cells else ([[]] * len(vectors), 0)
                if count is not None:
                    count.add(pairs)
                best = [[{"ord": o, "score": s} for o, s in row] for row in found]
                kind = pa.list_(pa.struct([("ord", pa.int64()), ("score", pa.float64())]))
                yield pa.RecordBatch.from_arrays([batch.column(key), pa.array(best, kind)], [key, "best"])

    return run


def nearest(queries: DataFrame, nodes: DataFrame, k: int, key: str = "id", vector: str = "embedding", block: int = BLOCK_VECTORS, pivots: int = PIVOTS, computed=None) -> DataFrame:
    """(key, rank, label, ord, score): the k nodes of largest cosine of unit vectors, ties by ord. Exact; rows without a vector are left out.

    nodes (label, ord, embedding) go out a block at a time, dealt by pivots, see _Cells; a task keeps k rows a query
    before anything is shuffled, and the blocks' best are ranked once more. computed, an accumulator, takes the
    number of pairs whose cosine was needed.
    """
    held = nodes.where(F.col(vector).isNotNull()).select(F.col("ord").cast("long").alias("ord"), F.col(vector).cast("array<double>").alias("_v"))
    asked = queries.where(F.col(vector).isNotNull()).select(key, F.col(vector).cast("array<double>").alias(vector))
    schema = StructType([asked.schema[key], StructField("best", ArrayType(StructType([StructField("ord", LongType()), StructField("score", DoubleType())])))])
    if held.isEmpty():
        return queries.limit(0).select(key, F.lit(0).alias("rank")).join(nodes.limit(0).select("label", "ord")).withColumn("score", F.lit(0.0))
    block = max(1, min(block, BLOCK_NUMBERS // max(1, held.select(F.size("_v")).first()[0])))
    found = _by_blocks(asked, held, lambda shared: _seeker(shared, key, vector, k, pivots, computed), schema, block, _vectors)
    order = Window.partitionBy(key).orderBy(F.col("score").desc(), "_o")
    found = found.select(key, F.inline("best")).withColumnRenamed("ord", "_o").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return found.join(hinted(nodes.select("label", "ord")), F.col("_o") == F.col("ord")).select(key, "rank", "label", "ord", "score")


def encode_with(client: Callable[[list[str]], Sequence[Sequence[float]]], text: str, batch: int = 256) -> Callable[[DataFrame], DataFrame]:
    """Adds embedding, the unit vector that client(texts) gives for a column, asked on the executors a batch at a time.

    A vector of zeros stays one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                vectors = np.asarray(client(part.column(text).to_pylist()), np.float64)
                length = np.linalg.norm(vectors, axis=1, keepdims=True)
                unit = vectors / np.where(length > 0, length, 1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(unit), pa.list_(pa.float64()))], [*part.schema.names, "embedding"])

    return lambda rows: rows.mapInArrow(run, StructType([*rows.schema.fields, StructField("embedding", ArrayType(DoubleType()))]))


def cosine_candidates(texts: DataFrame, nodes: DataFrame, vectors: DataFrame, encode: Callable[[DataFrame], DataFrame], k: int) -> DataFrame:
    """(text, rank, label, path, ord, score): the k nodes nearest each text. vectors: (label, ord, embedding) of the nodes."""
    # written, for each block of nodes reads the texts' vectors again
    asked = staged(encode(texts.select("text")), "vectors")
    paths = nodes.select(F.col("ord").alias("_o"), "path")
    return nearest(asked, vectors, k, key="text").join(paths, F.col("ord") == F.col("_o")).select("text", "rank", "label", "path", "ord", "score")


def _deepest(candidates: Column, method: str) -> Column:
    """struct(node, path, method) of the deepest of structs with depth and rank, the first of several; null of none."""
    ranked = F.transform(candidates, lambda x: F.struct((-x["depth"]).alias("d"), x["rank"].alias("r"), F.struct(x["label"].alias("node"), x["path"].alias("path"), F.lit(method).alias("method")).alias("x")))
    return F.array_min(ranked)["x"]


def voted(candidates: Column, votes: int = 2) -> Column:
    """The deepest label that more than votes of the candidates' paths have at the same depth from the root."""
    steps = F.flatten(F.transform(candidates, lambda x: F.transform(F.reverse(x["path"]), lambda a, i: F.struct(i.alias("i"), a.alias("a")))))
    counted = F.transform(F.array_distinct(steps), lambda s: F.struct(s["i"].alias("i"), F.size(F.filter(steps, lambda t: t == s)).alias("n"), s["a"].alias("a")))
    return F.array_max(F.filter(counted, lambda s: s["n"] > votes))["a"]


def cascade(texts: DataFrame, nodes: DataFrame, candidates: DataFrame, min_score: float | None = None, top2: float = 0.001, topk: float = 0.005, votes: int = 2) -> DataFrame:
    """(text, predicted_node, predicted_path, mapping_method) by the first stage that finds a node.

    candidates: (text, rank, label, path, ord, score), a few a text. The stages: a candidate equal to the
    text; for n = 4..1 a candidate that shares an n-gram, then any node whose whole label is one of the
    text's n-grams; nothing, if the best score is below min_score; if scores are ambiguous, the ancestor
    that most candidates share; the first candidate. The deepest node of a stage wins.
    """
    sizes = (4, 3, 2, 1)
    info = nodes.select(F.col("ord").alias("_o"), "norm", "depth", *[T.ngrams(F.col("norm"), n).alias(f"g{n}") for n in sizes])
    packed = candidates.join(info, F.col("ord") == F.col("_o")).groupBy("text").agg(F.array_sort(F.collect_list(F.struct("rank", "label", "path", "norm", "depth", "score", *[f"g{n}" for n in sizes]))).alias("top"))
    texts = texts.select("text").distinct().withColumn("p", T.normalize_match(T.clean_light(F.col("text"))))
    texts = texts.withColumns({f"p{n}": T.ngrams(F.col("p"), n) for n in sizes})
    grams = F.concat(*[F.transform(f"p{n}", lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"))) for n in sizes])
    full = nodes.where(F.col("norm") != "").select("label", "path", "ord", "norm", "depth")
    whole = texts.select("text", F.explode(grams).alias("x")).select("text", "x.n", "x.g").join(full, F.col("g") == F.col("norm"))
    whole = whole.groupBy("text", "n").agg(F.max_by(F.struct("label", "path"), F.struct("depth", -F.col("ord"))).alias("b"))
    named = F.struct(F.col("b.label").alias("node"), F.col("b.path").alias("path"), F.concat(F.lit("ngram_match_"), F.col("n").cast("string")).alias("method"))
    whole = whole.groupBy(F.col("text").alias("_t")).agg(F.map_from_entries(F.collect_list(F.struct("n", named.alias("node")))).alias("whole"))
    row = texts.join(packed, "text").join(whole, F.col("text") == F.col("_t"), "left")

    # each stage is a struct(node, path, method) or null; the first that isn't null counts
    top = F.col("top")
    stages = [_deepest(F.filter(top, lambda x: (x["norm"] == F.col("p")) & (x["norm"] != "")), "exact_match_in_top_k")]
    for n in sizes:
        stages += [_deepest(F.filter(top, lambda x: F.arrays_overlap(F.col(f"p{n}"), x[f"g{n}"])), f"ngram_topk_match_{n}"), F.try_element_at("whole", F.lit(n))]
    scores = F.transform(top, lambda x: x["score"])
    nothing = F.lit(None).cast("array<string>").alias("path")
    if min_score is not None:
        stages.append(F.when(F.array_max(scores) < min_score, F.struct(F.lit(None).cast("string").alias("node"), nothing, F.lit("none").alias("method"))))
    vote = F.filter(F.array(voted(top, votes)), lambda v: v.isNotNull() & M.is_ambiguous(M.softmax(scores), top2, topk))
    stages.append(F.get(F.transform(vote, lambda v: F.struct(v.alias("node"), nothing, F.lit("voting").alias("method"))), F.lit(0)))
    stages.append(F.get(F.transform(top, lambda x: F.struct(x["label"].alias("node"), x["path"].alias("path"), F.lit("top_score").alias("method"))), F.lit(0)))
    out = row.select("text", F.coalesce(*stages).alias("f")).select("text", F.col("f.node").alias("predicted_node"), F.col("f.path").alias("_path"), F.col("f.method").alias("mapping_method"))
    # the root may be voted for but is no node: it stays without a path
    by_label = nodes.select(F.col("label").alias("_l"), F.col("path").alias("_voted"))
    return out.join(by_label, F.col("predicted_node") == F.col("_l"), "left").select("text", "predicted_node", F.coalesce("_path", "_voted").alias("predicted_path"), "mapping_method")
