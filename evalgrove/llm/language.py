"""Language identification by cross-parsing against suffix automata.

Each language has the suffix automaton of a sample of its labelled text. A text is parsed greedily into
the longest phrases that occur in the sample; the fewer phrases it needs, the more of it the sample
explains. Phrase counts are normalised to bits, each phrase costing the logarithm of the sample's size
per character of the text, and the language of least cost wins.

Each automaton is a sorted array of its transitions by state and character, about a megabyte. For the parse the
commonest characters get columns in a table; the others are looked up in the array, so no script is left out. Where a
state has no transition on a character the phrase ends and the next begins with that character, so the table goes on
from the root and the step counts one phrase; a character that the sample lacks is a phrase of its own. A worker
holds few tables at a time and makes those of further languages anew for each million characters, so some hundreds
of languages fit into its memory.

Texts are laid out in rows of CUT characters and all rows of a batch advance together, a character at a time,
in every language. A row that continues a text begins where the row before it ended: it is first parsed from
the root, and again from the true state wherever that differs, until no row's beginning changes. Parses meet after
a phrase or two, so the second round mostly is the last; the phrases are those of the whole text, of any length.

The sample is bounded by two parameters: of each language docs_per_language documents of least id hash, chars characters in all.
They are shared out evenly, what short documents leave going to longer ones; of a document with more than its
share, pieces of about PIECE characters are taken, evenly spaced from its beginning to its end.

A text is in a language only if it costs no more bits a character than labelled texts of like length do.
limits() measures that within the sample: what one half of a language's documents costs by the automaton of
the other half, against the same pieces with their characters shuffled, which are of no language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import slices

#: Labelled documents of each language, and characters of them, that its automaton is built from.
DOCS = 60
CHARS = 30_000
PIECE = 250
#: Characters that get a column of their own in a language's table; rarer ones are looked up.
ALPHABET = 63
#: Characters of a text parsed in one row; a layout that changes no result.
CUT = 2048
#: Characters parsed in one go.
BATCH = 1_000_000
#: Tables that a worker holds at a time, of some 11 MB each.
TABLES = 8
UNDETERMINED = "und"
#: Lengths in characters for which limits are measured, and pieces of a language measured at each.
LENGTHS = tuple(4 << k for k in range(9))
PIECES = 200


def held_out(id_column):
    """Column: rows that no model learns from."""
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(5)) == 0


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the automaton that accepts all substrings of the sequence; state 0 is its root."""
    nxt: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in codes:
        cur = len(nxt)
        nxt.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p >= 0:
            q = nxt[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(nxt)
                nxt.append(dict(nxt[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nxt[p].get(c) == q:
                    nxt[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return nxt


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)


class Rows:
    """Rows of symbols side by side, the longest first: grid is (place, row), alive how many rows have a symbol at each place."""

    def __init__(self, rows: list[np.ndarray]):
        sizes = np.array([len(r) for r in rows])
        self.order = np.argsort(-sizes, kind="stable")
        longest = int(sizes[self.order[0]])
        self.grid = np.zeros((longest, len(rows)), np.int32)
        for place, i in enumerate(self.order.tolist()):
            self.grid[: sizes[i], place] = rows[i]
        self.alive = np.searchsorted(-sizes[self.order], -np.arange(longest), side="left")


class Automaton:
    """One language's automaton: its transitions as arrays in order, and the table of its commonest characters, made from them.

    Transition k leads from state keys[k] // symbols on symbol keys[k] % symbols to moves[k] >> 1; moves[k] & 1 tells
    that a phrase begins with it. Symbols are the language's own, by falling count; 0 is a character that its sample lacks.
    """

    def __init__(self, sample: np.ndarray, known: int):
        """sample: symbols that all languages share; known: how many there are."""
        found, counts = np.unique(sample, return_counts=True)
        found = found[np.lexsort((found, -counts))]
        self.own = np.zeros(known, np.int32)
        self.own[found] = np.arange(1, len(found) + 1)
        self.symbols = len(found) + 1
        self.width = min(len(found), ALPHABET) + 1
        nxt = suffix_automaton(self.own[sample].tolist())
        self.states = len(nxt)
        keys = np.array([s * self.symbols + c for s, to in enumerate(nxt) for c in to], np.int64)
        moves = np.array([2 * t + (s == 0) for s, to in enumerate(nxt) for t in to.values()], np.int32)
        order = np.argsort(keys)
        self.keys, self.moves = keys[order], moves[order]

    def table(self) -> np.ndarray:
        """Move by state * width + symbol. Without a transition the phrase ends and the next begins, so the root's move stands there."""
        state, symbol = np.divmod(self.keys, self.symbols)
        near = symbol < self.width
        root = np.ones(self.width, np.int32)
        root[symbol[near & (state == 0)]] = self.moves[near & (state == 0)]
        out = np.tile(root, (self.states, 1))
        out[state[near], symbol[near]] = self.moves[near]
        return out.ravel()

    def rare(self, states: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """Moves on symbols without a column: by their own transition, else by the root's."""

        def find(key):
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            return self.keys[at] == key, self.moves[at]

        own, there = find(states.astype(np.int64) * self.symbols + symbols)
        known, begun = find(symbols.astype(np.int64))
        return np.where(own, there, np.where(known, begun, 1)).astype(np.int32)


class Model:
    """The automata of all languages, a megabyte each, and the tables of at most TABLES of them; other tables are made when they are needed."""

    def __init__(self, samples: dict[str, list[str]]):
        self.languages = sorted(samples)
        texts = [np.concatenate([np.append(_codes(t), 0x0A) for t in samples[lang]]) for lang in self.languages]
        chars = np.unique(np.concatenate([*texts, np.zeros(0, np.uint32)]))
        self.symbol = np.zeros(0x110000, np.int32)
        self.symbol[chars] = np.arange(1, len(chars) + 1)
        self.automata = [Automaton(self.symbol[t], len(chars) + 1) for t in texts]
        self.bits = [np.log2(max(2, len(t))) for t in texts]
        self._tables: dict[int, np.ndarray] = {}

    def _table(self, j: int) -> np.ndarray:
        if j in self._tables:
            return self._tables[j]
        table = self.automata[j].table()
        if len(self._tables) < TABLES - 1:
            self._tables[j] = table
        return table

    def _parse(self, rows: Rows, j: int, table: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that begin in each row in language j, from the states in begin, and the states at the rows' ends."""
        automaton = self.automata[j]
        grid = automaton.own[rows.grid]
        far = grid >= automaton.width
        off = {t: np.flatnonzero(far[t]) for t in np.flatnonzero(far.any(axis=1)).tolist()}
        symbols = {t: grid[t, where] for t, where in off.items()}
        grid[far] = 0
        state = begin[rows.order].astype(np.int32)
        count = np.zeros(len(state), np.int64)
        for t, m in enumerate(rows.alive.tolist()):
            at = table[state[:m] * np.int32(automaton.width) + grid[t, :m]]
            if t in off:
                at[off[t]] = automaton.rare(state[off[t]], symbols[t])
            count[:m] += at & 1
            np.right_shift(at, 1, out=state[:m])
        phrases, end = np.empty_like(count), np.empty_like(state)
        phrases[rows.order], end[rows.order] = count, state
        return phrases, end

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases each text needs in each language. texts: symbols."""
        rows, owner = [], []
        for i, symbols in enumerate(texts):
            for at in range(0, len(symbols), CUT):
                rows.append(symbols[at : at + CUT])
                owner.append(i)
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        if not rows:
            return out
        owner = np.array(owner)
        follows = np.flatnonzero(owner[1:] == owner[:-1]) + 1
        laid = Rows(rows)
        for j in range(len(self.languages)):
            table = self._table(j)
            begin = np.zeros(len(rows), np.int32)
            count, end = self._parse(laid, j, table, begin)
            while True:
                late = follows[end[follows - 1] != begin[follows]]
                if not len(late):
                    break
                begin[late] = end[late - 1]
                count[late], end[late] = self._parse(Rows([rows[i] for i in late.tolist()]), j, table, begin[late])
            np.add.at(out[:, j], owner, count)
        return out

    def cost(self, texts: list[str | None]) -> np.ndarray:
        """Bits a character that each text costs in each language."""
        found, size, held, length = [], [], [], 0
        for text in texts:
            symbols = self.symbol[_codes(text or "")]
            size.append(max(1, len(symbols)))
            held.append(symbols)
            length += len(symbols)
            if length >= BATCH:
                found.append(self.phrases(held))
                held, length = [], 0
        found.append(self.phrases(held))
        return np.concatenate(found) * np.array(self.bits) / np.array(size)[:, None] if texts else np.zeros((0, len(self.languages)))

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """Language and score; the score is the share of the winner in 2 ** -(2 * cost)."""
        cost = self.cost(texts)
        names, scores = [], []
        for text, c in zip(texts, cost):
            if not len(c) or not text or not any(map(str.isalpha, text)):
                names.append(UNDETERMINED), scores.append(0.0)
                continue
            best = int(np.argmin(c))
            names.append(self.languages[best])
            scores.append(float(1 / np.exp2(-2 * (c - c[best])).sum()))
        return names, scores


def _limits_of(texts: list[str]) -> list[float]:
    """Bits a character that a text of each of LENGTHS may cost in the language of these texts.

    The middle between what 99 of 100 labelled pieces cost at most and the median of shuffled ones; where
    the two overlap, as in a few characters, the former, so that short clean texts stay. Languages of
    fewer than two documents can't be measured and have no limit: infinity.
    """
    model, other = Model({"": texts[::2]}), "\n".join(texts[1::2])
    rng = np.random.default_rng(0)
    out = []
    for size in LENGTHS:
        if not other:
            out.append(float("inf"))
            continue
        size = min(size, len(other))
        pieces = [other[at : at + size] for at in np.linspace(0, len(other) - size, PIECES).astype(int).tolist()]
        mixed = ["".join(p[i] for i in rng.permutation(len(p)).tolist()) for p in pieces]
        clean, junk = float(np.quantile(model.cost(pieces), 0.99)), float(np.median(model.cost(mixed)))
        out.append(max(clean, (clean + junk) / 2))
    return out


def _limiter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [_limits_of(texts) for texts in batch.column("texts").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(found, pa.list_(pa.float64()))], ["lang", "bits"])


def limits(spark: SparkSession, samples: dict[str, list[str]]) -> dict[str, list[float]]:
    """Bits a character that a text of each of LENGTHS may cost in each language; languages are dealt over the tasks."""
    rows = spark.createDataFrame(sorted(samples.items()), "lang string, texts array<string>")
    return {r["lang"]: r["bits"] for r in rows.mapInArrow(_limiter, "lang string, bits array<double>").collect()}


def in_language(model: Model, limit: dict[str, list[float]], texts: list[str | None]) -> list[bool]:
    """Whether each text has a letter and costs at most its best language's limit for its length."""
    out = []
    for text, c in zip(texts, model.cost(texts)):
        if not len(c) or not text or not any(map(str.isalpha, text)):
            out.append(False)
            continue
        best = int(np.argmin(c))
        out.append(bool(c[best] <= np.interp(np.log2(len(text)), np.log2(LENGTHS), limit[model.languages[best]])))
    return out


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS, chars: int = CHARS) -> dict[str, list[str]]:
    """The texts of each language that its automaton is built from: labelled, not held out, with text; by id hash, ties by id and text."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("id")) & (F.length("text") > 0))
    rows = rows.select("lang", "id", F.xxhash64("id").alias("h"), "text")
    first = Window.partitionBy("lang").orderBy("h", "id", "text")
    sample = rows.withColumn("n", F.row_number().over(first)).where(F.col("n") <= docs_per_language).withColumn("size", F.length("text"))
    # in order of size each document may take an equal part of what those before it leave
    rising = Window.partitionBy("lang").orderBy("size", "n")
    everything = Window.partitionBy("lang")
    left = F.lit(chars) - F.coalesce(F.sum("size").over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    level = F.floor(left / (F.count("*").over(everything) - F.row_number().over(rising) + 1))
    # the first document that is larger than its part sets the share of all after it
    sample = sample.withColumn("level", level)
    share = F.coalesce(F.min(F.when(F.col("size") > F.col("level"), F.struct("size", "n", "level"))).over(everything)["level"], F.col("size")).cast("int")
    sample = sample.withColumn("share", F.least("size", share)).where("share > 0")
    pieces = F.least(F.col("share"), F.greatest(F.lit(1), F.ceil(F.col("share") / PIECE).cast("int")))
    sample = sample.withColumn("pieces", F.when(F.col("size") > F.col("share"), F.greatest(pieces, F.lit(2))).otherwise(1))
    sample = sample.withColumn("piece", F.floor(F.col("share") / F.col("pieces")).cast("int"))
    start = lambda i: F.floor(i * (F.col("size") - F.col("piece")) / F.greatest(F.col("pieces") - 1, F.lit(1))).cast("int") + 1
    cut = F.array_join(F.transform(F.sequence(F.lit(0), F.col("pieces") - 1), lambda i: F.substring(F.col("text"), start(i), F.col("piece"))), "\n")
    sample = sample.select("lang", "n", cut.alias("text"))
    samples: dict[str, list[str]] = {}
    for r in sorted(sample.collect(), key=lambda r: (r["lang"], r["n"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return samples


#: The model of a worker process, kept from task to task: the sample travels, each worker builds the table once.
_BUILT: dict[str, Model] = {}


def _model(key: str, samples: dict[str, list[str]]) -> Model:
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = Model(samples)
    return _BUILT[key]


def _identifier(shared, key: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, shared.value)
        for batch in slices(batches):
            names, scores = model.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["id", "held_out", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS, chars: int = CHARS) -> DataFrame:
    """(id, held_out, lang_pred, score) of every row.

    A null text or one without a letter is "und" with score 0, and so is everything when nothing is
    labelled. Ties go to the language that sorts first. Null ids are not held out and not learned from.
    Rows that repeat are rows of their own. Other columns of docs are not read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(held_out(F.col(id_col)), F.lit(False)).alias("held_out"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    run = _identifier(*_shared_sample(docs, id_col, text_col, lang_col, docs_per_language, chars))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, lang_pred string, score double").withColumnRenamed("id", id_col)


def _shared_sample(docs: DataFrame, id_col: str, text_col: str, lang_col: str, docs_per_language: int, chars: int):
    sample = training_sample(docs, id_col, text_col, lang_col, docs_per_language, chars)
    key = xxhash.xxh3_128_hexdigest(repr(sorted(sample.items())).encode("utf-8", "surrogatepass"))
    return docs.sparkSession.sparkContext.broadcast(sample), key


def _keeper(shared, key: str, limit: dict[str, list[float]], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _model(key, shared.value)
        for batch in slices(batches):
            yield batch.filter(pa.array(in_language(model, limit, batch.column(text_col).to_pylist()), pa.bool_()))

    return run


def with_language(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS, chars: int = CHARS) -> DataFrame:
    """The rows of docs, all columns, whose text is in a learned language; one pass, nothing is shuffled.

    Junk and texts in languages that are not learned cost more than the limits() of the language nearest to
    them and go, as do texts that identify() gives no language. Below about 16 characters junk can't be
    told from clean text, and most of it stays. A language with fewer than two labelled documents has no
    limit: what is nearest to it stays.
    """
    shared, key = _shared_sample(docs, id_col, text_col, lang_col, docs_per_language, chars)
    return docs.mapInArrow(_keeper(shared, key, limits(docs.sparkSession, shared.value), text_col), docs.schema)
