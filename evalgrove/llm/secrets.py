"""Secret scans with corpus-wide ownership, in DataFrame operations only.

Base rules find assignments, access keys and long hex runs. Beside them any long token that mixes letters
and digits is a candidate. Candidates' hashes are counted over the corpus by distinct repositories (here
documents) and owners (here sources): a value that many owners hold, or many repositories even of one owner, is a
widely copied example; one in few places is specific to its owner and looks live. Live tokens become spans of
kind token; base spans stay spans either way and carry the verdict.

Positions come from splitting the text at the matches: a match starts where the pieces and matches
before it end. That sum runs over rows, one a match, in a window of one text; no array grows by copying.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Staged

#: Fixed patterns of the base rules, in their listed order; group 2 of the first is the secret.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: The method's own candidates: long tokens, of which those without a letter or a digit are dropped.
TOKEN = r"[A-Za-z0-9_-]{24,}"
KINDS = ("assign", "access", "hex", "token")
MIN_ASSIGN = 6
#: Owners, and repositories of all owners, up to which a value looks live.
MAX_OWNERS = 2
MAX_REPOSITORIES = 50

#: Names that no column of documents has.
_ID, _SPANS = "_evalgrove_id", "_evalgrove_spans"


def _matches(text: Column, kind: str) -> Column:
    """array<struct<kind, gap, len, value>> of all matches: gap is the length of the text before since the last."""
    pattern = {"assign": ASSIGN, "access": ACCESS, "hex": HEX, "token": TOKEN}[kind]
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(2)) if kind == "assign" else whole
    gaps = F.transform(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole)), F.length)
    zipped = F.arrays_zip(gaps.alias("gap"), F.transform(whole, F.length).alias("len"), value.alias("value"))
    out = F.transform(zipped, lambda x: F.struct(F.lit(kind).alias("kind"), x["gap"].cast("long").alias("gap"), x["len"].cast("long").alias("len"), x["value"].alias("value")))
    return F.when(F.regexp_like(text, F.lit(pattern)), out).otherwise(F.array().cast("array<struct<kind:string,gap:bigint,len:bigint,value:string>>"))


def matched(docs: DataFrame, id_col: str, text_col: str, source_col: str, repository_col: str) -> Staged:
    """(row, id, source, repository, found): all matches of each row, written so that rows keep their numbers."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(repository_col).alias("repository"), F.concat(*[_matches(text, k) for k in KINDS]).alias("found"))
    return Staged(rows.withColumn("row", F.monotonically_increasing_id()), "matches")


def candidates(rows: DataFrame) -> DataFrame:
    """(row, kind, start, end, value, source, repository) of every base span and token candidate among matched() rows."""
    each = rows.select("row", "source", "repository", F.posexplode("found").alias("n", "m")).select("row", "source", "repository", "n", "m.*")
    so_far = Window.partitionBy("row", "kind").orderBy("n")
    each = each.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far)).withColumn("start", F.col("end") - F.col("len"))
    real = (
        F.when(F.col("kind") == "assign", F.length("value") >= MIN_ASSIGN)
        .when(F.col("kind") == "token", F.regexp_like("value", F.lit("[0-9]")) & F.regexp_like("value", F.lit("[A-Za-z]")))
        .otherwise(True)
    )
    return each.where(real).select("row", "kind", "start", "end", "value", "source", "repository")


def ownership(found: DataFrame) -> DataFrame:
    """(hash, repositories, owners) of each candidate value: how many documents and sources hold it.

    Rows without a repository are one each.
    """
    key = F.xxhash64("value")
    row = F.when(F.col("repository").isNull(), F.col("row"))
    held = found.groupBy(key.alias("hash"), "source", "repository", row.alias("alone")).agg(F.lit(1).alias("one")).groupBy("hash", "source").agg(F.count("*").alias("n"))
    return held.groupBy("hash").agg(F.sum("n").alias("repositories"), F.count("*").alias("owners"))


def spans_of(rows: DataFrame, max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(row, spans) of the matched() rows that hold a span; spans sorted by start, then kind as listed.

    A span is struct(start, rank, end, kind, hash, repositories, owners, live, reach) in code points, end
    exclusive; reach is the furthest end of the spans before it. Tokens that aren't live, or that overlap a
    base span, are no spans. A null or empty text has none. A null source is an owner of its own.
    """
    found = Staged(candidates(rows), "secrets").df
    owned = ownership(found).withColumnRenamed("hash", "h")
    spans = found.withColumn("hash", F.xxhash64("value")).join(owned, F.col("hash") == F.col("h")).drop("h", "value")
    live = (F.col("owners") <= max_owners) & (F.col("repositories") <= max_repositories)
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    spans = spans.withColumns({"rank": rank, "live": live})
    # a token that overlaps a base span: the furthest end of a base span that starts before the token ends
    by_row = Window.partitionBy("row").orderBy("start", "rank")
    base = F.col("kind") != "token"
    earlier = by_row.rowsBetween(Window.unboundedPreceding, 0)
    later = by_row.rowsBetween(0, Window.unboundedFollowing)
    spans = spans.withColumn("base_end", F.max(F.when(base, F.col("end"))).over(earlier)).withColumn("next", F.min(F.when(base, F.col("start"))).over(later))
    lone = (F.coalesce("base_end", F.lit(0)) <= F.col("start")) & (F.coalesce(F.col("next") >= F.col("end"), F.lit(True)))
    spans = spans.where(base | (lone & F.col("live")))
    spans = spans.withColumn("reach", F.coalesce(F.max("end").over(by_row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast("long")))
    span = F.struct("start", "rank", "end", "kind", "hash", "repositories", "owners", "live", "reach")
    return spans.groupBy("row").agg(F.array_sort(F.collect_list(span)).alias("spans"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """(id, source, spans) of every row, spans as in spans_of(), empty where there are none.

    Rows that repeat, id included, are rows of their own; those of one id are one repository, each without an id is one.
    """
    rows = matched(docs, id_col, text_col, source_col, id_col).df
    found = spans_of(rows, max_owners, max_repositories)
    found = found.select(F.col("row").alias("of"), "spans")
    out = rows.drop("found").join(found, F.col("row") == F.col("of"), "left")
    return out.select(F.col("id").alias(id_col), "source", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def text_of(spans: Column, base_only: bool) -> Column:
    """kind:start:end of the spans, comma-joined."""
    if base_only:
        spans = F.filter(spans, lambda x: x["kind"] != "token")
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """Per row: counts of each kind, digest of the base spans, all spans, and how many values look live.

    Null and empty texts have no spans. Rows that repeat an id, or have none, each keep their own spans.
    """
    rows = scan(docs, id_col, text_col, source_col, max_owners, max_repositories)
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    return rows.select(
        id_col, count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(text_of(F.col("spans"), True), 256).alias("base_sha256"), text_of(F.col("spans"), False).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"), count("token").alias("n_token"),
    )


def redact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", mark: str = "[SECRET]", max_owners: int = MAX_OWNERS, max_repositories: int = MAX_REPOSITORIES) -> DataFrame:
    """docs with every span of text_col replaced by mark; overlapping spans by one.

    Spans depend on a row's text and on whole-corpus counts alone, so each text gets its own back by its digest:
    ids may repeat or be null, and only count repositories.
    """
    digest = F.unhex(F.sha2(F.col(text_col), 256))
    rows = matched(docs.select(digest.alias(_ID), F.col(text_col), F.col(source_col), F.col(id_col)), _ID, text_col, source_col, id_col).df
    found = spans_of(rows, max_owners, max_repositories)
    found = rows.select("row", F.col("id").alias(_ID)).join(found.withColumnRenamed("row", "of"), F.col("row") == F.col("of"))
    found = found.groupBy(_ID).agg(F.max("spans").alias(_SPANS))
    text, spans = F.col(text_col), F.col(_SPANS)
    gaps = F.filter(spans, lambda x: x["start"] >= x["reach"])
    before = F.transform(gaps, lambda x: F.substring(text, (x["reach"] + 1).cast("int"), (x["start"] - x["reach"]).cast("int")))
    reached = F.array_max(F.transform(spans, lambda x: x["end"]))
    rest = F.substring(text, (reached + 1).cast("int"), F.length(text))
    clean = F.concat(F.array_join(before, mark), F.lit(mark), rest)
    out = docs.join(found, digest == F.col(_ID), "left")
    return out.withColumn(text_col, F.when(F.size(spans) > 0, clean).otherwise(text)).drop(_ID, _SPANS)
