"""The corpus operators' queries, each over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language, mixing, near_dedup, quality, resample, rules, search, secrets, spans, suffixes, warc
from .common import Folder, release, table


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, percent=85)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, table(spark, sf_dir, "labels")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = Folder(spark, "archive").path
    warc.write_archive(table(spark, sf_dir, "pages"), folder)
    release(spark)
    return warc.read_index(spark, folder).withColumnRenamed("id", "page_id")


def op8_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return rules.judge(docs, rules.train(docs, table(spark, sf_dir, "labels")))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of three sentences, however short, and passages; both are cut from the text.

    n_removed counts the pieces in passages of 20 words or more, n_short_removed those that only runs of three short sentences cover.
    """
    found = spans.deduplicate(table(spark, sf_dir, "documents"))
    kept, passages = F.coalesce("kept_text", F.lit("")), F.col("n_removed") - F.col("n_short")
    return found.select(
        "doc_id", "n_pieces", passages.alias("n_removed"), F.length(kept).cast("long").alias("kept_chars"), F.sha2(kept, 256).alias("kept_sha256"),
        F.col("n_short").alias("n_short_removed"),
    )


def op11_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.classes(table(spark, sf_dir, "documents"), digests=True)


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.rank(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return resample.rank(docs, resample.trained(docs, table(spark, sf_dir, "benchmark")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_near_dedup, op3_suffix_dedup, op4_secret_scan, op5_language, op6_quality, op7_warc, op8_rules,
        op9_decontaminate, op10_sentence_spans, op11_exact_dedup, op12_search, op13_resample,
    )
}

_LOW = "coalesce(translate({x}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
_BENCH_WORDS = "regexp_extract_all(" + _LOW.format(x="text") + ", '[0-9a-z\\x{80}-\\x{10FFFF}]+')"

_SECRETS = {
    "assign": r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]{16,}",
    "hex": "[0-9a-f]{24,}",
    "token": "[A-Za-z0-9_-]{24,}",
}
_MATCHES = " UNION ALL ".join(
    f"SELECT doc_id, source, {rank} AS rank, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS w, regexp_extract_all(t, '{p}', {2 if kind == 'assign' else 0}) AS v, string_split_regex(t, '{p}') AS g FROM d"
    for rank, (kind, p) in enumerate(_SECRETS.items(), 1)
)

ORACLE_SQL: dict[str, str] = {
    "op1_mix_sources": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, source_size * 3.0::DOUBLE AS most FROM s),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(most) OVER r, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER r, 0)) AS level FROM w
  WINDOW r AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT source, source_size, least(most, coalesce(min_by(level, most / weight) FILTER (WHERE most > level * weight) OVER () * weight, most)) AS target FROM l),
n AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) - 1 AS k,
  least(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END, 3.0::DOUBLE) AS rate,
  ('0x' || substr(md5(concat('1/', coalesce('s' || d.source, 'null'))), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, (floor(rate) + floor((k + 1) * (rate - floor(rate)) + u) - floor(k * (rate - floor(rate)) + u))::BIGINT AS copies FROM n)
SELECT doc_id, size, source_size, target, copies * size AS taken, source, copies FROM c
""",
    "op2_near_dedup": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOW.format(x="text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_distinct([array_to_string(w[i:i + least(len(w), 3) - 1], ' ') for i in range(1, greatest(len(w) - 2, 1) + 1)]) AS g FROM d WHERE len(w) > 0),
e AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
links AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p),
r(doc_id, low) AS (SELECT a, a FROM links UNION SELECT links.b, r.low FROM r JOIN links ON r.doc_id = links.a WHERE r.low < links.b),
c AS (SELECT doc_id, min(low) AS low FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(len(s.g), 0)::BIGINT AS n_shingles, coalesce(c.low, d.doc_id) AS component_id, coalesce(c.low, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN s ON d.doc_id = s.doc_id LEFT JOIN c ON d.doc_id = c.doc_id
""",
    "op4_secret_scan": f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
m AS ({_MATCHES}),
x AS (SELECT doc_id, source, rank, kind, i, length(w[i]) AS n, v[i] AS v, length(g[i]) AS gap FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0)),
y AS (SELECT *, sum(gap + n) OVER (PARTITION BY doc_id, kind ORDER BY i) AS e FROM x),
z AS (SELECT *, e - n AS s FROM y WHERE CASE kind WHEN 'assign' THEN length(v) >= 6 WHEN 'token' THEN regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') ELSE TRUE END),
o AS (SELECT v, count(DISTINCT doc_id) <= {secrets.MAX_REPOSITORIES} AND count(DISTINCT coalesce('s' || source, 'null')) <= {secrets.MAX_OWNERS} AS live FROM z GROUP BY 1),
b AS (SELECT * FROM z WHERE kind <> 'token'),
k AS (SELECT z.doc_id, z.kind, z.rank, z.s, z.e, o.live FROM z JOIN o ON z.v = o.v WHERE z.kind <> 'token' OR o.live AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = z.doc_id AND b.s < z.e AND b.e > z.s)),
j AS (SELECT doc_id, count_if(kind = 'assign') AS a, count_if(kind = 'access') AS c, count_if(kind = 'hex') AS h, count_if(kind = 'token') AS t, count_if(live) AS l,
  string_agg(concat(kind, ':', s::BIGINT, ':', e::BIGINT), ',' ORDER BY s, rank) FILTER (WHERE kind <> 'token') AS base, string_agg(concat(kind, ':', s::BIGINT, ':', e::BIGINT), ',' ORDER BY s, rank) AS every FROM k GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0)::BIGINT AS n_assign, coalesce(c, 0)::BIGINT AS n_access, coalesce(h, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans,
  coalesce(l, 0)::BIGINT AS n_live, coalesce(j.t, 0)::BIGINT AS n_token
FROM d LEFT JOIN j ON d.doc_id = j.doc_id
""",
    "op3_suffix_dedup": """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, k, substr(h, 2 * k - 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(1, length(h) // 2 - 48)) AS k FROM d WHERE length(h) >= 100)),
f AS (SELECT s, min(doc_id) AS first FROM w GROUP BY s HAVING count(*) > 1),
c AS (SELECT w.doc_id, w.k FROM w JOIN f ON w.s = f.s WHERE f.first < w.doc_id),
m AS (SELECT doc_id, k, lag(k) OVER (PARTITION BY doc_id ORDER BY k) AS p FROM c),
g AS (SELECT doc_id, k, sum((p IS NULL OR p + 50 < k)::INT) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM m),
spans AS (SELECT doc_id, run, min(k) AS s, max(k) + 50 AS e, lag(max(k) + 50, 1, 1) OVER (PARTITION BY doc_id ORDER BY run) AS before FROM g GROUP BY 1, 2),
cut AS (SELECT doc_id, sum(e - s) AS gone, count(*) AS n, max(e) AS last FROM spans GROUP BY 1),
kept AS (SELECT p.doc_id, string_agg(substr(d.h, 2 * before - 1, 2 * (s - before)), '' ORDER BY run) AS x FROM spans p JOIN d ON p.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0)::BIGINT AS n_spans,
  sha256(unhex(concat(coalesce(kept.x, ''), substr(h, 2 * coalesce(last, 1) - 1)))) AS kept_sha256
FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id LEFT JOIN kept ON d.doc_id = kept.doc_id
""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner FROM pages),
x AS (SELECT page_id, owner, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS hex FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((list_reduce([strpos('0123456789abcdef', substr(hex, 5 * (k // 4) + c, 1)) - 1 for c in [1, 2, 3, 4, 5]], lambda a, b: a * 16 + b) >> (15 - 5 * (k % 4))) & 31)::INT + 1, 1) for k in range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM x
""",
    "op9_decontaminate": f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_BENCH_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
bw AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw))),
hit AS (SELECT DISTINCT dw.doc_id, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
words AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM hit) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS all_items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(all_items, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
""",
    "op11_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOW.format(x="text")} AS t FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t)
""",
    "op12_search": f"""
WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents),
p AS (SELECT doc_id, len(w)::BIGINT AS n, unnest(w) AS term FROM d WHERE len(w) > 0),
c AS (SELECT count(*)::BIGINT AS big_n, sum(len(w))::BIGINT AS big_l FROM d WHERE len(w) > 0),
tf AS (SELECT doc_id, n, term, count(*)::BIGINT AS tf FROM p GROUP BY ALL),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY 1),
i AS (SELECT item_id, term FROM (SELECT item_id, unnest(list_distinct({_BENCH_WORDS})) AS term FROM benchmark)),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, c),
s AS (SELECT item_id, doc_id, sum(w.w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l))))::BIGINT AS score
  FROM i JOIN tf ON i.term = tf.term JOIN w ON i.term = w.term, c GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0)
SELECT * FROM r WHERE rank <= 50
""",
    "op13_resample": f"""
WITH crc AS (SELECT list(list_reduce([b, 1, 1, 1, 1, 1, 1, 1, 1], lambda a, _: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) ORDER BY b) AS e FROM range(256) r(b)),
words AS (SELECT 0 AS target, doc_id, {_BENCH_WORDS} AS w FROM documents UNION ALL SELECT 1, NULL, {_BENCH_WORDS} FROM benchmark),
rows AS (SELECT row_number() OVER () AS r, * FROM words),
runs AS (SELECT r, target, list_concat(w, [concat(w[i], ' ', w[i + 1]) for i in range(1, len(w))]) AS g FROM rows),
f AS (SELECT r, target, unnest(g) AS x FROM runs),
u AS (SELECT DISTINCT x FROM f),
h AS (SELECT x, hex(encode(x)) AS hx FROM u),
b AS (SELECT x, list_reduce(list_concat([4294967295], [16 * (strpos('0123456789ABCDEF', substr(hx, i, 1)) - 1) + strpos('0123456789ABCDEF', substr(hx, i + 1, 1)) - 1 for i in range(1, length(hx), 2)]),
  lambda a, y: xor(a >> 8, crc.e[(xor(a, y) & 255) + 1])) AS reg FROM h, crc),
k AS (SELECT x, xor(reg, 4294967295) % 10000 AS bucket FROM b),
fk AS (SELECT r, target, bucket FROM f JOIN k ON f.x = k.x),
n AS (SELECT bucket, count_if(target = 0)::DOUBLE AS s, count_if(target = 1)::DOUBLE AS t FROM fk GROUP BY 1),
tot AS (SELECT sum(s) AS big_s, sum(t) AS big_t FROM n),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (big_s + 10000)) / ((s + 1) * (big_t + 10000))))::BIGINT AS gain FROM n, tot),
doc AS (SELECT r, count(*)::BIGINT AS n, sum(gain)::BIGINT AS g FROM fk JOIN gain ON fk.bucket = gain.bucket WHERE target = 0 GROUP BY 1),
wt AS (SELECT rows.doc_id, len(w) AS words, coalesce(n, 0)::BIGINT AS n_features, coalesce(CASE WHEN g >= 0 THEN g // n ELSE -((-g + n - 1) // n) END, 0)::BIGINT AS weight,
  ('0x' || substr(sha256('7:' || rows.doc_id::VARCHAR), 1, 8))::BIGINT AS h FROM rows LEFT JOIN doc ON rows.r = doc.r WHERE target = 0),
sc AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM wt),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n FROM sc WHERE words >= 20)
SELECT sc.doc_id, n_features, weight, score, CASE WHEN rank <= (25 * n) // 100 THEN rank END::BIGINT AS rank FROM sc LEFT JOIN rk ON sc.doc_id = rk.doc_id
""",
}
