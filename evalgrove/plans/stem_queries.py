"""Queries on stems, with the rules in SQL as regular expressions and positions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrove.functions import stem as S
from evalgrove.operators import match as M

from .match_queries import part_nodes
from .registry import Tables, d_full, d_scores, query

_ABC = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_REGION = "^[^aeiouy]*[aeiouy]+[^aeiouy]"
_SHORT = "([^aeiouy][aeiouy][^aeiouywxY]|^[aeiouy][^aeiouy])$"


def _step(x: str, rules: list[tuple[str, str, str]]) -> str:
    """CASE over (suffix, what it becomes, further condition on r, the rest): the longest that fits decides."""
    cases = []
    for suffix, to, cond in sorted(rules, key=lambda r: -len(r[0])):
        rest = f"left({x}, length({x}) - {len(suffix)})"
        cases.append(f"WHEN ends_with({x}, '{suffix}') THEN CASE WHEN {cond.replace('$r', rest)} THEN concat({rest}, '{to}') ELSE {x} END")
    return f"CASE {' '.join(cases)} ELSE {x} END"


_IN1, _IN2 = "length($r) >= r1", "length($r) >= r2"
_MORE = {"ogi": " AND ends_with($r, 'l')", "li": " AND regexp_matches($r, '[cdeghkmnrt]$')", "ion": " AND regexp_matches($r, '[st]$')"}
_UNDONE = "regexp_replace({x}, '(ingly|edly|ing|ed)$', '')"


def stems_sql(words: str) -> str:
    """(w, stem) of a table of lower-case words (w)."""
    irregular = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in S.IRREGULAR.items())
    undone = _UNDONE.format(x="s1")
    past = (
        f"CASE WHEN regexp_matches(s1, 'eed(ly)?$') THEN CASE WHEN length(regexp_replace(s1, 'eed(ly)?$', '')) >= r1 THEN concat(regexp_replace(s1, 'eed(ly)?$', ''), 'ee') ELSE s1 END "
        f"WHEN regexp_matches(s1, '(ingly|edly|ing|ed)$') AND regexp_matches({undone}, '[aeiouy]') THEN CASE WHEN regexp_matches({undone}, '(at|bl|iz)$') THEN concat({undone}, 'e') "
        f"WHEN regexp_matches({undone}, '(bb|dd|ff|gg|mm|nn|pp|rr|tt)$') THEN left({undone}, length({undone}) - 1) WHEN length({undone}) <= r1 AND regexp_matches({undone}, '{_SHORT}') THEN concat({undone}, 'e') ELSE {undone} END ELSE s1 END"
    )
    two = _step("s3", [(s, to, _IN1 + _MORE.get(s, "")) for s, to in S.STEP2.items()])
    three = _step("s4", [(s, to, _IN2 if s == "ative" else _IN1) for s, to in S.STEP3.items()])
    four = _step("s5", [(s, "", _IN2 + _MORE.get(s, "")) for s in S.STEP4])
    rest = "left(s6, length(s6) - 1)"
    five = f"CASE WHEN ends_with(s6, 'e') AND (length(s6) - 1 >= r2 OR length(s6) - 1 >= r1 AND NOT regexp_matches({rest}, '{_SHORT}')) OR ends_with(s6, 'll') AND length(s6) - 1 >= r2 THEN {rest} ELSE s6 END"
    return (
        f"(WITH w0 AS (SELECT w, regexp_replace(regexp_replace(w, '^y', 'Y'), '([aeiouy])y', '\\1Y', 'g') AS y FROM {words}), "
        f"w1 AS (SELECT *, CASE WHEN regexp_matches(y, '^(gener|arsen)') THEN 5 WHEN starts_with(y, 'commun') THEN 6 WHEN regexp_matches(y, '{_REGION}') THEN length(regexp_extract(y, '{_REGION}')) ELSE length(y) END AS r1 FROM w0), "
        f"w2 AS (SELECT *, CASE WHEN regexp_matches(substr(y, r1 + 1), '{_REGION}') THEN r1 + length(regexp_extract(substr(y, r1 + 1), '{_REGION}')) ELSE length(y) END AS r2, "
        "CASE WHEN ends_with(y, 'sses') THEN left(y, length(y) - 2) WHEN regexp_matches(y, 'ie[ds]$') THEN left(y, length(y) - CASE WHEN length(y) > 4 THEN 2 ELSE 1 END) "
        "WHEN regexp_matches(y, '[^us]s$') AND regexp_matches(left(y, length(y) - 2), '[aeiouy]') THEN left(y, length(y) - 1) ELSE y END AS s1 FROM w1), "
        f"w3 AS (SELECT *, {past} AS s2 FROM w2), w4 AS (SELECT *, CASE WHEN length(s2) > 2 AND regexp_matches(s2, '[^aeiouy][yY]$') THEN concat(left(s2, length(s2) - 1), 'i') ELSE s2 END AS s3 FROM w3), "
        f"w5 AS (SELECT *, {two} AS s4 FROM w4), w6 AS (SELECT *, {three} AS s5 FROM w5), w7 AS (SELECT *, {four} AS s6 FROM w6) "
        f"SELECT w, CASE WHEN length(w) <= 2 THEN w ELSE CASE w {irregular} ELSE CASE WHEN s1 IN ({', '.join(repr(k) for k in sorted(S.KEPT))}) THEN s1 ELSE lower({five}) END END END AS stem FROM w7)"
    )


@query(f"SELECT w AS word, stem FROM {stems_sql(f'''(SELECT DISTINCT unnest(regexp_extract_all(translate(text, '{_ABC[0]}', '{_ABC[1]}'), '[a-z]+')) AS w FROM {{documents}})''')}")
def word_stems(t: Tables) -> DataFrame:
    """Each distinct word of all documents with its stem."""
    words = F.regexp_extract_all(F.translate("text", *_ABC), F.lit("[a-z]+"), F.lit(0))
    distinct = t.documents.select(F.explode(F.array_distinct(words)).alias("word")).distinct()
    return distinct.select("word", S.stem_words(F.col("word")).alias("stem"))


_SAID = "(SELECT DISTINCT concat(split_part(p_name, ' ', 1), ' ', split_part(p_name, ' ', 2), CASE p_partkey % 3 WHEN 0 THEN 's' WHEN 1 THEN 'ing' ELSE '' END) AS text FROM {part})"
_WORDS = "string_split({x}, ' ')"


def _stemmed(table: str, column: str, x: str) -> str:
    """(column, stems joined) of a table whose texts are words between single blanks."""
    split = f"(SELECT {column}, unnest(range(1, len({_WORDS.format(x=x)}) + 1)) AS i, unnest({_WORDS.format(x=x)}) AS w FROM {table})"
    return f"(SELECT {column}, string_agg(stem, ' ' ORDER BY i) AS k FROM {split} a JOIN {stems_sql(f'(SELECT DISTINCT w FROM {split})')} b ON a.w = b.w GROUP BY 1)"


@query(
    f"WITH labels AS (SELECT DISTINCT unnest(chain[1:2]) AS label FROM {{part_chains}}), t AS {_stemmed(_SAID, 'text', d_scores(d_full('text')))}, l AS {_stemmed('labels', 'label', d_scores('label'))} "
    f"SELECT t.text, max(l.label) AS predicted_node FROM t LEFT JOIN l ON t.k = l.k GROUP BY 1"
)
def match_stemmed(t: Tables) -> DataFrame:
    """Names with other endings than the labels' meet them by stems; of several the last label in order."""
    end = F.when(F.col("p_partkey") % 3 == 0, "s").when(F.col("p_partkey") % 3 == 1, "ing").otherwise("")
    first, second = (F.split_part("p_name", F.lit(" "), F.lit(i)) for i in (1, 2))
    texts = t.part.select(F.concat(first, F.lit(" "), second, end).alias("text")).distinct()
    nodes = part_nodes(t).where("depth > 2")
    return M.direct(texts, nodes, "exact_match", stem=True).select("text", "predicted_node")
