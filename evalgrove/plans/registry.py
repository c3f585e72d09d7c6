"""Registering queries with their SQL twins, and the views that both read.

Views are written once in SQL that Spark and DuckDB share; ARR( stands for the engines' array constructors
and {name} for a table or another view.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

LINE_ORDER = "l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate"
NOUN = "split_part(p_name, ' ', 2)"
CLASS = f"CASE WHEN {NOUN} IN ('anvil', 'plate') THEN 'heavy' WHEN {NOUN} IN ('bolt', 'ring', 'rod') THEN 'round' ELSE 'made' END"

#: The answer that a line gives.
ANSWER = f"CASE l_suppkey % 6 WHEN 0 THEN concat('A: ', p_name, '.') WHEN 1 THEN concat('<answer>', upper(p_name), '</answer>') WHEN 2 THEN concat('a ', p_name, ' thing') WHEN 3 THEN {NOUN} WHEN 4 THEN 'I don''t know.' ELSE p_name END"

VIEWS = {
    # a taxonomy of customers, nations and regions, leaf first
    "geo": "SELECT c_custkey AS entity_id, c_name AS leaf, ARR(c_name, n_name, r_name) AS chain, ARR(c_name, n_name, r_name, 'root') AS path "
    "FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey",
    "nations": "SELECT n_nationkey, n_name, r_name, ARR(n_name, r_name, 'root') AS path FROM {nation} JOIN {region} ON n_regionkey = r_regionkey",
    # a taxonomy of part names, nouns and classes, with one diamond: bolts are also made
    "part_chains": f"SELECT DISTINCT p_name AS id, ARR(p_name, {NOUN}, {CLASS}) AS chain, ARR(p_name, {NOUN}, {CLASS}, 'root') AS path FROM {{part}} "
    f"UNION ALL SELECT DISTINCT concat(p_name, '/2') AS id, ARR(p_name, {NOUN}, 'made') AS chain, ARR(p_name, {NOUN}, 'made', 'root') AS path FROM {{part}} WHERE {NOUN} = 'bolt'",
    # answers: a line of an order is a rollout of the order's example
    "rollouts": "SELECT l_orderkey AS example_id, CAST(row_number() OVER w - 1 AS INT) AS idx, "
    f"{ANSWER} AS text, "
    "l_returnflag = 'R' AS verdict, CASE WHEN l_quantity <= 40 THEN l_linestatus = 'F' END AS parse_ok, first_value(p_name) OVER w AS answer, l_partkey AS part_id "
    "FROM {lineitem} JOIN {part} ON l_partkey = p_partkey WINDOW w AS (PARTITION BY l_orderkey ORDER BY " + LINE_ORDER + ")",
    # the same orders judged by another rule
    "other_run": "SELECT l_orderkey AS example_id, l_linestatus = 'O' AND l_discount > 0.05 AS verdict FROM {lineitem}",
    # where an order's customer lives against where its lines' suppliers are
    "order_geo": "SELECT l_orderkey AS example_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY " + LINE_ORDER + ") - 1 AS INT) AS idx, "
    "s.n_name AS predicted_node, s.path AS predicted_path, c.n_name AS answer, c.path AS reference_path, l_returnflag = 'R' AS verdict "
    "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey "
    "JOIN {nations} s ON s_nationkey = s.n_nationkey JOIN {nations} c ON c_nationkey = c.n_nationkey",
    "user_rollouts": "SELECT user_id AS example_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS idx, "
    "CASE event_type WHEN 'error' THEN 'I don''t know.' WHEN 'signup' THEN 'I am not sure about that' ELSE event_type END AS text, value > 20 AS verdict FROM {events}",
    # aliases of parts: the brand, the type and a number
    "part_aliases": "SELECT DISTINCT p_name AS label, p_type AS alias FROM {part} UNION SELECT DISTINCT p_name, concat('the ', p_name) FROM {part} UNION SELECT DISTINCT p_name, CAST(p_size AS STRING) FROM {part}",
    "texts": "SELECT doc_id, text FROM {documents} UNION ALL SELECT n_nationkey - 100, concat('A: ', n_name, '. <s>Is-it?</s>') FROM {nation} "
    "UNION ALL SELECT page_id - 100000, concat('x<|end_header_id|>', html, '!<|eot_id|>y') FROM {pages}",
    # judge replies built from lines, two completions an answer
    "replies": "SELECT l_orderkey AS example_id, l_linenumber AS idx, l_partkey AS part_id, l_suppkey AS supp_id, 0 AS completion, "
    "CASE l_partkey % 4 WHEN 0 THEN '<answer>1</answer>' WHEN 1 THEN '<answer>1</answer> no: <answer> 0 </answer>' WHEN 2 THEN 'no idea' ELSE '<answer>0</answer> x <answer> 1 </answer>' END AS reply, "
    "CASE l_partkey % 6 WHEN 0 THEN '{\"verdict\": \"yes\", \"reason\": \"same\"}' WHEN 1 THEN '{\"verdict\": \"no\", \"reason\": \" other \"}' WHEN 2 THEN '{\"verdict\": \"yes\", \"reason\": \" \"}' "
    "WHEN 3 THEN 'yes' WHEN 4 THEN '{\"verdict\": \"maybe\", \"reason\": \"x\"}' ELSE '[1]' END AS json FROM {lineitem}",
    "samples": "SELECT doc_id AS ord, CASE WHEN doc_id % 50 = 49 THEN '' ELSE concat('d', CAST(doc_id % 400 AS STRING)) END AS data_id, length(text) % 7 AS n_texts, doc_id % 97 = 0 AS bad, source FROM {documents}",
}

#: Forms of views that suit Spark better; the rows are the same.
SPARK_VIEWS = {
    # lines are numbered while they hold keys of nations, whose names and paths come afterwards: rows to sort are narrow
    "order_geo": "SELECT example_id, idx, s.n_name AS predicted_node, s.path AS predicted_path, c.n_name AS answer, c.path AS reference_path, verdict FROM "
    "(SELECT l_orderkey AS example_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY " + LINE_ORDER + ") - 1 AS INT) AS idx, s_nationkey, c_nationkey, l_returnflag = 'R' AS verdict "
    "FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey JOIN {supplier} ON l_suppkey = s_suppkey "
    "LEFT SEMI JOIN {nations} n ON s_nationkey = n.n_nationkey LEFT SEMI JOIN {nations} m ON c_nationkey = m.n_nationkey) "
    "JOIN {nations} s ON s_nationkey = s.n_nationkey JOIN {nations} c ON c_nationkey = c.n_nationkey",
}


def duck(sql: str) -> str:
    """The SQL with views put in, for DuckDB."""
    pattern = re.compile(r"\{(\w+)\}")
    while pattern.search(sql):
        sql = pattern.sub(lambda m: m[1] if m[1] in TABLES else f"({VIEWS[m[1]]})", sql)
    return sql.replace("ARR(", "list_value(")


class Tables:
    """The tables of a folder and the views over them, as attributes."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir, self._views, self.kept = spark, sf_dir, {}, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name not in VIEWS:
            raise AttributeError(name)
        if name not in self._views:
            view = SPARK_VIEWS.get(name, VIEWS[name])
            used = set(re.findall(r"\{(\w+)\}", view))
            sql = re.sub(r"\{(?!\w+\})", "{{", view)
            sql = re.sub(r"(?<!\w)\}", "}}", sql)
            self._views[name] = self.spark.sql(sql.replace("ARR(", "array("), **{u: getattr(self, u) for u in used})
        return self._views[name]


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of Tables under its name, with its twin."""

    def register(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = duck(sql)
        return f

    return register


# DuckDB's forms of the text functions


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def d_scores(x: str) -> str:
    from evalgrove.functions.text import PUNCTUATION

    return f"translate(translate(lower({x}), '-', ' '), {_quoted(PUNCTUATION)}, '')"


def d_strip(x: str) -> str:
    from evalgrove.functions.text import BLANKS

    return f"trim({x}, {' || '.join(f'chr({ord(c)})' for c in BLANKS)})"


def d_match(x: str) -> str:
    return rf"trim(regexp_replace({d_scores(x)}, '\s+', ' ', 'g'))"


def d_audit(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(trim(lower({x})), '<[^>]+>', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def d_index(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(translate(lower({x}), '_-', '  '), '[^a-z0-9 ]+', ' ', 'g'), '\s+', ' ', 'g'))"


def d_marks(x: str) -> str:
    from evalgrove.functions.text import MARKS

    for m in MARKS:
        x = f"replace({x}, '{m}', '')"
    return x


def d_light(x: str) -> str:
    return d_strip(d_marks(x))


def d_full(x: str) -> str:
    turn = f"split_part(list_last(string_split({d_marks(x)}, '<|end_header_id|>')), '<|eot_id|>', 1)"
    return d_strip(f"regexp_replace({d_strip(turn)}, '[.!?,;]$', '')")


def d_grams(x: str, n: int) -> str:
    """Distinct n-grams of a normalised text."""
    w = f"list_filter(string_split({x}, ' '), lambda w: w <> '')"
    return f"list_distinct([array_to_string(({w})[i:i + {n - 1}], ' ') for i in range(1, len({w}) - {n} + 2)])"


def d_pass(n: str, c: str, k: str) -> str:
    return f"CASE WHEN {n} - {c} < {k} THEN 1.0::DOUBLE WHEN {c} = 0 THEN 0.0::DOUBLE ELSE 1 - list_product([1 - {k}::DOUBLE / j for j in range(({n} - {c} + 1)::BIGINT, ({n} + 1)::BIGINT)]) END"


def d_common(p: str, r: str) -> str:
    return f"len([k for k in range(1, least(len({p}), len({r})) + 1) if {p}[len({p}) - k + 1:] = {r}[len({r}) - k + 1:]])"
