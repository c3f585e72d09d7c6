"""Queries on the taxonomy."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrove.functions import metrics as M
from evalgrove.operators import layout as L
from evalgrove.operators import questions as Q
from evalgrove.operators import taxonomy as X
from evalgrove.sources import files

from .registry import Tables, d_audit, d_index, query

def _joined():
    return F.array_join("path", " > ")



def _all_paths(t: Tables) -> DataFrame:
    return t.part_chains.select("id", "path").unionByName(t.geo.select(F.col("entity_id").cast("string").alias("id"), "path"))


_ALL = "(SELECT id, path FROM {part_chains} UNION ALL SELECT entity_id::VARCHAR, path FROM {geo})"
_EDGES = f"(SELECT DISTINCT path[i + 1] AS parent, path[i] AS child FROM (SELECT path, unnest(range(1, len(path))) AS i FROM {_ALL}))"
#: Shortest path of each node, the least of several: by walking up from nodes, as all chains do, and down.
_NODES = (
    "(WITH RECURSIVE walk AS (SELECT 'root' AS label, ['root'] AS path UNION ALL "
    f"SELECT e.child, list_prepend(e.child, w.path) FROM walk w JOIN {_EDGES} e ON e.parent = w.label) "
    "SELECT label, path, len(path) AS depth FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY len(path), path) AS n FROM walk) WHERE n = 1 AND label <> 'root')"
)


def nodes_of(t: Tables) -> DataFrame:
    return X.node_paths(X.edges(_all_paths(t)))


@query(f"SELECT parent, child FROM {_EDGES}")
def taxonomy_edges(t: Tables) -> DataFrame:
    return X.edges(_all_paths(t))


@query(f"SELECT label, array_to_string(path, ' > ') AS path, depth::INT AS depth FROM {_NODES}")
def taxonomy_paths(t: Tables) -> DataFrame:
    return nodes_of(t).select("label", _joined().alias("path"), "depth")


@query(f"SELECT label, (row_number() OVER (ORDER BY label) - 1)::BIGINT AS ord FROM {_NODES}")
def node_ordinals(t: Tables) -> DataFrame:
    return X.with_ordinals(nodes_of(t)).select("label", F.col("ord").cast("long").alias("ord"))


@query(f"SELECT {d_index('label')} AS norm, array_to_string(min_by(path, label), ' > ') AS path, count(*)::BIGINT AS paths FROM {_NODES} GROUP BY 1")
def label_paths(t: Tables) -> DataFrame:
    return X.label_paths(nodes_of(t)).select("norm", _joined().alias("path"), "paths")


@query(
    "SELECT id, array_to_string(CASE WHEN chain[3] = 'made' THEN chain[1:2] WHEN chain[2] = 'ring' THEN chain[1:2] ELSE chain END, ' > ') AS kept FROM {part_chains}"
)
def chain_prune(t: Tables) -> DataFrame:
    pruned = M.prune_chain(F.col("chain"), drop_through=["made"], keep_from=["ring"])
    return t.part_chains.select("id", F.array_join(F.reverse(pruned), " > ").alias("kept"))


@query("SELECT id, array_to_string(list_append(chain, 'root'), ' > ') AS path, array_to_string(chain, ' > ') AS chain FROM {part_chains}")
def path_from_chain(t: Tables) -> DataFrame:
    path = M.chain_path(M.prune_chain(F.col("chain")))
    return t.part_chains.select("id", F.array_join(path, " > ").alias("path"), F.array_join(M.without_root(path), " > ").alias("chain"))


@query("SELECT id, array_to_string(path, ' > ') AS path FROM {part_chains} WHERE chain[3] <> 'made' UNION ALL SELECT id, array_to_string([chain[1], chain[2], 'root'], ' > ') FROM {part_chains} WHERE chain[3] = 'made'")
def entity_paths(t: Tables) -> DataFrame:
    rows = t.part_chains.withColumn("pruned", M.prune_chain(F.col("chain"), drop_through=["made"]))
    return X.entity_paths(rows).select("id", _joined().alias("path"))


@query(f"SELECT {d_index('alias')} AS alias, min(label) AS label FROM {{part_aliases}} GROUP BY 1")
def alias_map(t: Tables) -> DataFrame:
    return X.alias_table(t.part_aliases)


@query(f"SELECT {d_audit('label')} AS canonical, count(DISTINCT {d_audit('alias')})::BIGINT AS aliases, min({d_audit('alias')}) AS first FROM {{part_aliases}} GROUP BY 1")
def aliases_by_label(t: Tables) -> DataFrame:
    rows = X.aliases_by_label(t.part_aliases)
    return rows.groupBy("canonical").agg(F.count("*").alias("aliases"), F.min("alias").alias("first"))


@query("SELECT node, count(*)::BIGINT AS df FROM (SELECT DISTINCT entity_id, unnest(chain) AS node FROM {geo}) GROUP BY node")
def node_df(t: Tables) -> DataFrame:
    return X.document_frequency(t.geo)


_DF = "(SELECT node, count(*) AS df FROM (SELECT DISTINCT entity_id, unnest(chain) AS node FROM {geo}) GROUP BY node)"
_GAP = f"(SELECT low AS threshold FROM (SELECT df, lag(df) OVER (ORDER BY df) AS low FROM (SELECT DISTINCT df FROM {_DF})) WHERE low IS NOT NULL ORDER BY df - low DESC, low DESC LIMIT 1)"


@query(f"SELECT threshold::BIGINT AS threshold FROM {_GAP}")
def gap_threshold(t: Tables) -> DataFrame:
    return Q.generic_threshold(X.document_frequency(t.geo))


_PARENT = (
    f"(SELECT g.entity_id, min_by(s.node, s.pos) AS parent FROM {{geo}} g LEFT JOIN (SELECT entity_id, chain[pos] AS node, pos FROM (SELECT entity_id, chain, unnest(range(2, len(chain) + 1)) AS pos FROM {{geo}}) "
    f"WHERE chain[pos] IN (SELECT node FROM {_DF} WHERE df <= (SELECT threshold FROM {_GAP}))) s ON g.entity_id = s.entity_id GROUP BY 1)"
)
_EXAMPLES = "(SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_custkey END AS entity_id, CASE WHEN o_orderkey % 3 = 0 THEN 'what is shown in the photo?' ELSE 'who is this?' END AS question FROM {orders})"
_OUTCOME = (
    f"(SELECT e.*, p.parent, CASE WHEN p.entity_id IS NULL THEN 'excluded_no_chain' WHEN p.parent IS NOT NULL THEN 'generated_from_chain' "
    f"WHEN e.question <> 'what is shown in the photo?' THEN 'kept_aligned' ELSE 'excluded_generic' END AS outcome FROM {_EXAMPLES} e LEFT JOIN {_PARENT} p ON e.entity_id = p.entity_id)"
)


def _examples(t: Tables) -> DataFrame:
    return t.orders.selectExpr(
        "o_orderkey", "CASE WHEN o_orderkey % 5 = 0 THEN -1 ELSE o_custkey END AS entity_id",
        "CASE WHEN o_orderkey % 3 = 0 THEN 'what is shown in the photo?' ELSE 'who is this?' END AS question",
    )


@query(f"SELECT o_orderkey, outcome, CASE outcome WHEN 'generated_from_chain' THEN concat('what is this ', parent, '?') ELSE question END AS question FROM {_OUTCOME}")
def aligned_questions(t: Tables) -> DataFrame:
    return Q.aligned(_examples(t), t.geo).select("o_orderkey", "outcome", "question")


@query(f"SELECT outcome, count(*)::BIGINT AS examples, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent FROM {_OUTCOME} GROUP BY outcome")
def aligned_stats(t: Tables) -> DataFrame:
    rows = Q.outcome_stats(Q.aligned(_examples(t), t.geo))
    return rows.select("outcome", "examples", F.round("percent", 6).alias("percent"))


_DESC = "(SELECT id, chain[2] AS label, concat('about ', chain[2]) AS description FROM {part_chains} WHERE length(id) % 2 = 0)"


def _descriptions(t: Tables) -> DataFrame:
    noun = F.get("chain", F.lit(1))
    return t.part_chains.where(F.length("id") % 2 == 0).select("id", noun.alias("label"), F.concat(F.lit("about "), noun).alias("description"))


@query(f"SELECT c.id, array_to_string([CASE WHEN d.label = x THEN d.description ELSE '' END for x in c.chain], '|') AS descriptions FROM {{part_chains}} c LEFT JOIN {_DESC} d ON c.id = d.id")
def description_chains(t: Tables) -> DataFrame:
    chains = t.part_chains.select("id", F.col("chain").alias("taxonomy"))
    return Q.description_chains(chains, _descriptions(t)).select("id", F.array_join("descriptions", "|").alias("descriptions"))


@query(
    f"SELECT count(*)::BIGINT AS pairs, (count(*) - count(d.id))::BIGINT AS missing, round((count(*) - count(d.id)) / count(*)::DOUBLE, 9) AS ratio FROM (SELECT DISTINCT id, unnest(chain) AS label FROM {{part_chains}}) p LEFT JOIN {_DESC} d ON p.id = d.id AND p.label = d.label"
)
def missing_descriptions(t: Tables) -> DataFrame:
    chains = t.part_chains.select("id", F.col("chain").alias("taxonomy"))
    return Q.missing_descriptions(chains, _descriptions(t)).select("pairs", "missing", F.round("ratio", 9).alias("ratio"))


@query("SELECT id, array_to_string(max_by(chain, ord), '>') AS taxonomy FROM (SELECT chain[2] AS id, chain, row_number() OVER (ORDER BY id) AS ord FROM {part_chains}) GROUP BY id")
def chains_last_wins(t: Tables) -> DataFrame:
    from pyspark.sql import Window

    rows = t.part_chains.select(F.get("chain", F.lit(1)).alias("id"), F.col("chain").alias("taxonomy"), F.row_number().over(Window.orderBy("id")).alias("ord"))
    return files.read_chains(rows).select("id", F.array_join("taxonomy", ">").alias("taxonomy"))


@query(
    f"SELECT e.example_id, e.answer, array_to_string(coalesce(n.path, p.path, l.path), ' > ') AS reference_path FROM "
    "(SELECT DISTINCT example_id, CASE example_id % 4 WHEN 0 THEN answer WHEN 1 THEN upper(answer) WHEN 2 THEN 'NATION_1' ELSE 'nothing' END AS answer, CASE WHEN example_id % 4 = 3 THEN concat(answer, CASE WHEN example_id % 8 = 3 THEN '' ELSE '?' END) END AS entity_id FROM {rollouts}) e "
    f"LEFT JOIN {_NODES} n ON e.answer = n.label LEFT JOIN {{part_chains}} p ON e.entity_id = p.id "
    f"LEFT JOIN (SELECT {d_index('label')} AS norm, min_by(path, label) AS path FROM {_NODES} GROUP BY 1) l ON {d_index('e.answer')} = l.norm"
)
def ref_path_lookup(t: Tables) -> DataFrame:
    rows = t.rollouts.selectExpr(
        "example_id", "CASE example_id % 4 WHEN 0 THEN answer WHEN 1 THEN upper(answer) WHEN 2 THEN 'NATION_1' ELSE 'nothing' END AS answer",
        "CASE WHEN example_id % 4 = 3 THEN concat(answer, CASE WHEN example_id % 8 = 3 THEN '' ELSE '?' END) END AS entity_id",
    ).distinct()
    nodes = nodes_of(t)
    found = X.reference_paths(rows, nodes, t.part_chains.select("id", "path"), X.label_paths(nodes))
    return found.select("example_id", "answer", F.array_join("reference_path", " > ").alias("reference_path"))


@query(
    "SELECT g.entity_id::VARCHAR AS id, concat(coalesce(n.name, g.leaf), ' > ', array_to_string(g.chain[2:], ' > ')) AS chain FROM {geo} g LEFT JOIN (SELECT o_custkey, max_by(coalesce(CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority END, o_orderstatus), o_orderkey) AS name FROM {orders} GROUP BY 1) n ON g.entity_id = n.o_custkey"
)
def leaf_override(t: Tables) -> DataFrame:
    """Leaves named by the last order of a customer."""
    examples = t.orders.select(
        F.col("o_custkey").cast("string").alias("entity_id"), F.col("o_orderkey").alias("ord"), F.col("o_orderstatus").alias("answer"),
        F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("original_answer"),
    )
    chains = t.geo.select(F.col("entity_id").cast("string").alias("id"), F.col("chain").alias("taxonomy"))
    return X.override_leaves(chains, X.sample_names(examples)).select("id", F.array_join("taxonomy", " > ").alias("chain"))


@query(
    "SELECT DISTINCT chain[1] AS label, alias FROM {part_chains} JOIN (SELECT p_name AS id, p_type AS alias FROM {part} UNION SELECT p_name, split_part(p_name, ' ', 2) FROM {part}) USING (id) WHERE NOT list_contains(chain, alias)"
)
def leaf_aliases(t: Tables) -> DataFrame:
    akas = t.part.select(F.col("p_name").alias("id"), F.explode(F.array("p_type", F.split_part("p_name", F.lit(" "), F.lit(2)))).alias("alias"))
    return X.leaf_aliases(t.part_chains.withColumn("pruned", F.reverse("chain")), akas)


@query("SELECT source AS dataset, count(*)::BIGINT AS examples FROM {documents} GROUP BY 1")
def examples_by_dataset(t: Tables) -> DataFrame:
    return X.examples_by_dataset(t.documents.withColumnRenamed("source", "dataset"))


@query(
    "WITH c AS (SELECT leaf, chain[2] AS nation, chain[3] AS region FROM {geo}), "
    "l AS (SELECT *, floor(50.0::DOUBLE + (row_number() OVER (ORDER BY region, nation, leaf) - 1) / count(*) OVER ()::DOUBLE * 1200)::INT AS x FROM c), "
    "n AS (SELECT nation, region, (sum(x) // count(*))::INT AS x, count(*)::BIGINT AS leaves FROM l GROUP BY 1, 2), r AS (SELECT region, (sum(x) // count(*))::INT AS x, sum(leaves)::BIGINT AS leaves FROM n GROUP BY 1) "
    "SELECT leaf AS node, nation AS parent, 3 AS depth, x, 800 AS y, 1::BIGINT AS leaves FROM l UNION ALL SELECT nation, region, 2, x, 533, leaves FROM n "
    "UNION ALL SELECT region, 'root', 1, x, 266, leaves FROM r UNION ALL SELECT 'root', NULL, 0, (sum(x) // count(*))::INT, 0, sum(leaves)::BIGINT FROM r"
)
def tree_layout(t: Tables) -> DataFrame:
    """Customers, nations and regions as a drawn tree."""
    return L.chain_layout(t.geo)
