"""The label taxonomy: edges, shortest paths, label, entity and alias tables, frequencies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalgrove.functions.metrics import ROOT, chain_path
from evalgrove.functions.text import normalize_audit, normalize_index, normalize_match
from evalgrove.operators.ordinals import numbered
from evalgrove.sources.staging import staged


def edges(paths: DataFrame, path: str = "path") -> DataFrame:
    """Distinct (parent, child) of leaf-to-root paths that end in the root."""
    pairs = F.arrays_zip(F.slice(F.col(path), 2, F.size(path) - 1).alias("parent"), F.slice(F.col(path), 1, F.size(path) - 1).alias("child"))
    return paths.where(F.size(path) > 1).select(F.explode(pairs).alias("e")).select("e.parent", "e.child").distinct()


def node_paths(links: DataFrame, max_depth: int = 64) -> DataFrame:
    """(label, path, depth): of each node the shortest leaf-to-root path, the least in code-point order of several.

    Breadth first, one level a round. A round's new nodes are those not reached before, so a cycle ends by
    itself, and of several parents of one level the least path wins, so a diamond costs nothing extra.
    Levels are written to the shared folder; there are as many as the taxonomy is deep.
    """
    spark = links.sparkSession
    links = staged(links, "edges")
    level = spark.range(1).select(F.lit(ROOT).alias("label"), F.array(F.lit(ROOT)).alias("path"))
    known = level
    for _ in range(max_depth):
        down = links.join(level, F.col("parent") == F.col("label")).select(F.col("child").alias("label"), F.concat(F.array("child"), "path").alias("path"))
        # the least path of the same length: compared from the leaf, as the array orders
        down = down.groupBy("label").agg(F.min("path").alias("path")).join(known.select("label"), "label", "left_anti")
        level = staged(down, "level")
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known.where(F.col("label") != ROOT).withColumn("depth", F.size("path"))


def with_ordinals(nodes: DataFrame) -> DataFrame:
    """Nodes with ord, their place in code-point order from 0, and the normalised label; no window holds all of them."""
    placed = numbered(nodes, "ord", ["label"])
    return placed.withColumn("ord", F.col("ord").cast("int")).withColumn("norm", normalize_match(F.col("label")))


def sample_names(examples: DataFrame, order: str = "ord") -> DataFrame:
    """(id, name): the answer that the last example of each entity gives, the original one if there is one."""
    name = F.coalesce("original_answer", "answer") if "original_answer" in examples.columns else F.col("answer")
    named = examples.where(F.col("entity_id").isNotNull() & name.isNotNull())
    return named.groupBy(F.col("entity_id").alias("id")).agg(F.max_by(name, order).alias("name"))


def override_leaves(chains: DataFrame, names: DataFrame, chain: str = "taxonomy") -> DataFrame:
    """Leaf-first chains whose leaf is the name that samples give their entity; empty chains stay empty."""
    joined = chains.join(names.select(F.col("id").alias("_i"), F.col("name").alias("_n")), F.col("id") == F.col("_i"), "left")
    renamed = F.concat(F.array("_n"), F.slice(chain, F.lit(2), F.greatest(F.size(chain) - 1, F.lit(0))))
    return joined.withColumn(chain, F.when(F.col("_n").isNotNull() & (F.size(chain) > 0), renamed).otherwise(F.col(chain))).drop("_i", "_n")


def leaf_aliases(chains: DataFrame, akas: DataFrame, pruned: str = "pruned") -> DataFrame:
    """(label, alias): other names (id, alias) of a pruned chain's leaf, without those that the chain holds itself."""
    some = chains.where(F.size(pruned) > 0).select("id", F.col(pruned).alias("_p"))
    met = akas.select(F.col("id").alias("_i"), "alias").join(some, F.col("_i") == F.col("id"))
    return met.where(~F.array_contains("_p", F.col("alias"))).select(F.element_at("_p", -1).alias("label"), "alias").distinct()


def examples_by_dataset(examples: DataFrame) -> DataFrame:
    return examples.groupBy("dataset").agg(F.count("*").alias("examples"))


def label_paths(nodes: DataFrame) -> DataFrame:
    """(norm, path): for each normalised label the path of its first node."""
    return nodes.groupBy(normalize_index(F.col("label")).alias("norm")).agg(F.min_by("path", "label").alias("path"), F.count("*").alias("paths"))


def entity_paths(chains: DataFrame, key: str = "id", pruned: str = "pruned") -> DataFrame:
    """(id, path) of pruned root-first chains; those pruned to nothing are left out."""
    return chains.where(F.size(pruned) > 0).select(key, chain_path(F.col(pruned)).alias("path"))


def alias_table(aliases: DataFrame) -> DataFrame:
    """(alias, label): of each normalised alias the label that sorts first. aliases: (label, alias)."""
    norm = normalize_index(F.col("alias"))
    return aliases.where(F.col("alias").isNotNull()).groupBy(norm.alias("alias")).agg(F.min("label").alias("label"))


def aliases_by_label(aliases: DataFrame) -> DataFrame:
    """(canonical, alias) distinct, both normalised as audits do."""
    return aliases.select(normalize_audit(F.col("label")).alias("canonical"), normalize_audit(F.col("alias")).alias("alias")).distinct()


def document_frequency(chains: DataFrame, chain: str = "chain") -> DataFrame:
    """(node, df): the number of chains that hold a node."""
    return chains.select(F.explode(F.array_distinct(chain)).alias("node")).groupBy("node").agg(F.count("*").alias("df"))


def reference_paths(examples: DataFrame, nodes: DataFrame, entities: DataFrame | None, labels: DataFrame | None, answer: str = "answer", entity: str = "entity_id") -> DataFrame:
    """examples with reference_path: by the answer's node, else by entity, else by normalised label."""
    by_node = nodes.select(F.col("label").alias("_l"), F.col("path").alias("_p1"))
    out = examples.join(by_node, F.col(answer) == F.col("_l"), "left")
    found = ["_p1"]
    if entities is not None:
        out = out.join(entities.select(F.col("id").alias("_e"), F.col("path").alias("_p2")), F.col(entity) == F.col("_e"), "left").drop("_e")
        found.append("_p2")
    if labels is not None:
        out = out.join(labels.select(F.col("norm").alias("_n"), F.col("path").alias("_p3")), normalize_index(F.col(answer)) == F.col("_n"), "left").drop("_n")
        found.append("_p3")
    return out.withColumn("reference_path", F.coalesce(*found)).drop("_l", *found)
