"""Typed property graphs as two DataFrames, with explicit rules for colliding keys.

nodes: id, ord, node_type and attributes; edges: source, target, ord, type and attributes. ord is the place at which a
row was produced; every rule below is stated by it, so results never depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def nodes_last_wins(nodes: DataFrame, id_: str = "id", ord_: str = "ord") -> DataFrame:
    """One row an id: the attributes of the last, at the place of the first."""
    rest = [c for c in nodes.columns if c not in (id_, ord_)]
    last = F.max(F.struct(F.col(ord_), *[F.col(c) for c in rest])).alias("_last")
    return nodes.groupBy(id_).agg(F.min(ord_).alias(ord_), last).select(id_, ord_, *[F.col("_last")[c].alias(c) for c in rest])


def name_to_id(nodes: DataFrame) -> DataFrame:
    """name, id: the last node of each name."""
    return nodes.where("name IS NOT NULL AND name <> ''").groupBy("name").agg(F.max(F.struct("ord", "id")).alias("z")).select("name", F.col("z.id").alias("id"))


def resolve_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Names at both ends become ids (a text that is no name may be an id itself); edges without both ends go.

    Names and ids are joined by equality; Spark broadcasts them only if they are small.
    """
    names = name_to_id(nodes)
    ids = nodes.select("id").distinct()
    out = edges
    for end in ("source", "target"):
        found = names.select(F.col("name").alias("_name"), F.col("id").alias("_id"))
        out = out.join(found, out[end] == found["_name"], "left").withColumn(end, F.coalesce("_id", end)).drop("_name", "_id")
        out = out.join(ids.withColumnRenamed("id", end), end, "left_semi")
    return out.select(*edges.columns)


def edges_last_wins(edges: DataFrame) -> DataFrame:
    """One edge for each (source, target): every attribute has its last value that is not missing, at the place of the first edge."""
    rest = [c for c in edges.columns if c not in ("source", "target", "ord")]
    last = [F.max(F.when(F.col(c).isNotNull(), F.struct("ord", c)))[c].alias(c) for c in rest]
    return edges.groupBy("source", "target").agg(F.min("ord").alias("ord"), *last)


def structural_edges(nodes: DataFrame, version_id: str = "version_id") -> DataFrame:
    """version -> symbol EXPORTS, version -> guide HAS_GUIDE, version -> config HAS_CONFIG."""
    kind = F.when(F.col("node_type") == "symbol", "EXPORTS").when(F.col("node_type") == "guide", "HAS_GUIDE").when(F.col("node_type") == "config", "HAS_CONFIG")
    return nodes.select(F.col(version_id).alias("source"), F.col("id").alias("target"), "ord", kind.alias("type"), F.lit("EXTRACTED").alias("confidence")).where("type IS NOT NULL")


def version_nodes(versions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Library and version nodes with their HAS_VERSION edges. is_latest is computed, not assumed."""
    v = versions.withColumn("version_id", F.concat_ws("@", "library_id", "version"))
    nodes = v.select(F.col("library_id").alias("id"), F.lit("library").alias("node_type"), F.lit(None).cast("boolean").alias("is_latest")).distinct()
    nodes = nodes.unionByName(v.select(F.col("version_id").alias("id"), F.lit("version").alias("node_type"), (F.col("version") == F.col("latest_version")).alias("is_latest")))
    return nodes, v.select(F.col("library_id").alias("source"), F.col("version_id").alias("target"), F.lit("HAS_VERSION").alias("type"), F.lit("EXTRACTED").alias("confidence"))


def references(guides: DataFrame, nodes: DataFrame) -> DataFrame:
    """guide -> related symbol REFERENCES, where the symbol exists."""
    out = guides.select(F.col("id").alias("source"), F.explode("related_symbols").alias("target"))
    return out.join(nodes.select(F.col("id").alias("target")).distinct(), "target", "left_semi").select("source", "target", F.lit("REFERENCES").alias("type"), F.lit("EXTRACTED").alias("confidence"))


def neighbours(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """seed, neighbour, type and direction of all edges at the seeds (id): two equi-joins, never an OR."""
    s = seeds.select(F.col("id").alias("seed"))
    out = edges.join(s, edges["source"] == s["seed"]).select("seed", F.col("target").alias("neighbour"), "type", F.lit("out").alias("direction"), "ord")
    into = edges.join(s, edges["target"] == s["seed"]).select("seed", F.col("source").alias("neighbour"), "type", F.lit("in").alias("direction"), "ord")
    return out.unionByName(into)


def degrees(edges: DataFrame) -> DataFrame:
    ends = edges.select(F.col("source").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(edges.select(F.col("target").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("o").alias("out_degree"), F.sum("i").alias("in_degree"), F.count(F.lit(1)).alias("degree"))


def first_wins(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def version_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A row a version: nodes, edges, symbols, guides and configs."""
    n = nodes.groupBy("version_id").agg(F.count(F.lit(1)).alias("total_nodes"), *[F.count_if(F.col("node_type") == k).alias(f"{k}s") for k in ("symbol", "guide", "config")])
    return n.join(edges.groupBy("version_id").agg(F.count(F.lit(1)).alias("total_edges")), "version_id", "left").withColumn("total_edges", F.coalesce("total_edges", F.lit(0)))
