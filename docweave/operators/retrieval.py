"""Queries over a graph: keyword search, seeds named in a question, neighbourhoods, and the context they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.text import id_library, id_version, names_word

from .graph import neighbours

# The limits of the answers.
HITS, SEEDS, NEIGHBOURS, FULL_BYTES = 20, 5, 15, 60_000


def keyword_query(index: DataFrame, question: str, library: str | None = None, version: str | None = None, limit: int = HITS) -> DataFrame:
    """The first hits whose name holds the question, in either case, by name and place. library and version are exact."""
    hits = index.where(F.contains(F.lower("name"), F.lower(F.lit(question))))
    if library is not None:
        hits = hits.where(id_library("id") == library)
    if version is not None:
        hits = hits.where(id_version("id") == version)
    return hits.orderBy("name", "ord", "id").limit(limit)


def with_details(hits: DataFrame, symbols: DataFrame) -> DataFrame:
    """name, kind, signature (60 characters), library and version; hits that are no symbols keep their name."""
    s = symbols.select("id", "kind", F.substring("signature", 1, 60).alias("signature"))
    return hits.join(s, "id", "left").select("name", "id", "kind", "signature", id_library("id").alias("library"), id_version("id").alias("version"))


def seeds(nodes: DataFrame, question: str, limit: int = SEEDS) -> DataFrame:
    """Nodes whose name or title stands in the question as words, by place."""
    return nodes.where(names_word(F.lit(question), F.col("name"))).orderBy("ord", "id").limit(limit)


def context_nodes(nodes: DataFrame, edges: DataFrame, question: str, seed_limit: int = SEEDS, near_limit: int = NEIGHBOURS) -> DataFrame:
    """id, role and place of the seeds and their nearest neighbours; a node that is a seed is no neighbour."""
    found = seeds(nodes, question, seed_limit)
    near = neighbours(edges, found.select("id")).groupBy(F.col("neighbour").alias("id")).agg(F.min("ord").alias("ord"))
    near = near.join(found.select("id"), "id", "left_anti").orderBy("ord", "id").limit(near_limit)
    return found.select("id", F.lit("seed").alias("role"), "ord").unionByName(near.select("id", F.lit("neighbour").alias("role"), "ord"))


def format_node() -> Column:
    """A node (node_type, name, kind, signature, description) as Markdown."""
    head = F.when(F.col("node_type") == "guide", F.concat(F.lit("## "), F.col("name"), F.lit(" (guide)"))).otherwise(F.concat(F.lit("## "), F.col("name"), F.lit(" ("), F.coalesce("kind", F.lit("symbol")), F.lit(")")))
    tail = [F.when(F.coalesce(F.col(c), F.lit("")) != "", F.col(c)) for c in ("signature", "description")]
    return F.concat_ws("\n", head, *tail)


def full_context(nodes: DataFrame) -> DataFrame:
    """section, place, text of all guides (1) and symbols (2)."""
    return nodes.select(F.when(F.col("node_type") == "guide", 1).otherwise(2).alias("section"), F.col("ord").alias("place"), format_node().alias("text"))


def route(nodes: DataFrame, by: str) -> DataFrame:
    """by, bytes of all texts, and which way a question about them goes: full if they are small, else graph."""
    size = F.coalesce(F.sum(F.octet_length(format_node())), F.lit(0)).cast("long")
    return nodes.groupBy(by).agg(size.alias("bytes")).withColumn("route", F.when(F.col("bytes") < FULL_BYTES, "full").otherwise("graph"))


def answer(nodes: DataFrame, edges: DataFrame, clusters: DataFrame, question: str) -> DataFrame:
    """section, place, text: the whole graph if its texts are small, else seeds and neighbours, else an outline of clusters."""
    chosen_route = route(nodes, F.lit(1).alias("all")).first()
    if chosen_route is None or chosen_route["route"] == "full":
        return full_context(nodes)
    chosen = context_nodes(nodes, edges, question)
    if chosen.isEmpty():
        outline = F.concat(F.lit("### Cluster: "), F.col("name"), F.lit("\n"), F.col("summary"), F.lit("\nContains symbols: "), F.array_join(F.slice("nodes", 1, 15), ", "))
        return clusters.select(F.lit(0).alias("section"), F.regexp_extract("id", r"(\d+)$", 1).cast("long").alias("place"), outline.alias("text"))
    return chosen.join(nodes.drop("ord"), "id").select(F.when(F.col("role") == "seed", 1).otherwise(2).alias("section"), F.col("ord").alias("place"), format_node().alias("text"))


def status(symbols: DataFrame, guides: DataFrame, edges: DataFrame, by: str = "library") -> DataFrame:
    """Counts of each library and of all together (library TOTAL)."""
    one = lambda df, kind: df.select(F.col(by), F.lit(kind).alias("kind"))
    every = one(symbols, "symbols").unionByName(one(guides, "guides")).unionByName(one(edges, "edges"))
    counts = [F.count_if(F.col("kind") == k).alias(k) for k in ("symbols", "guides", "edges")]
    return every.rollup(by).agg(F.grouping(by).alias("_all"), *counts).select(F.when(F.col("_all") == 1, "TOTAL").otherwise(F.col(by)).alias(by), "symbols", "guides", "edges")
