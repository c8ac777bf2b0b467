"""Connected components of an edge table by alternating large-star and small-star steps, lineage cut each round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import keep, remove, table_path


def components(edges: DataFrame, name: str = "components", most: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b), root the least node of its component; self loops do no harm.

    Rounds grow with the logarithm of the number of nodes; no list of neighbours is ever gathered.
    """
    spark = edges.sparkSession
    edges = keep(edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    seen = None
    for _ in range(most):
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("m", "a"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(small, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = keep(moved.unionByName(small.select("a", F.col("m").alias("b"))).distinct(), name)
        remove(spark, table_path(edges))
        edges = new
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
