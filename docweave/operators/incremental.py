"""Change detection by content hash, and the manifest that remembers it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def content_hash(c: Column | str) -> Column:
    return F.sha2(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")), 256)


def with_changes(pages: DataFrame, manifest: DataFrame, key: str = "page_key", content: str = "content") -> DataFrame:
    """pages with sha256 and changed: the key is new or its hash differs. Only keys and hashes of the manifest move."""
    p = pages.withColumn("sha256", content_hash(content))
    m = manifest.select(F.col(key), F.col("sha256").alias("_old"))
    return p.join(m, key, "left").withColumn("changed", F.col("_old").isNull() | (F.col("_old") != F.col("sha256"))).drop("_old")


def upsert(manifest: DataFrame, new: DataFrame, key: str = "page_key") -> DataFrame:
    """Rows of new replace those of the same key."""
    return manifest.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*manifest.columns))


def deleted(manifest: DataFrame, pages: DataFrame, key: str = "page_key") -> DataFrame:
    return manifest.join(pages.select(key).distinct(), key, "left_anti")


def keys(manifest: DataFrame, key: str = "page_key") -> DataFrame:
    """The pages that the manifest knows."""
    return manifest.select(key).distinct()


def stats(manifest: DataFrame) -> DataFrame:
    return manifest.agg(F.count(F.lit(1)).alias("pages"), F.sum("node_count").alias("nodes"), F.sum("edge_count").alias("edges"))


def replace_pages(table: DataFrame, new: DataFrame, pages: DataFrame, key: str = "page_key") -> DataFrame:
    """What pages contributed is replaced by new: the incremental form of a rebuild. Collision rules apply to the result as to a full build."""
    return table.join(pages.select(key).distinct(), key, "left_anti").unionByName(new.select(*table.columns))


def expired(files: DataFrame, days: int, now: Column | None = None, modified: str = "modified") -> DataFrame:
    """Files not touched for more than so many days."""
    return files.where(F.col(modified) < (now if now is not None else F.current_timestamp()) - F.expr(f"INTERVAL {int(days)} DAYS"))
