"""Inverted indexes: flat tables for joins, arrays for export."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def flat(symbols: DataFrame, guides: DataFrame | None = None) -> DataFrame:
    """name, id, ord of symbols by name and guides by title; rows without a name or an id are left out."""
    out = symbols.select("name", "id", "ord")
    if guides is not None:
        out = out.unionByName(guides.select(F.col("title").alias("name"), "id", "ord"))
    return out.where("name IS NOT NULL AND name <> '' AND id IS NOT NULL AND id <> ''")


def grouped(index: DataFrame, key: str = "name") -> DataFrame:
    """key and its distinct ids in order of their first place."""
    once = index.groupBy(key, "id").agg(F.min("ord").alias("ord"))
    return once.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("ids"))
