"""Deterministic symbols merged with those a model named on the same page, and guide nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import first_wins


def merge_symbols(first: DataFrame, second: DataFrame, page: str = "page_key") -> DataFrame:
    """By page and name: id, kind, signature and module from first; description from the first match in second, even an empty one;
    parameters and return type from first unless empty; then symbols that only second has."""
    one = first_wins(second, [page, "name"], ["ord"])
    s = one.select(page, "name", F.lit(True).alias("_hit"), *[F.col(c).alias(f"_{c}") for c in ("description", "parameters", "return_type", "deprecated", "deprecated_by")])
    j = first.join(s, [page, "name"], "left")
    merged = j.select(
        page,
        "name",
        "kind",
        "signature",
        F.when(F.col("_hit"), F.col("_description")).otherwise(F.col("description")).alias("description"),
        F.when(F.size("parameters") > 0, F.col("parameters")).otherwise(F.col("_parameters")).alias("parameters"),
        F.when(F.col("return_type") != "", F.col("return_type")).otherwise(F.coalesce("_return_type", F.lit(""))).alias("return_type"),
        F.coalesce("_deprecated", F.lit(False)).alias("deprecated"),
        F.col("_deprecated_by").alias("deprecated_by"),
        F.lit("EXTRACTED").alias("confidence"),
    )
    only = second.join(first.select(page, "name").distinct(), [page, "name"], "left_anti")
    extra = only.select(page, "name", "kind", "signature", "description", "parameters", "return_type", "deprecated", "deprecated_by", F.lit("INFERRED").alias("confidence"))
    return merged.unionByName(extra)


def guides(parsed: DataFrame, version_id: str, symbols: DataFrame | None = None, page: str = "page_key", keep: tuple[str, ...] = ()) -> DataFrame:
    """Guide nodes of pages with a title and more than 100 words or any code; at most five code examples. keep: further columns of parsed to carry along."""
    rows = parsed.where((F.col("title") != "") & ((F.col("word_count") > 100) | (F.size("code_blocks") > 0)))
    related = F.array().cast("array<string>")
    if symbols is not None:
        ids = symbols.groupBy(page).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", "id"))), lambda x: x["id"]).alias("related_symbols"))
        rows = rows.join(ids, page, "left")
        related = F.coalesce("related_symbols", related)
    examples = F.transform(F.slice("code_blocks", 1, 5), lambda b: F.struct(b["code"].alias("code"), b["language"].alias("language"), b["title"].alias("title")))
    return rows.select(F.concat(F.lit(version_id + "::guides/"), F.col(page)).alias("id"), F.lit(version_id).alias("version_id"), "title", F.col(page).alias("slug"), examples.alias("code_examples"), related.alias("related_symbols"), F.lit("guide").alias("node_type"), *keep)
