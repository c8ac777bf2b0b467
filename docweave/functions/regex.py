"""Regular-expression matches with their places, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def matches(text: Column, pattern: str, groups: int = 0) -> Column:
    """Array of (start, whole, g1, ..) of all matches, leftmost first; start counts characters from 0."""
    names = ["whole", *[f"g{k}" for k in range(1, groups + 1)]]
    parts = [F.split(text, pattern, -1).alias("between"), *[F.regexp_extract_all(text, F.lit(pattern), F.lit(k)).alias(n) for k, n in enumerate(names)]]
    kind = "array<struct<start:int," + ",".join(f"{n}:string" for n in names) + ">>"
    first = F.struct(F.lit(0).alias("place"), F.array().cast(kind).alias("found"))

    def step(acc: Column, x: Column) -> Column:
        at = acc["place"] + F.length(x["between"])
        new = F.array(F.struct(at.alias("start"), *[x[n].alias(n) for n in names])).cast(kind)
        return F.struct((at + F.coalesce(F.length(x["whole"]), F.lit(0))).alias("place"), F.when(x["whole"].isNotNull(), F.concat(acc["found"], new)).otherwise(acc["found"]).alias("found"))

    return F.aggregate(F.arrays_zip(*parts), first, step, lambda acc: acc["found"])


def line_at(text: Column, start: Column) -> Column:
    """The whole line that holds a place, without outer white space."""
    before = F.element_at(F.split(F.substring(text, F.lit(1), start), "\n"), -1)
    return F.trim(F.concat(before, F.split(F.substring(text, start + 1, F.length(text)), "\n")[0]))


def line_number(text: Column, start: Column) -> Column:
    return F.size(F.split(F.substring(text, F.lit(1), start), "\n"))
