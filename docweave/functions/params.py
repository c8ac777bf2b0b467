"""Parameter lists of signatures as arrays of structs: SQL expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pieces(c: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda p: F.trim(p)), lambda p: p != "")


def _param(name: Column, type_: Column, required: Column, default: Column) -> Column:
    return F.struct(name.alias("name"), type_.alias("type"), required.alias("required"), default.alias("default"))


def _after(text: Column, mark: str) -> Column:
    return F.trim(F.substring(text, F.instr(text, mark) + 1, F.length(text)))


def _before(text: Column, mark: str) -> Column:
    return F.trim(F.substring_index(text, mark, 1))


def ts_params(c: Column) -> Column:
    """Comma-separated; name?: type = default, destructured patterns kept whole up to their colon."""
    none = F.lit(None).cast("string")

    def one(p: Column) -> Column:
        typed = F.instr(p, ":") > 0
        open_ = p.startswith("{") | p.startswith("[")
        pattern = _param(F.when(typed, _before(p, ":")).otherwise(p), F.when(typed, _after(p, ":")).otherwise(F.lit("unknown")), F.instr(p, "?") == 0, none)
        name = F.rtrim(F.substring_index(p, ":", 1))
        kind = F.when(typed, F.trim(F.split(p, ":")[1])).otherwise(F.lit("unknown"))
        has = F.instr(kind, "=") > 0
        plain = _param(
            F.regexp_replace(name, r"\?+$", ""),
            F.when(has, _before(kind, "=")).otherwise(kind),
            (F.instr(name, "?") == 0) & ~has,
            F.when(has, _after(kind, "=")).otherwise(none),
        )
        return F.when(open_, pattern).otherwise(plain)

    return F.transform(_pieces(c), one)


def py_params(c: Column) -> Column:
    """self and cls are dropped; default after the first =, type after the first colon, stars before the name go."""
    none = F.lit(None).cast("string")

    def one(p: Column) -> Column:
        has = F.instr(p, "=") > 0
        head = F.when(has, _before(p, "=")).otherwise(p)
        typed = F.instr(head, ":") > 0
        name = F.when(typed, _before(head, ":")).otherwise(head)
        return _param(F.regexp_replace(F.trim(name), r"^\*+", ""), F.when(typed, _after(head, ":")).otherwise(F.lit("unknown")), ~has, F.when(has, _after(p, "=")).otherwise(none))

    return F.transform(F.filter(_pieces(c), lambda p: ~p.isin("self", "cls")), one)
