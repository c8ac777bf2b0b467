"""Scalar functions on strings as Column expressions; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fence languages and what they stand for.
LANGUAGE_ALIASES = {"js": "javascript", "ts": "typescript", "tsx": "typescript", "jsx": "javascript", "py": "python", "rb": "ruby", "yml": "yaml", "sh": "bash", "shell": "bash"}
DOC_EXTENSIONS = (".md", ".mdx", ".txt", ".rst", ".html", ".htm", ".qmd")


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without white space at both ends (Unicode's, as str.strip)."""
    return F.regexp_replace(F.regexp_replace(col(c), r"(?U)^\s+", ""), r"(?U)\s+$", "")


def slugify(c: Column | str) -> Column:
    kept = F.regexp_replace(strip(F.lower(col(c))), r"(?U)[^\w\s-]", "")
    return F.trim(F.regexp_replace(kept, r"(?U)\s+", "-"), F.lit("-"))


def word_count(c: Column | str) -> Column:
    return F.size(F.filter(F.split(F.coalesce(col(c), F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def language(c: Column | str) -> Column:
    """Lower-cased fence language with aliases resolved."""
    low = F.lower(col(c))
    aliases = F.create_map(*[F.lit(x) for kv in LANGUAGE_ALIASES.items() for x in kv])
    return F.coalesce(F.try_element_at(aliases, low), low)


def page_key(url: Column | str) -> Column:
    """URL path without outer slashes, index if empty, with .md; host, query and fragment play no part."""
    path = F.trim(F.coalesce(F.regexp_extract(col(url), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1), F.lit("")), F.lit("/"))
    return F.when(path == "", "index.md").when(path.endswith(".md"), path).otherwise(F.concat(path, F.lit(".md")))


def is_doc_path(path: Column | str) -> Column:
    return F.lower(F.regexp_extract(col(path), r"(\.[^./]+)$", 1)).isin(*DOC_EXTENSIONS)


def normalise_package(c: Column | str) -> Column:
    return F.lower(F.regexp_replace(col(c), "[-_.]+", "-"))


def _first_version(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"(\d+\.\d+(?:\.\d+)?)", 1), F.lit(""))


def clean_version(c: Column | str) -> Column:
    """The first x.y or x.y.z, else the text without operators at its ends."""
    return F.coalesce(_first_version(col(c)), F.trim(col(c), F.lit("^~=><! ")))


def requirement_name(c: Column | str) -> Column:
    return F.regexp_extract(strip(c), r"^([A-Za-z0-9](?U:[\w.-]*))", 1)


def requirement_version(c: Column | str) -> Column:
    text = strip(c)
    rest = F.when(requirement_name(text) == "", F.lit("")).otherwise(F.substring(text, F.length(requirement_name(text)) + 1, F.length(text)))
    return F.coalesce(_first_version(rest), F.lit("latest"))


def symbol_id(version_id: Column | str, module: Column | str, name: Column | str) -> Column:
    return F.when(F.coalesce(col(module), F.lit("")) == "", F.concat_ws("::", col(version_id), col(name))).otherwise(F.concat_ws("::", col(version_id), col(module), col(name)))


def guide_id(version_id: Column | str, key: Column | str) -> Column:
    return F.concat(col(version_id), F.lit("::guides/"), col(key))


def id_library(c: Column | str) -> Column:
    return F.split(F.split(col(c), "::")[0], "@")[0]


def id_version(c: Column | str) -> Column:
    return F.get(F.split(F.split(col(c), "::")[0], "@"), F.lit(1))


def quote_regex(c: Column) -> Column:
    """c as a literal inside a pattern."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def names_word(query: Column, name: Column) -> Column:
    """Whether query has name as whole words, in either case; names under four characters never match."""
    return (F.length(name) >= 4) & F.rlike(query, F.concat(F.lit(r"(?iU)\b"), quote_regex(name), F.lit(r"\b")))


def version_key(c: Column | str) -> Column:
    """An array of numbers that orders versions as numbers."""
    return F.transform(F.split(col(c), r"\."), lambda p: F.coalesce(F.nullif(F.regexp_extract(p, r"^(\d+)", 1), F.lit("")).cast("long"), F.lit(-1)))
