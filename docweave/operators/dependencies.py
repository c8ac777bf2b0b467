"""Dependency files of projects, and the known libraries they name."""

from __future__ import annotations

import tomllib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.text import clean_version, normalise_package, requirement_name, requirement_version, strip

from .graph import first_wins


def package_json(files: DataFrame, text: str = "text") -> DataFrame:
    """files' rows with name and version of each dependency; development ones win."""
    kind = "dependencies map<string,string>, devDependencies map<string,string>"
    both = files.withColumn("_j", F.from_json(text, kind))
    prod, dev = F.coalesce("_j.dependencies", F.create_map().cast("map<string,string>")), F.coalesce("_j.devDependencies", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(prod, lambda k, v: ~F.map_contains_key(dev, k)), dev)
    return both.withColumn("_d", merged).select(*files.columns, F.explode("_d").alias("name", "version"))


def requirements(files: DataFrame, text: str = "text", raw: bool = False) -> DataFrame:
    """name and version of each requirement; the last of a name holds. raw: lines starting with - count too, and names keep extras."""
    line = files.select("*", F.posexplode(F.split(text, "\n")).alias("line", "_x")).withColumn("_x", strip("_x")).where("_x <> '' AND NOT startswith(_x, '#')")
    if raw:
        name = F.trim(F.split("_x", "[=<>~;]")[0])
        return line.withColumn("name", name).where("name <> ''").select(*files.columns, "line", "name")
    line = line.where("NOT startswith(_x, '-')").withColumn("name", requirement_name("_x")).withColumn("version", requirement_version("_x")).where("name <> ''")
    keys = [c for c in files.columns if c != text]
    return first_wins(line.drop("_x"), [*keys, "name"], [F.desc("line")]).select(*files.columns, "name", "version")


@F.udtf(returnType="name string, version string")
class PyprojectDependencies:
    """PEP 621 strings as they are, then the other table's names with their version text."""

    def eval(self, text: str):
        try:
            data = tomllib.loads(text or "")
        except tomllib.TOMLDecodeError:
            return
        for spec in data.get("project", {}).get("dependencies", []):
            yield str(spec), None
        for name, spec in data.get("tool", {}).get("poetry", {}).get("dependencies", {}).items():
            if name.lower() != "python":
                yield name, spec if isinstance(spec, str) else str(spec.get("version", "latest")) if isinstance(spec, dict) else "latest"


def package_json_names(files: DataFrame, text: str = "text") -> DataFrame:
    """files' rows with the name of each dependency, of both kinds, one after another: names alone, nothing is put together."""
    keys = lambda c: F.coalesce(F.map_keys(F.from_json(F.get_json_object(text, f"$.{c}"), "map<string,string>")), F.array().cast("array<string>"))
    return files.withColumn("_n", F.concat(keys("dependencies"), keys("devDependencies"))).select(*files.columns, F.posexplode("_n").alias("ord", "name"))


def pyproject_names(files: DataFrame, text: str = "text") -> DataFrame:
    """files' rows with the name of each dependency: what stands before the first comparison sign, extras and markers kept."""
    found = files.lateralJoin(PyprojectDependencies(F.col(text).outer()))
    return found.select(*files.columns, F.trim(F.split("name", "[><=~]")[0]).alias("name")).where("name <> '' AND name <> 'python'")


def pyproject(files: DataFrame, text: str = "text") -> DataFrame:
    found = files.lateralJoin(PyprojectDependencies(F.col(text).outer())) if hasattr(F.col(text), "outer") else files
    plain = F.col("version").isNull()
    return found.select(*files.columns, F.when(plain, requirement_name("name")).otherwise(F.col("name")).alias("name"), F.when(plain, requirement_version("name")).otherwise(clean_version("version")).alias("version"))


def detect(deps: DataFrame, libraries: DataFrame, project: str = "project") -> DataFrame:
    """project, library, version: deps (project, source_rank, ord, ecosystem, name, version) against npm and pypi package names; the first detection of a library holds."""
    packages = libraries.select(F.col("id").alias("library"), F.lit("npm").alias("ecosystem"), F.col("npm_package").alias("package")).unionByName(libraries.select(F.col("id").alias("library"), F.lit("pypi").alias("ecosystem"), normalise_package("pypi_package").alias("package"))).where("package IS NOT NULL")
    key = F.when(F.col("ecosystem") == "pypi", normalise_package("name")).otherwise(F.col("name"))
    hit = deps.withColumn("package", key).join(packages, ["ecosystem", "package"])
    return first_wins(hit, [project, "library"], ["source_rank", "ord", "name"]).select(project, "library", clean_version("version").alias("version"))


def scan(deps: DataFrame, libraries: DataFrame, installed: DataFrame) -> DataFrame:
    """name, library and status of distinct names: one lower-cased namespace of ids and package names, the last library of a name."""
    names = F.array("npm_package", "pypi_package", "id")
    known = libraries.select("id", F.explode(names).alias("name")).where("name IS NOT NULL").select(F.lower("name").alias("name"), "id").groupBy("name").agg(F.max("id").alias("library"))
    have = installed.select(F.col("library"), F.lit(True).alias("_have")).distinct()
    out = deps.select(F.lower("name").alias("name")).distinct().join(known, "name", "left").join(have, "library", "left")
    return out.select("name", "library", F.when(F.col("library").isNull(), "unknown").when(F.col("_have"), "available").otherwise("missing").alias("status"))


def to_extract(found: DataFrame, extracted: DataFrame) -> DataFrame:
    return found.join(extracted, ["library", "version"], "left_anti")


DEPENDENCY_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("project", "ecosystem", "name", "version")])
