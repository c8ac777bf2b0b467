"""Markdown pages, graphs and dependency files made from the plain tables by SQL text that both engines run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

NL, TICKS = "chr(10)", "chr(96) || chr(96) || chr(96)"
LANG = "CASE p_size % 4 WHEN 0 THEN 'py' WHEN 1 THEN 'TS' WHEN 2 THEN 'js' ELSE '' END"
PY = f"'import os' || {NL} || 'def make_' || p_size || '(self, a: int = 1, *args, b=2) -> str:' || {NL} || '    pass' || {NL} || 'class Part' || p_size || '(Base):' || {NL} || '@route(1)' || {NL} || 'def _hidden():'"
TS = f"'export function usePart' || p_size || '(a: string, b?: number = 3, {{c}}: Opts): Foo' || {NL} || 'export interface Shape' || p_size || ' {{}}' || {NL} || 'type Alias' || p_size || ' = string;' || {NL} || 'enum Color' || p_size || ' {{ A }}' || {NL} || 'class Widget' || p_size || ' extends Base'"
CODE = f"CASE WHEN p_size % 4 = 0 THEN {PY} ELSE {TS} END"
CONTENT = (
    f"CASE WHEN p_size % 5 = 0 THEN '---' || {NL} || 'title: Front ' || p_brand || {NL} || '---' || {NL} ELSE '' END"
    f" || '# ' || p_name || ' ##' || {NL} || {NL} || 'Intro for ' || p_brand || ', see [' || p_name || '](/parts/' || p_partkey || ') and [ext](https://e.example.com/' || p_size || ') or ![img](./a.png).' || {NL}"
    f" || '## Usage of ' || p_type || {NL} || {TICKS} || {LANG} || CASE WHEN p_size % 3 = 0 AND p_size % 4 <> 3 THEN ' Example ' || p_size ELSE '' END || {NL} || '# in code' || {NL} || {CODE} || {NL} || {TICKS} || {NL}"
    f" || '| Name | Size |' || {NL} || '|------|:----:|' || {NL} || '| ' || p_name || ' | ' || p_size || ' |' || {NL} || '| x | |' || {NL} || '#### C++ & more, v' || p_size || '!' || {NL} || 'end'"
)
PAGES = f"SELECT p_partkey AS page_ord, 'docs/part-' || p_partkey || '.md' AS page_key, p_size, p_name, p_brand, p_type, {CONTENT} AS content, {CODE} AS code FROM part"
#: Symbols, guides and edges of a graph, with names and ids that collide.
NODES = """SELECT 'shop@1::' || p_name || p_size % 7 AS id, p_partkey AS ord, 'symbol' AS node_type, p_name || p_size % 7 AS name, CASE WHEN p_size % 2 = 0 THEN 'function' ELSE 'class' END AS kind, p_brand || ' ' || p_partkey AS signature FROM part
UNION ALL SELECT 'shop@1::guides/' || o_orderkey AS id, 1000000 + o_orderkey AS ord, 'guide' AS node_type, 'Order ' || o_orderpriority || ' ' || o_orderkey AS name, CAST(NULL AS STRING) AS kind, CAST(NULL AS STRING) AS signature FROM orders"""
EDGES = """SELECT 'shop@1::guides/' || l_orderkey AS source, CASE WHEN l_linenumber % 3 = 0 THEN 'no such name' ELSE p_name || p_size % 7 END AS target, ((l_orderkey * 10 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey AS ord, CASE WHEN l_linenumber % 2 = 0 THEN 'REFERENCES' ELSE 'RELATED_TO' END AS type,
CASE WHEN l_linenumber % 2 = 0 THEN CAST(NULL AS DOUBLE) ELSE l_discount END AS score FROM lineitem JOIN part ON l_partkey = p_partkey"""


def run(spark: SparkSession, folder: str, sql: str, *names: str) -> DataFrame:
    """sql over the named tables of folder, without registering views."""
    return spark.sql(_braced(sql, names), **{n: table(spark, folder, n) for n in names})


def _braced(sql: str, names: tuple[str, ...]) -> str:
    import re

    escaped = sql.replace("{", "{{").replace("}", "}}")
    return re.sub(r"\b(FROM|JOIN)\s+(" + "|".join(names) + r")\b", lambda m: f"{m[1]} {{{m[2]}}}", escaped)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, PAGES, "part")


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, NODES, "part", "orders")


def edges(spark: SparkSession, folder: str) -> DataFrame:
    return run(spark, folder, EDGES, "lineitem", "part")


def libraries(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "supplier").select(F.concat(F.lit("lib"), "s_suppkey").alias("id"), F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("npm-"), "s_suppkey")).alias("npm_package"), F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("Py_Pkg."), "s_suppkey")).alias("pypi_package"))
