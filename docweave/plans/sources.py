"""Queries on registries, roots, stored graphs, whole answers, and the many forms of paths, requirements and parameters."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text
from docweave.functions.params import py_params, ts_params
from docweave.operators import dependencies, markdown, retrieval
from docweave.session import shared_folder
from docweave.sources import files

from . import compose, graphs
from .compose import PAGES
from .registry import query, table


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/docweave/{name}-{uuid.uuid4().hex}"


def _registry(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as a registry file, read again; types and branches are given for some only."""
    some = lambda n, c: F.when(F.col("n_nationkey") % n != 0, c)
    config = F.struct(some(3, F.lit("html")).alias("type"), F.concat(F.lit("o/r"), "n_nationkey").alias("repo"), some(2, F.lit("dev")).alias("branch"))
    row = F.struct(F.col("n_name").alias("id"), F.concat(F.lit("Lib "), "n_nationkey").alias("name"), F.col("r_name").alias("category"), F.concat("n_nationkey", F.lit(".1")).alias("latest_version"), F.array(F.lit("x"), F.col("r_name")).alias("tags"), config.alias("docs_config"))
    n = table(spark, folder, "nation").join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    path = _folder(spark, "registry")
    n.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("n_name", row))).alias("libraries")))).write.text(path)
    return files.registry(spark, path)


_REGISTRY = "l AS (SELECT n_name AS id, 'Lib ' || n_nationkey AS name, r_name AS category, n_nationkey || '.1' AS latest_version, CASE WHEN n_nationkey % 3 = 0 THEN 'github_markdown' ELSE 'html' END AS type, CASE WHEN n_nationkey % 2 = 0 THEN 'main' ELSE 'dev' END AS branch FROM nation JOIN region ON n_regionkey = r_regionkey)"


@query("registry_scan", f"WITH {_REGISTRY} SELECT id, name, category, latest_version, 'x,' || category AS tags, type, branch FROM l")
def registry_scan(spark: SparkSession, folder: str) -> DataFrame:
    return _registry(spark, folder).select("id", "name", "category", "latest_version", F.array_join("tags", ",").alias("tags"), "docs_config.type", "docs_config.branch")


@query("discover_versions", f"WITH {_REGISTRY} SELECT id, latest_version AS version FROM l WHERE id = 'NATION_6' UNION ALL SELECT id, '9.9' FROM l WHERE id = 'NATION_18'")
def discover_versions(spark: SparkSession, folder: str) -> DataFrame:
    known = _registry(spark, folder)
    return files.discover(known, "NATION_6").unionByName(files.discover(known, "NATION_18", "9.9")).select("id", "version")


@query("library_listing", f"WITH {_REGISTRY}, h AS (SELECT DISTINCT n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal < 0) SELECT id, name, category, latest_version, CASE WHEN id IN (SELECT n_name FROM h) THEN 'cached' ELSE 'available' END AS status FROM l")
def library_listing(spark: SparkSession, folder: str) -> DataFrame:
    """Nations with a supplier in debt count as installed."""
    have = table(spark, folder, "supplier").join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).where("s_acctbal < 0").select(F.col("n_name").alias("library"))
    return files.listing(_registry(spark, folder), have).drop("language")


@query("first_root", "WITH g AS (SELECT 'lib' || s_nationkey AS library, s_suppkey % 3 AS root, max(s_suppkey) AS k FROM supplier GROUP BY ALL) SELECT library, arg_min(k, root) AS k FROM g GROUP BY library")
def first_root(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers dealt over three roots; the first root that has a nation counts."""
    s = table(spark, folder, "supplier").select(F.concat(F.lit("lib"), "s_nationkey").alias("library"), (F.col("s_suppkey") % 3).alias("root"), F.col("s_suppkey").alias("k"))
    roots = [s.where(F.col("root") == r).groupBy("library").agg(F.max("k").alias("k")) for r in range(3)]
    return files.located(roots)


def _stored(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    path, v = _folder(spark, "graph"), F.lit("shop@1").alias("version_id")
    files.write_graph(graphs._last(spark, folder).select("*", v), graphs._edges(spark, folder).select("*", v), path)
    return files.read_graph(spark, path)


@query("graph_files_nodes", f"WITH {graphs._LAST} SELECT id, ord, node_type, name, kind, signature, 'shop' AS library_id FROM g")
def graph_files_nodes(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, folder)[0].select("id", "ord", "node_type", "name", "kind", "signature", "library_id")


@query("graph_files_edges", f"WITH {graphs._DEDUP} SELECT source, target, ord, type, score FROM d")
def graph_files_edges(spark: SparkSession, folder: str) -> DataFrame:
    return _stored(spark, folder)[1].select("source", "target", "ord", "type", "score")


@query("context_answer", f"""WITH {graphs._DEDUP}, {graphs._LAST[len(graphs._N) + 2 :]}, {graphs._SEEDS}, h AS (SELECT target AS id, d.ord FROM d JOIN s ON source = s.id UNION ALL SELECT source, d.ord FROM d JOIN s ON target = s.id),
k AS (SELECT id, min(ord) AS ord FROM h WHERE id NOT IN (SELECT id FROM s) GROUP BY id ORDER BY ord, id LIMIT 15),
f AS (SELECT id, ord, node_type, '## ' || name || CASE WHEN node_type = 'guide' THEN ' (guide)' ELSE ' (' || kind || ')' END || coalesce(chr(10) || nullif(signature, ''), '') AS text FROM g),
z AS (SELECT sum(octet_length(encode(text))) < 60000 AS small FROM f)
SELECT CASE WHEN node_type = 'guide' THEN 1 ELSE 2 END AS section, ord AS place, text FROM f, z WHERE small
UNION ALL SELECT 1, s.ord, text FROM s JOIN f USING (id), z WHERE NOT small UNION ALL SELECT 2, k.ord, text FROM k JOIN f USING (id), z WHERE NOT small""")
def context_answer(spark: SparkSession, folder: str) -> DataFrame:
    """The whole answer to a question: everything if the graph is small, else what it names and what lies beside that."""
    clusters = spark.createDataFrame([], "id string, name string, summary string, nodes array<string>")
    return retrieval.answer(graphs._last(spark, folder).withColumn("description", F.lit(None).cast("string")), graphs._edges(spark, folder), clusters, graphs.QUESTION)


@query("doc_paths", "SELECT p_partkey, p_size % 10 IN (0, 1, 2, 3, 8, 9) AS doc FROM part")
def doc_paths(spark: SparkSession, folder: str) -> DataFrame:
    ends = (".md", ".MDX", ".rst", ".Html", ".png", "", ".md/x", ".md.bak", ".v2.txt", ".qmd")
    path = F.concat(F.lit("a.b/"), "p_name", F.element_at(F.array(*[F.lit(e) for e in ends]), F.col("p_size") % 10 + 1))
    return table(spark, folder, "part").select("p_partkey", text.is_doc_path(path).alias("doc"))


def _form(number: str, forms: tuple[str, ...]):
    return F.element_at(F.array(*[F.lit(f) for f in forms]), (F.col(number) % len(forms) + 1).cast("int"))


@query("requirement_forms", """WITH f(k, name, version) AS (VALUES (0, 'Requests', '2.31.0'), (1, 'uvicorn', '0.29.0'), (2, 'torch', '2.1'), (3, 'zope.interface', 'latest'), (6, 'a', 'latest'), (8, 'x', '1.0'), (8, 'y', '3.4'))
SELECT s_suppkey, name, version FROM supplier JOIN f ON s_suppkey % 9 = k""")
def requirement_forms(spark: SparkSession, folder: str) -> DataFrame:
    forms = ("Requests >= 2.31.0  # why", "uvicorn[standard]==0.29.0", '  torch ~= 2.1 ; python_version >= "3.9"', "zope.interface<7", "# only==1.0", "-e git+https://e.org/x.git", "a", "", "x==0.9\n\ny>3.4\r\nx==1.0")
    return dependencies.requirements(table(spark, folder, "supplier").select("s_suppkey", _form("s_suppkey", forms).alias("text"))).select("s_suppkey", "name", "version")


@query("py_param_forms", """WITH f(k, name, type, required, "default") AS (VALUES (1, 'x', 'unknown', true, NULL), (2, 'kw', 'Any', true, NULL), (3, 'a', 'unknown', false, '''x'''), (4, 'a', 'Dict', false, 'None'), (5, 'a', 'unknown', true, NULL), (5, 'b', 'str', true, NULL))
SELECT p_partkey, name, type, required, "default" FROM part JOIN f ON p_size % 6 = k""")
def py_param_forms(spark: SparkSession, folder: str) -> DataFrame:
    given = _form("p_size", ("", "cls, x", "**kw: Any", "a='x'", "a: Dict = None", " a , b : str "))
    return table(spark, folder, "part").select("p_partkey", F.explode(py_params(given)).alias("p")).select("p_partkey", "p.*")


@query("ts_param_forms", """WITH f(k, name, type, required, "default") AS (VALUES (1, 'x', 'unknown', true, NULL), (2, 'opts', 'Opts', false, NULL), (3, 'n', 'number', false, '3'), (4, '[a]', 'T', true, NULL), (5, 'a', 'string', true, NULL), (5, 'b', 'unknown', false, NULL))
SELECT p_partkey, name, type, required, "default" FROM part JOIN f ON p_size % 6 = k""")
def ts_param_forms(spark: SparkSession, folder: str) -> DataFrame:
    given = _form("p_size", ("", "x", "opts?: Opts", "n: number = 3", "[a]: T", " a : string , b? "))
    return table(spark, folder, "part").select("p_partkey", F.explode(ts_params(given)).alias("p")).select("p_partkey", "p.*")


@query("md_signature_details", f"""WITH m AS ({PAGES})
SELECT page_key, unnest(['make_' || p_size, 'Part' || p_size, 'route']) AS name, unnest(['def make_' || p_size || '(self, a: int = 1, *args, b=2) -> str:', 'class Part' || p_size || '(Base):', '@route(1)']) AS signature,
  unnest(['a:int:false:1,args:unknown:true:-,b:unknown:false:2', '', '']) AS params, unnest(['str', '', '']) AS return_type FROM m WHERE p_size % 4 = 0
UNION ALL SELECT page_key, unnest(['usePart' || p_size, 'Shape' || p_size, 'Alias' || p_size, 'Color' || p_size, 'Widget' || p_size]),
  unnest(['export function usePart' || p_size || '(a: string, b?: number = 3, {{c}}: Opts): Foo', 'export interface Shape' || p_size || ' {{}}', 'type Alias' || p_size || ' = string;', 'enum Color' || p_size || ' {{ A }}', 'class Widget' || p_size || ' extends Base']), '', '' FROM m WHERE p_size % 4 IN (1, 2)""")
def md_signature_details(spark: SparkSession, folder: str) -> DataFrame:
    """Full lines, parameters and return types of signatures."""
    s = markdown.signatures(markdown.parsed(compose.pages(spark, folder)))
    shown = F.transform("parameters", lambda p: F.concat_ws(":", p["name"], p["type"], p["required"].cast("string"), F.coalesce(p["default"], F.lit("-"))))
    return s.select("page_key", "name", "signature", F.array_join(shown, ",").alias("params"), "return_type")
