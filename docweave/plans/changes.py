"""Queries on change detection, registries, dependency files, the model pass and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import text
from docweave.operators import dependencies, incremental, markdown, model_pass
from docweave.session import shared_folder
from docweave.sources import libraries as library_source
from docweave.streaming import ingest

from . import compose
from .registry import query, table


def _docs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(F.concat(F.lit("doc/"), "doc_id").alias("page_key"), "doc_id", F.col("text").alias("content"))


def _manifest(spark: SparkSession, folder: str) -> DataFrame:
    """What an earlier run would have left: even ids, every seventh with another hash, and some pages that are gone."""
    d = _docs(spark, folder).where("doc_id % 2 = 0")
    sha = F.when(F.col("doc_id") % 7 == 0, F.lit("stale")).otherwise(incremental.content_hash("content"))
    key = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("gone/"), "doc_id")).otherwise(F.col("page_key"))
    return d.select(key.alias("page_key"), sha.alias("sha256"), (F.col("doc_id") % 5).alias("node_count"), F.lit(0).cast("long").alias("edge_count"))


_MANIFEST = "k AS (SELECT CASE WHEN doc_id % 10 = 0 THEN 'gone/' ELSE 'doc/' END || doc_id AS page_key, CASE WHEN doc_id % 7 = 0 THEN 'stale' ELSE sha256(coalesce(text, '')) END AS sha256, doc_id % 5 AS node_count FROM documents WHERE doc_id % 2 = 0)"


@query("word_count_by_lang", "SELECT lang, count(*) AS n, sum(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')))::BIGINT AS words FROM documents GROUP BY lang")
def word_count_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.sum(text.word_count("text")).alias("words"))


@query("content_sha256_changed", f"WITH {_MANIFEST} SELECT d.doc_id, sha256(coalesce(d.text, '')) AS sha256, (k.sha256 IS NULL OR k.sha256 <> sha256(coalesce(d.text, ''))) AS changed FROM documents d LEFT JOIN k ON k.page_key = 'doc/' || d.doc_id")
def content_sha256_changed(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.with_changes(_docs(spark, folder), _manifest(spark, folder)).select("doc_id", "sha256", "changed")


@query("manifest_stats", f"WITH {_MANIFEST} SELECT count(*) AS pages, sum(node_count)::BIGINT AS nodes, 0::BIGINT AS edges FROM k")
def manifest_stats(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.stats(_manifest(spark, folder))


@query("deleted_pages", f"WITH {_MANIFEST} SELECT page_key FROM k WHERE starts_with(page_key, 'gone/')")
def deleted_pages(spark: SparkSession, folder: str) -> DataFrame:
    return incremental.deleted(_manifest(spark, folder), _docs(spark, folder)).select("page_key")


@query("manifest_upsert", f"WITH {_MANIFEST} SELECT page_key, sha256 FROM k WHERE starts_with(page_key, 'gone/') UNION ALL SELECT 'doc/' || doc_id, sha256(coalesce(text, '')) FROM documents")
def manifest_upsert(spark: SparkSession, folder: str) -> DataFrame:
    new = _docs(spark, folder).select("page_key", incremental.content_hash("content").alias("sha256"))
    return incremental.upsert(_manifest(spark, folder).select("page_key", "sha256"), new)


@query("expired_cache", "SELECT event_id FROM events WHERE ts < (SELECT max(ts) FROM events) - INTERVAL 3 DAYS")
def expired_cache(spark: SparkSession, folder: str) -> DataFrame:
    e = table(spark, folder, "events")
    return incremental.expired(e.withColumnRenamed("ts", "modified"), 3, e.agg(F.max("ts")).scalar()).select("event_id")


_VERSION = "CASE p_size % 6 WHEN 0 THEN '^' || p_size || '.2.3' WHEN 1 THEN '~=' || p_size || '.0' WHEN 2 THEN '>=1,<2' WHEN 3 THEN 'latest' WHEN 4 THEN '*' ELSE 'workspace:*' END"


@query("clean_version", f"SELECT p_partkey, coalesce(nullif(regexp_extract(v, '(\\d+\\.\\d+(?:\\.\\d+)?)', 1), ''), trim(v, '^~=><! ')) AS version FROM (SELECT p_partkey, {_VERSION} AS v FROM part)")
def clean_version(spark: SparkSession, folder: str) -> DataFrame:
    return compose.run(spark, folder, f"SELECT p_partkey, {_VERSION} AS v FROM part", "part").select("p_partkey", text.clean_version("v").alias("version"))


@query("pep503_names", "SELECT p_partkey, lower(regexp_replace(replace(p_name, ' ', '_.-') || '.' || p_brand, '[-_.]+', '-', 'g')) AS name FROM part")
def pep503_names(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select("p_partkey", text.normalise_package(F.concat(F.replace("p_name", F.lit(" "), F.lit("_.-")), F.lit("."), "p_brand")).alias("name"))


_REQ = "'# top' || chr(10) || 'Py_Pkg.' || s_suppkey || '>=1.' || s_nationkey || chr(10) || '-r other.txt' || chr(10) || 'numpy[all]; python_version>3' || chr(10) || 'py-pkg-' || (s_suppkey + 3) || ' == 2.0.1'"


@query("requirements_scan", """SELECT s_suppkey, unnest(['Py_Pkg.' || s_suppkey, 'numpy', 'py-pkg-' || (s_suppkey + 3)]) AS name, unnest(['1.' || s_nationkey, 'latest', '2.0.1']) AS version FROM supplier""")
def requirements_scan(spark: SparkSession, folder: str) -> DataFrame:
    f = compose.run(spark, folder, f"SELECT s_suppkey, {_REQ} AS text FROM supplier", "supplier")
    return dependencies.requirements(f).select("s_suppkey", "name", "version")


@query("requirements_scan_raw", """SELECT s_suppkey, unnest(['Py_Pkg.' || s_suppkey, '-r other.txt', 'numpy[all]', 'py-pkg-' || (s_suppkey + 3)]) AS name FROM supplier""")
def requirements_scan_raw(spark: SparkSession, folder: str) -> DataFrame:
    f = compose.run(spark, folder, f"SELECT s_suppkey, {_REQ} AS text FROM supplier", "supplier")
    return dependencies.requirements(f, raw=True).select("s_suppkey", "name")


_JSON = """'{"dependencies": {"npm-' || s_suppkey || '": "^1.2", "left": "1.0"}, "devDependencies": {"left": "~2.' || s_nationkey || '"}}'"""


@query("package_json_scan", "SELECT s_suppkey, unnest(['npm-' || s_suppkey, 'left']) AS name, unnest(['^1.2', '~2.' || s_nationkey]) AS version FROM supplier")
def package_json_scan(spark: SparkSession, folder: str) -> DataFrame:
    return dependencies.package_json(compose.run(spark, folder, f"SELECT s_suppkey, {_JSON} AS text FROM supplier", "supplier")).select("s_suppkey", "name", "version")


_TOML = """'[project]' || chr(10) || 'dependencies = ["fast-' || s_suppkey || '>=0.1' || s_nationkey || '"]' || chr(10) || '[tool.poetry.dependencies]' || chr(10) || 'python = "^3.11"' || chr(10) || 'web = "^0.' || s_nationkey || '"' || chr(10) || 'orm = {version = "~1.4.' || s_nationkey || '"}'"""


@query("pyproject_scan", "SELECT s_suppkey, unnest(['fast-' || s_suppkey, 'web', 'orm']) AS name, unnest(['0.1' || s_nationkey, '0.' || s_nationkey, '1.4.' || s_nationkey]) AS version FROM supplier")
def pyproject_scan(spark: SparkSession, folder: str) -> DataFrame:
    f = compose.run(spark, folder, f"SELECT s_suppkey, {_TOML} AS text FROM supplier", "supplier")
    return dependencies.pyproject(f).select("s_suppkey", "name", "version")


def _deps(spark: SparkSession, folder: str) -> DataFrame:
    req = compose.run(spark, folder, f"SELECT s_suppkey AS project, {_REQ} AS text FROM supplier", "supplier")
    js = compose.run(spark, folder, f"SELECT s_suppkey AS project, {_JSON} AS text FROM supplier", "supplier")
    put = lambda df, rank, eco: df.select("project", F.lit(rank).alias("source_rank"), F.lit(0).alias("ord"), F.lit(eco).alias("ecosystem"), "name", "version")
    return put(dependencies.package_json(js), 0, "npm").unionByName(put(dependencies.requirements(req), 1, "pypi"))


_DETECT = """l AS (SELECT 'lib' || s_suppkey AS library, CASE WHEN s_suppkey % 2 = 0 THEN 'npm-' || s_suppkey END AS npm, CASE WHEN s_suppkey % 3 = 0 THEN 'py-pkg-' || s_suppkey END AS pypi FROM supplier),
d AS (SELECT s_suppkey AS project, 0 AS r, 'npm-' || s_suppkey AS n, '1.2' AS v FROM supplier UNION ALL SELECT s_suppkey, 1, 'py-pkg-' || s_suppkey, '1.' || s_nationkey FROM supplier UNION ALL SELECT s_suppkey, 2, 'py-pkg-' || (s_suppkey + 3), '2.0.1' FROM supplier),
h AS (SELECT project, library, r, v FROM d JOIN l ON (r = 0 AND n = npm) OR (r > 0 AND n = pypi)), f AS (SELECT *, row_number() OVER (PARTITION BY project, library ORDER BY r) AS k FROM h), z AS (SELECT project, library, v AS version FROM f WHERE k = 1)"""


@query("dep_scan", f"WITH {_DETECT} SELECT project, library, version FROM z")
def dep_scan(spark: SparkSession, folder: str) -> DataFrame:
    return dependencies.detect(_deps(spark, folder), compose.libraries(spark, folder))


@query("to_extract", f"WITH {_DETECT} SELECT project, library, version FROM z WHERE NOT (library IN (SELECT 'lib' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0) AND version = '1.2')")
def to_extract(spark: SparkSession, folder: str) -> DataFrame:
    have = compose.libraries(spark, folder).where("CAST(substring(id, 4) AS INT) % 4 = 0").select(F.col("id").alias("library"), F.lit("1.2").alias("version"))
    return dependencies.to_extract(dep_scan(spark, folder), have).select("project", "library", "version")


@query("dep_status", """WITH n AS (SELECT DISTINCT lower(n) AS name FROM (SELECT 'npm-' || s_suppkey AS n FROM supplier UNION ALL SELECT 'left' FROM supplier UNION ALL SELECT 'Py_Pkg.' || s_suppkey FROM supplier UNION ALL SELECT 'numpy' FROM supplier UNION ALL SELECT 'py-pkg-' || (s_suppkey + 3) FROM supplier)),
k AS (SELECT 'npm-' || s_suppkey AS name, s_suppkey AS s FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT lower('Py_Pkg.' || s_suppkey), s_suppkey FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT 'lib' || s_suppkey, s_suppkey FROM supplier)
SELECT n.name, 'lib' || s AS library, CASE WHEN s IS NULL THEN 'unknown' WHEN s % 4 = 0 THEN 'available' ELSE 'missing' END AS status FROM n LEFT JOIN k USING (name)""")
def dep_status(spark: SparkSession, folder: str) -> DataFrame:
    libs = compose.libraries(spark, folder)
    return dependencies.scan(_deps(spark, folder), libs, libs.where("CAST(substring(id, 4) AS INT) % 4 = 0").select(F.col("id").alias("library")))


@query("version_order", "SELECT s_nationkey, max(s_suppkey) FILTER (WHERE r = 1) AS newest FROM (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey // 10 DESC, s_suppkey % 10 DESC) AS r FROM supplier) GROUP BY s_nationkey")
def version_order(spark: SparkSession, folder: str) -> DataFrame:
    """Versions ordered as numbers, not as text."""
    s = table(spark, folder, "supplier").withColumn("v", F.concat_ws(".", F.floor(F.col("s_suppkey") / 10).cast("string"), (F.col("s_suppkey") % 10).cast("string")))
    w = Window.partitionBy("s_nationkey").orderBy(F.desc(text.version_key("v")))
    return s.withColumn("r", F.row_number().over(w)).where("r = 1").select("s_nationkey", F.col("s_suppkey").alias("newest"))


_ANSWER = """CASE p_size % 5 WHEN 0 THEN chr(96) || chr(96) || chr(96) || 'json' || chr(10) || '{"symbols": [{"name": "' || p_name || '"}, {"kind": "class"}], "relationships": [{"source": "a", "target": "b' || p_size || '"}, {"source": "a"}], "summary": "s"}' || chr(10) || chr(96) || chr(96) || chr(96)
WHEN 1 THEN '{"symbols": [{"name": "n' || p_size || '", "kind": "class"}], "relationships": [{"source": "x", "target": "y", "type": "EXTENDS", "confidence_score": 0.5}]}' WHEN 2 THEN 'no json' WHEN 3 THEN '[1, 2]' ELSE '{}' END"""


@query("llm_response_parse", """SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN p_name WHEN 1 THEN 'n' || p_size END AS name, CASE p_size % 5 WHEN 0 THEN 'function' WHEN 1 THEN 'class' END AS kind, CASE p_size % 5 WHEN 0 THEN 'b' || p_size WHEN 1 THEN 'y' END AS target,
CASE p_size % 5 WHEN 0 THEN 'RELATED_TO' WHEN 1 THEN 'EXTENDS' END AS type, CASE p_size % 5 WHEN 0 THEN 0.8 WHEN 1 THEN 0.5 END::DOUBLE AS score, p_size % 5 IN (2, 3) AS failed FROM part""")
def llm_response_parse(spark: SparkSession, folder: str) -> DataFrame:
    p = model_pass.parse_answers(compose.run(spark, folder, f"SELECT p_partkey, {_ANSWER} AS answer FROM part", "part"))
    s, r = F.get("symbols", F.lit(0)), F.get("relationships", F.lit(0))
    return p.select("p_partkey", s["name"].alias("name"), s["kind"].alias("kind"), r["target"].alias("target"), r["type"].alias("type"), r["confidence_score"].alias("score"), F.col("error").isNotNull().alias("failed"))


@query("llm_prompt", """WITH t AS (SELECT doc_id, lang, source, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS s FROM documents)
SELECT doc_id, sha256('# ' || source || CASE WHEN doc_id % 2 = 0 THEN chr(10) || chr(10) || '## Frontmatter' || chr(10) || '{"lang":"' || lang || '"}' ELSE '' END
|| chr(10) || chr(10) || '## Headings' || chr(10) || '- Top' || chr(10) || '    - ' || lang
|| CASE WHEN doc_id % 3 = 0 THEN chr(10) || chr(10) || '## Signatures' || chr(10) || '- function f' || doc_id || ': def f(): pass' ELSE '' END
|| CASE WHEN doc_id % 5 = 0 THEN chr(10) || chr(10) || '## Tables' || chr(10) || 'under Top' || chr(10) || 'a | b' || chr(10) || array_to_string(list_transform(range(5), lambda k: k || ' | ' || doc_id), chr(10)) ELSE '' END
|| chr(10) || chr(10) || '## Text' || chr(10) || CASE WHEN length(s) > 8000 THEN substr(s, 1, 8000) || chr(10) || '...[truncated]' ELSE s END) AS prompt_sha256 FROM t""")
def llm_prompt(spark: SparkSession, folder: str) -> DataFrame:
    """All parts of a prompt, each on some documents only; seven rows of a table, of which five are shown."""
    only = lambda n, c, t: F.when(F.col("doc_id") % n == 0, c).otherwise(F.array().cast(t))
    d = table(spark, folder, "documents").select(
        "doc_id",
        F.col("source").alias("title"),
        F.when(F.col("doc_id") % 2 == 0, F.create_map(F.lit("lang"), F.col("lang"))).otherwise(F.create_map().cast("map<string,string>")).alias("front"),
        F.array(F.struct(F.lit("Top").alias("text"), F.lit(1).alias("level")), F.struct(F.col("lang").alias("text"), F.lit(3).alias("level"))).alias("headings"),
        only(3, F.array(F.struct(F.lit("function").alias("kind"), F.concat(F.lit("f"), "doc_id").alias("name"), F.lit("def f(): pass").alias("signature"))), "array<struct<kind:string,name:string,signature:string>>").alias("signatures"),
        only(5, F.array(F.struct(F.array(F.lit("a"), F.lit("b")).alias("headers"), F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: F.array(k.cast("string"), F.col("doc_id").cast("string"))).alias("rows"), F.lit("Top").alias("context_heading"))), "array<struct<headers:array<string>,rows:array<array<string>>,context_heading:string>>").alias("tables"),
        F.col("text").alias("raw_text"),
    )
    return d.select("doc_id", F.sha2(model_pass.prompt(), 256).alias("prompt_sha256"))


@query("llm_gate", f"""WITH d AS (SELECT doc_id, len(list_filter(regexp_split_to_array(text, '\\s+'), lambda w: w <> '')) AS words FROM documents)
SELECT doc_id, CASE WHEN words < 50 AND doc_id % 3 <> 0 THEN '{model_pass.SHORT}' ELSE 'said ' || (doc_id % 7) END AS summary, CASE WHEN words >= 50 OR doc_id % 3 = 0 THEN CASE WHEN doc_id % 7 = 1 THEN 'not a JSON object' END END AS error FROM d WHERE NOT ((words >= 50 OR doc_id % 3 = 0) AND doc_id % 7 = 1)
UNION ALL SELECT doc_id, '', 'not a JSON object' FROM d WHERE (words >= 50 OR doc_id % 3 = 0) AND doc_id % 7 = 1""")
def llm_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Every document as a page: short ones without signatures get the fixed summary, the others what a caller says of them."""
    none = lambda t: F.array().cast(t)
    signed = F.when(F.col("doc_id") % 3 == 0, F.array(F.struct(F.lit("function").alias("kind"), F.lit("f").alias("name"), F.lit("f()").alias("signature")))).otherwise(none("array<struct<kind:string,name:string,signature:string>>"))
    d = table(spark, folder, "documents")
    pages = d.select(F.col("doc_id").cast("string").alias("page_key"), F.col("doc_id").cast("string").alias("title"), F.create_map().cast("map<string,string>").alias("front"), none("array<struct<text:string,level:int>>").alias("headings"), none("array<struct<headers:array<string>,rows:array<array<string>>,context_heading:string>>").alias("tables"), signed.alias("signatures"), F.col("text").alias("raw_text"), text.word_count("text").alias("word_count"))

    def call(prompt: str) -> str:
        number = int(prompt.split("\n", 1)[0][2:])
        return "no JSON" if number % 7 == 1 else '{"summary": "said %d"}' % (number % 7)

    return model_pass.extract(pages, call).select(F.col("page_key").cast("long").alias("doc_id"), "summary", "error")


_YAML = """'---' || chr(10) || 'title: "Of: ' || source || '"' || chr(10) || '# comment' || chr(10) || 'tags:' || chr(10) || '  - ' || lang || chr(10) || '  - "n' || doc_id || '"' || chr(10) || 'inline: [a, ''b c'', ' || doc_id || ']' || chr(10)
|| 'author:' || chr(10) || '  name: A B' || chr(10) || '  id: ' || doc_id || chr(10) || 'draft: ' || (doc_id % 2) || '   # why' || chr(10) || 'draft: last' || chr(10) || 'empty:' || chr(10) || '---' || chr(10) || 'body'"""


@query("md_frontmatter", """SELECT doc_id, unnest(['title', 'tags', 'inline', 'author', 'draft']) AS key, unnest(['Of: ' || source, '["' || lang || '","n' || doc_id || '"]', '["a","b c","' || doc_id || '"]', '{"name":"A B","id":"' || doc_id || '"}', 'last']) AS value FROM documents""")
def md_frontmatter(spark: SparkSession, folder: str) -> DataFrame:
    d = compose.run(spark, folder, f"SELECT doc_id, {_YAML} AS content FROM documents", "documents")
    return d.select("doc_id", F.explode(markdown.frontmatter("content")).alias("key", "value"))


@query("package_json_names", "SELECT s_suppkey, unnest(['npm-' || s_suppkey, 'left', 'left']) AS name, unnest([0, 1, 2])::INTEGER AS ord FROM supplier")
def package_json_names(spark: SparkSession, folder: str) -> DataFrame:
    return dependencies.package_json_names(compose.run(spark, folder, f"SELECT s_suppkey, {_JSON} AS text FROM supplier", "supplier")).select("s_suppkey", "name", "ord")


@query("pyproject_names", "SELECT s_suppkey, unnest(['fast-' || s_suppkey, 'web', 'orm']) AS name FROM supplier")
def pyproject_names(spark: SparkSession, folder: str) -> DataFrame:
    return dependencies.pyproject_names(compose.run(spark, folder, f"SELECT s_suppkey, {_TOML} AS text FROM supplier", "supplier")).select("s_suppkey", "name")


@query("library_info", """WITH e AS (SELECT DISTINCT n_name AS id, s_suppkey // 10 AS a, s_suppkey % 10 AS b FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey % 2 = 0)
SELECT n_name AS id, coalesce((SELECT string_agg(a || '.' || b, ',' ORDER BY a DESC, b DESC) FROM e WHERE e.id = n_name), '') AS extracted FROM nation""")
def library_info(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as libraries; every other supplier is an extracted version, ordered by number."""
    libs = table(spark, folder, "nation").select(F.col("n_name").alias("id"), F.col("n_nationkey").alias("k"))
    v = F.concat_ws(".", F.floor(F.col("s_suppkey") / 10).cast("string"), (F.col("s_suppkey") % 10).cast("string"))
    have = table(spark, folder, "supplier").join(libs, F.col("s_nationkey") == F.col("k")).select(F.col("id").alias("library"), F.when(F.col("s_suppkey") % 2 == 0, v).alias("version"))
    return library_source.info(libs.select("id"), have).select("id", F.array_join("extracted", ",").alias("extracted"))


@query("stream_incremental_ingest", "SELECT 'doc/' || doc_id AS page_key, sha256(text) AS sha256 FROM documents")
def stream_incremental_ingest(spark: SparkSession, folder: str) -> DataFrame:
    """documents as a stream, ingested twice: the second run finds nothing new."""
    root = f"{shared_folder(spark)}/docweave/stream-{uuid.uuid4().hex}"
    schema = table(spark, folder, "documents").schema
    for run in ("first", "second"):
        stream = spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{folder}/documents.parquet*").select(F.concat(F.lit("doc/"), "doc_id").alias("page_key"), F.col("text").alias("content"))
        q = ingest.ingest(stream, f"{root}/manifest", f"{root}/sink-{run}", f"{root}/checkpoint-{run}")
        q.awaitTermination()
    return ingest.read_manifest(spark, f"{root}/manifest").select("page_key", "sha256")


@query("windowed_event_counts", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def windowed_event_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The batch form of the windowed stream (beyond what documents need)."""
    return ingest.windowed_counts(table(spark, folder, "events")).withColumn("total", F.round("total", 4))
