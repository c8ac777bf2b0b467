"""Pages, registries, manifests and exported graphs as DataFrames, from any folder that Spark reads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions.text import is_doc_path

LIBRARY = """id STRING, name STRING, category STRING, language STRING, repo_url STRING, docs_url STRING, npm_package STRING, pypi_package STRING,
latest_version STRING, tracked_versions ARRAY<STRING>, tags ARRAY<STRING>,
docs_config STRUCT<type:STRING,repo:STRING,branch:STRING,docs_path:STRING,extra_paths:ARRAY<STRING>,base_url:STRING>"""


def registry(spark: SparkSession, path: str) -> DataFrame:
    """libraries from a registry file {libraries: {id: {...}}}."""
    text = spark.read.text(path, wholetext=True)
    field = LIBRARY.replace("\n", " ")
    struct = "struct<" + field.replace(" STRUCT<", ":STRUCT<").replace(" ARRAY<STRING>", ":ARRAY<STRING>").replace(" STRING", ":STRING") + ">"
    rows = text.select(F.from_json("value", f"libraries map<string,{struct}>").alias("r")).select(F.explode("r.libraries").alias("key", "l"))
    return rows.select("l.*").withColumn("docs_config", F.col("docs_config").withField("type", F.coalesce("docs_config.type", F.lit("github_markdown"))).withField("branch", F.coalesce("docs_config.branch", F.lit("main"))))


def discover(libraries: DataFrame, library: str, version: str | None = None) -> DataFrame:
    """The library's row with the wanted version, its latest by default; an unknown library raises KeyError with what there is."""
    found = libraries.where(F.col("id") == library)
    if found.isEmpty():
        raise KeyError(f"{library}: known are {', '.join(r['id'] for r in libraries.select('id').orderBy('id').toLocalIterator())}")
    return found.withColumn("version", F.coalesce(F.lit(version), F.col("latest_version")))


def listing(libraries: DataFrame, installed: DataFrame | None = None) -> DataFrame:
    out = libraries.select("id", "name", "category", "language", "latest_version")
    if installed is not None:
        have = installed.select(F.col("library").alias("id"), F.lit("cached").alias("_have")).distinct()
        out = out.join(have, "id", "left").withColumn("status", F.coalesce("_have", F.lit("available"))).drop("_have")
    return out.orderBy("id")


def single_file(spark: SparkSession, path: str) -> str | None:
    """The text of one file, or None where there is none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    return spark.read.text(path, wholetext=True).first()["value"]


def doc_files_checked(spark: SparkSession, root: str, paths: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """doc_files, and beside it (path, error) of the files that are no UTF-8 text."""
    wanted = [f"{root.rstrip('/')}/{p}".rstrip("/") for p in (paths or [""])]
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(wanted).where(is_doc_path("path"))
    bad = raw.where(~F.is_valid_utf8(F.col("content").cast("string"))).select("path", F.lit("not UTF-8").alias("error")).distinct()
    good = doc_files(spark, root, paths)
    names = bad.select(F.regexp_replace("path", r"^[a-z]+:/*", "/").alias("_bad"))
    return good.join(names, F.regexp_replace("source_url", r"^[a-z]+:/*", "/") == F.col("_bad"), "left_anti"), bad


def doc_files(spark: SparkSession, root: str, paths: list[str] | None = None) -> DataFrame:
    """page_key, content, source_url and file_type of the documentation files under root/path for each path, or the path itself if it is a file."""
    wanted = [f"{root.rstrip('/')}/{p}".rstrip("/") for p in (paths or [""])]
    rows = spark.read.option("recursiveFileLookup", True).text(wanted, wholetext=True).select(F.col("value").alias("content"), F.col("_metadata.file_path").alias("source_url"))
    rows = rows.where(is_doc_path("source_url"))
    key = F.regexp_replace(F.regexp_replace("source_url", r"^[a-z]+:/*", "/"), "^" + root.rstrip("/").replace(".", r"\.") + "/", "")
    return rows.select(key.alias("page_key"), "content", "source_url", F.lower(F.regexp_extract("source_url", r"\.([^./]+)$", 1)).alias("file_type")).dropDuplicates(["page_key"])


def located(roots: list[DataFrame], key: str = "library") -> DataFrame:
    """Rows of the first root that has the key."""
    from docweave.operators.graph import first_wins

    every = None
    for k, df in enumerate(roots):
        one = df.withColumn("_root", F.lit(k))
        every = one if every is None else every.unionByName(one)
    return first_wins(every, [key], ["_root"]).drop("_root")


def write_graph(nodes: DataFrame, edges: DataFrame, folder: str, form: str = "parquet") -> None:
    """Nodes by library, version and type, edges by library and version, so that readers prune to what they name."""
    n = nodes.withColumn("library_id", F.split("version_id", "@")[0]).withColumn("version", F.split("version_id", "@")[1])
    e = edges.withColumn("library_id", F.split("version_id", "@")[0]).withColumn("version", F.split("version_id", "@")[1])
    n.write.mode("overwrite").partitionBy("library_id", "version", "node_type").format(form).save(f"{folder}/nodes")
    e.write.mode("overwrite").partitionBy("library_id", "version").format(form).save(f"{folder}/edges")


def read_graph(spark: SparkSession, folder: str, form: str = "parquet") -> tuple[DataFrame, DataFrame]:
    return spark.read.format(form).load(f"{folder}/nodes"), spark.read.format(form).load(f"{folder}/edges")


def write_graph_lines(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """JSON Lines by version, a line for each node and edge with all attributes (missing ones are left out), and one of metadata.

    Lines are in order of their places, over files ordered by their names; a task holds a range of places, never a version.
    """
    spark = nodes.sparkSession
    for name, df, keys in (("nodes", nodes, ("ord", "id")), ("edges", edges, ("ord", "source", "target"))):
        rest = [c for c in df.columns if c not in (*keys, "version_id")]
        rows = df.repartitionByRange("version_id", *keys).sortWithinPartitions("version_id", *keys, *rest)
        rows.select("version_id", F.to_json(F.struct(*keys, *rest)).alias("value")).write.mode("overwrite").partitionBy("version_id").option("compression", "gzip").text(f"{folder}/{name}")
    written = read_graph_lines(spark, folder, "nodes").select("version_id", F.lit(1).alias("n"), F.lit(0).alias("e"))
    written = written.unionByName(read_graph_lines(spark, folder, "edges").select("version_id", F.lit(0).alias("n"), F.lit(1).alias("e")))
    count = written.groupBy("version_id").agg(F.sum("n").alias("node_count"), F.sum("e").alias("edge_count"))
    meta = F.struct("node_count", "edge_count", F.lit("property_graph").alias("format"))
    count.select("version_id", F.to_json(meta).alias("value")).write.mode("overwrite").partitionBy("version_id").text(f"{folder}/metadata")


def read_graph_lines(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """value (a JSON text) and version_id of the lines of nodes, edges or metadata."""
    return spark.read.schema("value string, version_id string").text(f"{folder}/{name}")


def graph_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row a version: the whole graph with all attributes as a JSON text; missing attributes are left out.

    For single libraries: a text is held by one task and ends at 2 GB. Graphs of any size are written by write_graph_lines.
    """
    n = nodes.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id", *[c for c in nodes.columns if c not in ("ord", "id", "version_id")]))).alias("nodes"))
    e = edges.groupBy("version_id").agg(F.array_sort(F.collect_list(F.struct("ord", "source", "target", *[c for c in edges.columns if c not in ("ord", "source", "target", "version_id")]))).alias("edges"))
    both = n.join(e, "version_id", "left")
    meta = F.struct(F.size("nodes").alias("node_count"), F.coalesce(F.size("edges"), F.lit(0)).alias("edge_count"), F.lit("property_graph").alias("format"))
    return both.select("version_id", F.to_json(F.struct("nodes", "edges", meta.alias("metadata"))).alias("graph"))
