"""From pages of one library version to its stored graph: change filter, parse, merge, build, communities, index, manifest.

A later run with update=True works on changed pages only and replaces what those pages contributed, so its result is
that of a full run. Tables are Parquet under folder/library/version; each is written from a copy in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.text import symbol_id, version_key
from docweave.operators import community, dependencies, graph, incremental, index, markdown, merge, model_pass, retrieval
from docweave.session import cut_lineage
from docweave.sources import files
from docweave.sources import libraries as library_source

#: Places of a page: its symbols by block, pattern and place in the block, then the model's, its relations, its guide.
_ORD = 1 << 40
_MODEL, _RELATION, _GUIDE = 1 << 37, 1 << 38, 1 << 39


def _read(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where) else None


def page_nodes(parsed: DataFrame, version_id: str, answers: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Symbol and guide nodes of pages with page_key and ord; with answers of a model, its symbols and descriptions too."""
    # a block's symbols by pattern and place: no two of a page share a number
    inside = Window.partitionBy("page_key", "block").orderBy("pattern", "start", "name")
    first = markdown.signatures(parsed).withColumn("place", F.row_number().over(inside)).join(parsed.select("page_key", "page_ord"), "page_key")
    first = first.withColumn("ord", F.col("page_ord") * _ORD + F.least(F.col("block").cast("long"), F.lit((1 << 17) - 1)) * (1 << 20) + F.col("place")).withColumn("description", F.lit(""))
    names = first.select("page_key", "name", F.col("ord").alias("first_ord"))
    if answers is not None:
        said = answers.select("page_key", F.posexplode("symbols").alias("ord", "s")).select("page_key", "ord", "s.*")
        said = said.withColumn("parameters", F.array().cast(first.schema["parameters"].dataType))
        merged = merge.merge_symbols(first, said.withColumn("signature", F.coalesce("signature", F.lit(""))))
    else:
        blank = first.limit(0).select("page_key", "name", "kind", "signature", "description", "parameters", "return_type", F.lit(False).alias("deprecated"), F.lit("").alias("deprecated_by"), "ord")
        merged = merge.merge_symbols(first, blank)
    if answers is not None:
        merged = merged.join(said.groupBy("page_key", "name").agg(F.min("ord").cast("long").alias("said_ord")), ["page_key", "name"], "left")
    else:
        merged = merged.withColumn("said_ord", F.lit(0).cast("long"))
    symbols = merged.join(names, ["page_key", "name"], "left").join(parsed.select("page_key", "page_ord"), "page_key")
    symbols = symbols.select("page_key", symbol_id(F.lit(version_id), F.lit(""), F.col("name")).alias("id"), F.coalesce("first_ord", F.col("page_ord") * _ORD + _MODEL + F.coalesce("said_ord", F.lit(0))).alias("ord"), F.lit("symbol").alias("node_type"), "name", "kind", "signature", "description")
    guides = merge.guides(parsed, version_id, symbols, keep=("page_key", "page_ord"))
    return symbols, guides


def _roots(spark: SparkSession, library: str, version: str, latest: str) -> DataFrame:
    """The library's node and the version's, which no page gives: a table beside nodes, with the places before all others."""
    rows = [(library, -2, "library", library, None), (f"{library}@{version}", -1, "version", version, version == latest)]
    return spark.createDataFrame(rows, "id string, ord long, node_type string, name string, is_latest boolean")


def extract_from_registry(libraries: DataFrame, library: str, folder: str, checkouts: str, crawled: DataFrame | None = None, sitemaps: DataFrame | None = None, version: str | None = None, **options) -> dict:
    """From a library's id to its stored graph: its registry row, the pages of its source, the build, and its meta row."""
    row = files.discover(libraries, library, version).first()
    pages = library_source.fetch(row, checkouts, crawled, sitemaps, libraries.sparkSession)
    built = extract_library(pages, library, row["version"], folder, latest=row["latest_version"], **options)
    library_source.write_meta(libraries, library, folder)
    return built


def extract_missing(deps: DataFrame, libraries: DataFrame, folder: str, checkouts: str, crawled: DataFrame | None = None, sitemaps: DataFrame | None = None) -> dict[str, str]:
    """Build what a project needs (deps as for dependencies.detect) and the folder lacks; status of each library, or what was wrong with it."""
    need = dependencies.to_extract(dependencies.detect(deps, libraries), library_source.installed(libraries.sparkSession, [folder]))
    out = {}
    for r in need.select("library", "version").distinct().orderBy("library", "version").toLocalIterator():  # a row a library
        try:
            out[f"{r['library']}@{r['version']}"] = extract_from_registry(libraries, r["library"], folder, checkouts, crawled, sitemaps, r["version"])["status"]
        except Exception as e:  # a library that fails stops no other
            out[f"{r['library']}@{r['version']}"] = str(e)
    return out


def ask(spark: SparkSession, roots: list[str], library: str, question: str, version: str | None = None) -> DataFrame:
    """section, place and text that answer a question about an installed library; LookupError where it or the version is not there."""
    base = library_source.find(spark, roots, library, with_meta=False)
    if base is None:
        raise LookupError(f"{library} is not installed")
    have = [r["version"] for r in library_source.installed(spark, [base.rsplit("/", 1)[0]]).where((F.col("library") == library) & F.col("version").isNotNull()).orderBy(F.desc(version_key("version"))).toLocalIterator()]
    wanted = version or (have[0] if have else None)
    if wanted not in have:
        raise LookupError(f"{library} has no version {wanted}; there are {', '.join(have)}")
    nodes, edges, clusters = (spark.read.parquet(f"{base}/{wanted}/{t}") for t in ("nodes", "edges", "clusters"))
    return retrieval.answer(nodes, edges, clusters, question)


def extract_library(pages: DataFrame, library: str, version: str, folder: str, update: bool = False, call: Callable[[str], str] | None = None, latest: str | None = None) -> dict:
    """Build or update a version from pages (page_key, page_ord, content, source_url); returns counts. call answers prompts; without it the deterministic pass stands alone. latest: the library's latest version, this one by default."""
    spark, version_id, base = pages.sparkSession, f"{library}@{version}", f"{folder.rstrip('/')}/{library}/{version}"
    old = {t: _read(spark, f"{base}/{t}") for t in ("manifest", "page_nodes", "page_edges")}
    known = old["manifest"] if update and old["manifest"] is not None else spark.createDataFrame([], "page_key string, sha256 string, node_count long")
    changed = cut_lineage(incremental.with_changes(pages, known).where("changed"))
    gone = cut_lineage(incremental.deleted(known, pages).select("page_key"))
    if update and changed.isEmpty() and gone.isEmpty():
        return {"status": "up_to_date", "pages": 0}
    parsed = cut_lineage(markdown.parsed(changed.select("page_key", "page_ord", "content", "source_url")))
    answers = None
    if call is not None:
        signed = F.transform(F.array_sort(F.collect_list(F.struct("block", "pattern", "start", "kind", "name", "signature"))), lambda s: F.struct(s["kind"].alias("kind"), s["name"].alias("name"), s["signature"].alias("signature")))
        asked = parsed.join(markdown.signatures(parsed).groupBy("page_key").agg(signed.alias("signatures")), "page_key", "left")
        asked = asked.withColumn("signatures", F.coalesce("signatures", F.array().cast("array<struct<kind:string,name:string,signature:string>>")))
        answers = cut_lineage(model_pass.extract(asked, call))
    symbols, guides = page_nodes(parsed, version_id, answers)
    nodes = symbols.unionByName(guides.select("page_key", "id", (F.col("page_ord") * _ORD + _GUIDE).alias("ord"), "node_type", F.col("title").alias("name"), F.lit(None).cast("string").alias("kind"), F.lit(None).cast("string").alias("signature"), F.lit("").alias("description")))
    edges = guides.select("page_key", F.col("page_ord"), F.col("id").alias("source"), F.posexplode("related_symbols").alias("k", "target"))
    edges = edges.select("page_key", "source", "target", (F.col("page_ord") * _ORD + _GUIDE + F.col("k")).alias("ord"), F.lit("REFERENCES").alias("type"), F.lit(None).cast("double").alias("score"))
    if answers is not None:
        said = answers.join(parsed.select("page_key", "page_ord"), "page_key").select("page_key", "page_ord", F.posexplode("relationships").alias("k", "r"))
        edges = edges.unionByName(said.select("page_key", "r.source", "r.target", (F.col("page_ord") * _ORD + _RELATION + F.col("k")).alias("ord"), "r.type", F.col("r.confidence_score").alias("score")))
    touched = changed.select("page_key").unionByName(gone)
    if update and old["page_nodes"] is not None:
        nodes = incremental.replace_pages(old["page_nodes"], nodes, touched)
        edges = incremental.replace_pages(old["page_edges"], edges, touched)
    nodes, edges = cut_lineage(nodes), cut_lineage(edges)
    last = cut_lineage(graph.nodes_last_wins(nodes.drop("page_key")))
    structural = graph.structural_edges(last.withColumn("version_id", F.lit(version_id))).select("source", "target", "ord", "type", F.lit(None).cast("double").alias("score"))
    belongs = spark.createDataFrame([(library, version_id, -1, "HAS_VERSION", None)], "source string, target string, ord long, type string, score double")
    structural = belongs.unionByName(structural)
    resolved = graph.resolve_edges(edges.drop("page_key"), last)
    joined = cut_lineage(graph.edges_last_wins(structural.unionByName(resolved)))
    v = F.lit(version_id).alias("version_id")
    clusters = community.labelled(community.communities(joined.where("type NOT IN ('EXPORTS', 'HAS_GUIDE', 'HAS_VERSION')").select(v, "source", "target")))
    count = nodes.groupBy("page_key").agg(F.count(F.lit(1)).alias("node_count"))
    new = changed.select("page_key", "sha256").join(count, "page_key", "left").withColumn("node_count", F.coalesce("node_count", F.lit(0)))
    manifest = cut_lineage(incremental.upsert(known.join(gone, "page_key", "left_anti"), new))
    for name, df in (("page_nodes", nodes), ("page_edges", edges), ("nodes", last), ("roots", _roots(spark, library, version, latest or version)), ("edges", joined), ("clusters", clusters), ("index", index.grouped(index.flat(last))), ("manifest", manifest)):
        df.write.mode("overwrite").parquet(f"{base}/{name}")  # the manifest last: a run that breaks off is done again
    stats = graph.version_stats(last.select("*", v), joined.select("*", v)).first()
    return {"status": "built", "pages": changed.count(), "nodes": stats["total_nodes"] if stats else 0, "edges": stats["total_edges"] if stats else 0, "symbols": stats["symbols"] if stats else 0, "guides": stats["guides"] if stats else 0}
