"""Libraries on disk: which source a registry row names, what is installed where, prebuilt graphs, meta rows.

A root holds a folder for each library, which holds meta.json and a folder for each version. All folders are reached through
Spark's file systems, so a root may be local or remote.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions.text import version_key

from . import files, html


class Folder:
    """The few file operations that are needed, by Spark's own file systems."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _at(self, name: str = ""):
        where = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where, where.getFileSystem(self._conf)

    def exists(self, name: str = "") -> bool:
        where, fs = self._at(name)
        return fs.exists(where)

    def folders(self, name: str = "") -> list[str]:
        where, fs = self._at(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()) if fs.exists(where) else []

    def remove(self, name: str = "") -> None:
        where, fs = self._at(name)
        fs.delete(where, True)

    def copy_from(self, other: Folder, name: str, to: str | None = None) -> None:
        (a, fa), (b, fb) = other._at(name), self._at(to or name)
        fb.mkdirs(b.getParent())
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(fa, a, fb, b, False, self._conf)


def fetch(source, checkouts: str, crawled: DataFrame | None = None, sitemaps: DataFrame | None = None, spark: SparkSession | None = None) -> DataFrame:
    """page_key, page_ord, content, source_url and file_type of a library's documentation, by the type of its docs_config.

    source: a row of the registry. Repositories are folders under checkouts; of HTML sites, crawled has (url, html) and
    sitemaps (xml). Restructured text goes through the same parser as Markdown. Other types raise ValueError.
    """
    config = source["docs_config"]
    kind = config["type"]
    if kind in ("github_markdown", "github_rst"):
        root = f"{checkouts.rstrip('/')}/{config['repo']}"
        pages = files.doc_files(spark, root, [config["docs_path"] or "", *(config["extra_paths"] or [])])
    elif kind == "html":
        urls = html.sitemap_urls(sitemaps, config["base_url"])
        pages = html.pages_from_html(crawled.join(urls, "url", "left_semi")).select("page_key", "content", "source_url", "file_type")
    else:
        raise ValueError(f"unknown source type: {kind}")
    # one library's pages: a sort of a few thousand keys
    return pages.withColumn("page_ord", F.row_number().over(Window.orderBy("page_key", "source_url")).cast("long"))


def fetch_all(libraries: DataFrame, checkouts: str, crawled: DataFrame | None = None, sitemaps: DataFrame | None = None) -> tuple[dict[str, DataFrame], dict[str, str]]:
    """The pages of every library that can be fetched, and what was wrong with the others: a bad one stops no other."""
    good, bad = {}, {}
    for row in libraries.orderBy("id").toLocalIterator():  # a row a library of the registry
        try:
            good[row["id"]] = fetch(row, checkouts, crawled, sitemaps, libraries.sparkSession)
        except Exception as e:  # a failure is data here
            bad[row["id"]] = str(e)
    return good, bad


def installed(spark: SparkSession, roots: list[str]) -> DataFrame:
    """library and version of everything under the roots; libraries without versions have a null."""
    rows = []
    for root in roots:
        folder = Folder(spark, root)
        for library in (x for x in folder.folders() if not x.startswith("_")):
            rows += [(library, v) for v in folder.folders(library) if v != "meta.json"] or [(library, None)]
    return spark.createDataFrame(sorted(set(rows), key=str), "library string, version string")


def find(spark: SparkSession, roots: list[str], library: str, with_meta: bool = True) -> str | None:
    """The first root's folder of a library; with_meta: only folders with a meta.json count."""
    for root in roots:
        folder = Folder(spark, root)
        if folder.exists(f"{library}/meta.json" if with_meta else library):
            return f"{folder.path}/{library}"
    return None


def write_meta(libraries: DataFrame, library: str, root: str, version: str | None = None) -> None:
    """The registry's row as the library's meta.json."""
    row = libraries.where(F.col("id") == library)
    row = row.withColumn("latest_version", F.coalesce(F.lit(version), F.col("latest_version"))) if version else row
    row.coalesce(1).write.mode("overwrite").json(f"{root.rstrip('/')}/{library}/meta.json")


def info(libraries: DataFrame, extracted: DataFrame) -> DataFrame:
    """The registry's rows with the versions that are extracted (library, version), newest first by number."""
    have = extracted.where("version IS NOT NULL").distinct().groupBy(F.col("library").alias("id"))
    have = have.agg(F.transform(F.sort_array(F.collect_list(F.struct(version_key("version").alias("k"), "version")), asc=False), lambda x: x["version"]).alias("extracted"))
    return libraries.join(have, "id", "left").withColumn("extracted", F.coalesce("extracted", F.array().cast("array<string>")))


def load_prebuilt(spark: SparkSession, archive: str, cache: str, library: str, version: str, libraries: DataFrame | None = None) -> bool:
    """Copy a prebuilt version into the cache unless it is there; False, and nothing left behind, where there is none or it fails.

    A meta.json is made only where the library has none.
    """
    source, target, name = Folder(spark, archive), Folder(spark, cache), f"{library}/{version}"
    if target.exists(name):
        return True
    if not source.exists(name):
        return False
    try:
        target.copy_from(source, name)
        if not target.exists(f"{library}/meta.json"):
            known = libraries.where(F.col("id") == library).select("id", "name") if libraries is not None else spark.createDataFrame([], "id string, name string")
            one = spark.createDataFrame([(library, version)], "id string, latest_version string").join(known, "id", "left")
            one.select("id", F.coalesce("name", "id").alias("name"), "latest_version").coalesce(1).write.json(f"{target.path}/{library}/meta.json")
    except Exception:  # whatever failed, a half copy must not count as installed
        target.remove(name)
        return False
    return True


def migrate(spark: SparkSession, old: str, new: str, marker: str = "_migrated") -> list[str]:
    """Copy the libraries of an old root that the new one lacks, once; the names copied."""
    source, target = Folder(spark, old), Folder(spark, new)
    if target.exists(marker) or not source.folders():  # the marker is a folder of its own, which installed() passes over
        return []
    done = []
    for library in source.folders():
        if not target.exists(library):
            target.copy_from(source, library)
            done.append(library)
    spark.createDataFrame([(x,) for x in done], "library string").coalesce(1).write.mode("overwrite").json(f"{target.path}/{marker}")
    return done


@dataclass
class Tables:
    """Tables by path, read once a session and given back as they were; forget() reads them anew."""

    spark: SparkSession

    def __post_init__(self):
        self._known: dict[str, DataFrame | None] = {}

    def get(self, path: str) -> DataFrame | None:
        if path not in self._known:
            self._known[path] = self.spark.read.parquet(path).cache() if Folder(self.spark, path).exists() else None
        return self._known[path]

    def forget(self, path: str) -> None:
        if (df := self._known.pop(path, None)) is not None:
            df.unpersist()
