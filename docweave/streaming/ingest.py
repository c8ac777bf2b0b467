"""Incremental ingest of pages as a stream: each batch is hashed against the manifest and only changed pages go on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.operators.incremental import with_changes

MANIFEST = "page_key string, sha256 string, batch long"


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_manifest(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """The latest entry of each page, by the batches before a number or all; empty where nothing was written yet.

    Batches up to the last compaction are read from its one table; a partial aggregate, no sort, finds the latest entry.
    """
    where, fs = _folder(spark, path)
    if not fs.exists(where):
        return spark.createDataFrame([], MANIFEST)
    names = [s.getPath().getName() for s in fs.listStatus(where) if s.isDirectory()]
    whole = [n for n in (int(x.split("=")[1]) for x in names if x.startswith("upto=")) if before is None or n < before]
    start = max(whole, default=-1)
    recent = [n for n in (int(x.split("=")[1]) for x in names if x.startswith("batch=")) if n > start and (before is None or n < before)]
    schema = "page_key string, sha256 string"
    parts = [spark.read.schema(MANIFEST).parquet(f"{path}/upto={start}")] if whole else []
    # batches are few: compaction bounds them
    parts += [spark.read.schema(schema).parquet(f"{path}/batch={n}").withColumn("batch", F.lit(n).cast("long")) for n in sorted(recent)]
    every = spark.createDataFrame([], MANIFEST)
    for p in parts:
        every = every.unionByName(p)
    return every.groupBy("page_key").agg(F.max_by("sha256", "batch").alias("sha256"), F.max("batch").alias("batch"))


def compact(spark: SparkSession, path: str, number: int) -> None:
    """Write the entries up to a batch as one table and drop what it replaces; a compaction that breaks off is done again."""
    target = f"{path}/upto={number}"
    read_manifest(spark, path, number + 1).write.mode("overwrite").parquet(f"{path}/_new")
    (a, fs), (b, _) = _folder(spark, f"{path}/_new"), _folder(spark, target)
    fs.delete(b, True)
    fs.rename(a, b)
    where, _ = _folder(spark, path)
    for s in fs.listStatus(where):
        kind, _, n = s.getPath().getName().partition("=")
        if n and (kind == "batch" and int(n) <= number or kind == "upto" and int(n) < number):
            fs.delete(s.getPath(), True)


def ingest(pages: DataFrame, manifest: str, sink: str, checkpoint: str, every: int = 20):
    """Start a query over a streaming DataFrame of (page_key, content) that ends when all there is has been read.

    Of a page that a batch holds more than once the one with the latest modified (a timestamp, if pages has it) counts, and of
    equal ones the greatest text. What the manifest knows is dropped, the rest goes to sink and then to the manifest, both
    in a folder of the batch's number, so that a batch that is run again replaces what it wrote. The manifest is compacted
    after every so many batches, up to the batch before, so that reading it does not grow with their number.
    """

    def batch(df: DataFrame, number: int) -> None:
        spark = df.sparkSession
        when = F.col("modified") if "modified" in df.columns else F.lit(0)
        once = df.groupBy("page_key").agg(F.max(F.struct(when.alias("m"), F.coalesce("content", F.lit("")).alias("content"))).alias("z")).select("page_key", F.col("z.content").alias("content"))
        known = read_manifest(spark, manifest, number)
        changed = with_changes(once, known).where("changed").select("page_key", "content", "sha256").persist()
        try:
            changed.write.mode("overwrite").parquet(f"{sink}/batch={number}")
            changed.select("page_key", "sha256").write.mode("overwrite").parquet(f"{manifest}/batch={number}")
        finally:
            changed.unpersist()
        if number and number % every == 0:
            compact(spark, manifest, number - 1)

    return pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Events by type and window under a watermark (beyond what documents need)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
