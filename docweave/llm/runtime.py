"""What the operators share: code on the executors, and tables in the folder all machines see."""

from __future__ import annotations

import contextlib
import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"
_SHIPPED: set[str] = set()
_TABLES: list[str] = []


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once an application, and bound the batches that move to and from Python.

    The bound is a setting of the session and stays; a smaller one of the user's holds.
    """
    if int(spark.conf.get(_BATCH).rstrip("bB")) > BATCH_BYTES:
        spark.conf.set(_BATCH, f"{BATCH_BYTES}b")
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, f"{top.name}/{p.relative_to(top)}")
    folder = tempfile.mkdtemp(prefix="docweave-")
    path = os.path.join(folder, "docweave_code.zip")
    Path(path).write_bytes(data.getvalue())
    spark.sparkContext.addPyFile(os.path.abspath(path))
    _SHIPPED.add(app)


def shared_root(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where none is set (local runs, tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = tempfile.mkdtemp(prefix="docweave-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder, remembered for made()."""
    path = f"{shared_root(spark)}/docweave/{name}-{uuid.uuid4().hex}"
    _TABLES.append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in _TABLES:
        _TABLES.remove(path)


def made() -> list[str]:
    """The folders that operators of this process have made and not removed."""
    return list(_TABLES)


def keep(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and any executor can be lost."""
    path = new_folder(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def by_hash(df: DataFrame, most: int, rows: int, key: str) -> DataFrame:
    """most rows picked by hash of key, or all if there are fewer; rows: about how many there are.

    Of a large table only rows whose hash is small are looked at, about 2 * most + 64 of them at any size, so that no
    task sorts or receives more. Where those are fewer than most (rows was too large a guess), the bound is widened.
    """
    h = F.xxhash64(key)
    if rows > 4 * most + 64:
        near = F.shiftrightunsigned(h, 33)
        bound = max(1, 2**31 * (2 * most + 64) // rows)
        while bound < 2**31 and df.where(near < bound).select(key).limit(most).count() < most:
            bound *= 4
        df = df.where(near < bound) if bound < 2**31 else df
    return df.orderBy(h, key).limit(most)


def packed(df: DataFrame, *names: str) -> DataFrame:
    """The named columns and the whole row as _row, so that no other column's name can clash."""
    return df.select(*names, F.struct(*[df[c] for c in df.columns]).alias("_row"))


def table_path(df: DataFrame) -> str:
    """The folder of a table that keep() returned."""
    return df.inputFiles()[0].rsplit("/", 1)[0]


def trim() -> None:
    """Give a Python worker's free memory back to the system, as it may wait beside others for its next task."""
    import ctypes

    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def input_partitions(df: DataFrame) -> int:
    """Tasks that a scan of df takes: a measure of its size that needs no job."""
    return max(1, df._jdf.queryExecution().toRdd().getNumPartitions())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
