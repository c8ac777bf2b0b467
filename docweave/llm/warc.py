"""Deterministic sharded WARC writer and its reader.

Records are range-sorted by id over contiguous shards. A shard ends where the running sum of payload bytes, in order
of the ids, passes a multiple of the shard size, so it holds at most that and the records of one more id, whatever the
corpus or the gaps in the ids, and the same rows give the same files, byte for byte. A task writes its shards (one, up
to TASKS shards) as gzip members, one a record, and starts a new file when the compressed size reaches the limit.
Headers and digests are made anew from the payload. Files get temporary names first and are renamed when complete; the manifest, written
last and likewise, names the files that count with their sizes and hashes, so leftovers of lost tasks are never read.

Of records with equal payloads of at least the given size the one with the least page_id is a response and the
others are revisits that refer to it. Only ids and digests are shuffled to find them; then every payload moves once, to
its shard, along with the few rows that say which of its records are revisits. Reading streams one member at a time
and checks digests.

Null payloads are empty; empty payloads follow the same rule. Rows that repeat a page_id are written one after
another, by url and payload; of equal payloads the first is the response. Rows without an id are written last, dealt
over shards by their digest, and never are what a revisit refers to, unless all have none. An empty table gives a manifest without files. Extra columns
take no part, whatever their names.

The folder may be of any file system that pyarrow opens by its URI (file, hdfs, s3, gs) and must be one that all
machines share.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .runtime import keep, ship, shuffle_partitions

#: Payload bytes a shard aims at, and compressed bytes at which a file is closed.
SHARD_BYTES = 32 << 20
FILE_BYTES = 16 << 20
#: Tasks that write; beyond so many shards a task writes several, one after another.
TASKS = 20_000
#: Shards whose first ids are broadcast, 8 bytes each (32 MB; 128 TB of payload); beyond, ids are joined with their shards.
MOST_BOUNDS = 1 << 22
SALT = 16
DATE = "2000-01-01T00:00:00Z"


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    fs, path = pafs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")
    return fs, path.rstrip("/")


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record as bytes; its id is made from the content, so it is the same on every run."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id}|{url}|{digest}")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To-Page-ID: {'' if refers_to is None else refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8", "replace") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _clean(url: str | None) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")


class _Roller:
    """Files of one shard."""

    def __init__(self, fs: pafs.FileSystem, folder: str, shard: int, limit: int):
        self.fs, self.folder, self.shard, self.limit = fs, folder, shard, limit
        self.part, self.out = 0, None
        self.closed: list[tuple] = []

    def write(self, data: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.folder}/_temporary-{uuid.uuid4().hex}"
            self.out, self.size, self.records, self.sum = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha256()
        packed = gzip.compress(data, 6, mtime=0)
        self.out.write(packed)
        self.sum.update(packed)
        self.size += len(packed)
        self.records += 1
        if self.size >= self.limit:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        name = f"part-{self.shard:08d}-{self.part:05d}.warc.gz"
        self.fs.move(self.temporary, f"{self.folder}/{name}")
        self.closed.append((self.shard, self.part, name, self.records, self.size, self.sum.hexdigest()))
        self.part += 1


def numbered(sizes: DataFrame, shard_bytes: int) -> DataFrame:
    """(page_id, shard) of every id that is not null: shards by the running sum of bytes before it. sizes: page_id and bytes."""
    spark = sizes.sparkSession
    ids = sizes.where("page_id IS NOT NULL").groupBy("page_id").agg(F.sum("bytes").alias("bytes"))

    def run(batches):
        own, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.column(1).to_numpy()
            before = total + np.cumsum(n) - n
            total += int(n.sum())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(n), own, np.int32)), pa.array(before), batch.column(1)], names=["page_id", "part", "before", "bytes"])

    # where the ranges are cut depends on a sample; the sums over all of them do not
    ranged = keep(ids.repartitionByRange(shuffle_partitions(spark), "page_id").sortWithinPartitions("page_id").mapInArrow(run, "page_id long, part int, before long, bytes long"), "sizes")
    totals = ranged.groupBy("part").agg(F.min("page_id").alias("first"), F.sum("bytes").alias("n")).orderBy("first").collect()  # a row a partition
    offsets, at = [], 0
    for r in totals:
        offsets.append((r["part"], at))
        at += r["n"]
    of = spark.createDataFrame(offsets, "part int, offset long")
    return ranged.join(F.broadcast(of), "part").select("page_id", F.floor((F.col("offset") + F.col("before")) / F.lit(shard_bytes)).cast("long").alias("shard"))


def dealt(rows: DataFrame, sizes: DataFrame, shard_bytes: int, most_bounds: int = MOST_BOUNDS) -> tuple[DataFrame, int]:
    """rows with their shard, numbered from 0 without gaps (null for rows without an id), and how many shards there are."""
    spark = rows.sparkSession
    ids = numbered(sizes, shard_bytes)
    firsts = keep(ids.groupBy("shard").agg(F.min("page_id").alias("first")), "shards")
    count = firsts.count()
    if count <= most_bounds:
        bounds = spark.sparkContext.broadcast(np.sort(firsts.select("first").toArrow()["first"].to_numpy()))

        @F.pandas_udf("int")
        def shard(page_id: pd.Series) -> pd.Series:
            return pd.Series((np.searchsorted(bounds.value, page_id.to_numpy(), side="right") - 1).astype(np.int32))

        # no nulls on the way, which would make doubles of the ids
        return rows.withColumn("shard", F.when(F.col("page_id").isNotNull(), shard(F.coalesce("page_id", F.lit(0).cast("long"))))), count
    dense = firsts.withColumn("part", F.floor(F.col("shard") / 1024)).groupBy("part").count().collect()  # a row for 1,024 shards
    before, at = [], 0
    for r in sorted(dense, key=lambda r: r["part"]):
        before.append((r["part"], at))
        at += r["count"]
    place = F.count(F.lit(1)).over(Window.partitionBy("part").orderBy("shard")) - 1
    dense = firsts.withColumn("part", F.floor(F.col("shard") / 1024)).withColumn("place", place).join(spark.createDataFrame(before, "part long, offset long"), "part").select("shard", (F.col("offset") + F.col("place")).cast("int").alias("number"))
    known = ids.join(dense, "shard").select("page_id", "number")
    return rows.join(known, "page_id", "left").withColumnRenamed("number", "shard"), count


def revisits(pages: DataFrame, least: int) -> DataFrame:
    """(page_id, digest, first) of the payloads of at least least bytes that occur more than once."""
    slim = pages.where(F.col("bytes") >= least).select("page_id", "digest")
    first = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    first = first.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return slim.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALT)).cast("int")).join(first, ["digest", "salt"]).select("page_id", "digest", "first").distinct()


def write(pages: DataFrame, folder: str, least: int = 0, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, most_bounds: int = MOST_BOUNDS) -> list[dict]:
    """Write pages (page_id, url, html) under folder and return the manifest's entries."""
    spark = pages.sparkSession
    ship(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    slim = keep(rows.select("page_id", F.octet_length("payload").cast("long").alias("bytes"), F.unhex(F.sha1("payload")).alias("digest")), "digests")
    known = revisits(slim, least).select("page_id", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("url"), F.col("digest").alias("payload"), "first")
    both = rows.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.lit(None).cast("long").alias("first")).unionByName(known)
    both, shards = dealt(both, slim.select("page_id", "bytes"), shard_bytes, most_bounds)
    # rows without an id have no order: equal payloads go together, by their digest
    unnamed = slim.where("page_id IS NULL").agg(F.sum("bytes"), F.count(F.lit(1))).first()
    more = -(-unnamed[0] // shard_bytes) or 1 if unnamed[1] else 0
    if more:
        sha = F.when(F.col("kind") == 0, F.col("payload")).otherwise(F.unhex(F.sha1("payload")))
        both = both.withColumn("shard", F.coalesce("shard", (F.pmod(F.xxhash64(sha), F.lit(more)) + shards).cast("int")))
    shards = max(1, shards + more)
    each = -(-shards // TASKS)
    placed = both.withColumn("task", F.floor(F.col("shard") / each).cast("int")).repartitionById(-(-shards // each), "task")
    placed = placed.sortWithinPartitions("shard", F.col("page_id").asc_nulls_last(), "kind", "url", "payload").select("shard", "page_id", "kind", "url", "payload", "first")
    schema = "shard int, part int, name string, records long, bytes long, sha256 string"

    def part(batches):
        fs, path = _open(folder)
        fs.create_dir(path, recursive=True)
        roller, now, first, done = None, object(), {}, set()
        for batch in batches:
            for k in range(batch.num_rows):
                number, page_id, kind, url, data, refers = (batch.column(c)[k].as_py() for c in range(6))
                if roller is None or roller.shard != number:
                    if roller:
                        roller.close()
                        yield from _entries(roller)
                    roller, now = _Roller(fs, path, number, file_bytes), object()
                if page_id != now:
                    now, first, done = page_id, {}, set()
                if not kind:
                    first[data] = refers
                    continue
                sha = hashlib.sha1(data).digest()
                revisit = sha in first and (first[sha] != page_id or sha in done)
                done.add(sha)
                roller.write(record(page_id, _clean(url), data, base64.b32encode(sha).decode(), first.get(sha), revisit))
        if roller:
            roller.close()
            yield from _entries(roller)

    def _entries(roller: _Roller):
        if roller.closed:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*roller.closed, strict=True), (pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["shard", "part", "name", "records", "bytes", "sha256"])

    # a row for each file; sorted here, since a sort in Spark would run the writer twice to sample its rows
    entries = sorted((r.asDict() for r in placed.mapInArrow(part, schema).collect()), key=lambda e: (e["shard"], e["part"]))
    fs, path = _open(folder)
    fs.create_dir(path, recursive=True)
    temporary = f"{path}/_temporary-{uuid.uuid4().hex}"
    with fs.open_output_stream(temporary) as out:
        out.write(json.dumps({"format": "WARC/1.1", "files": entries}, indent=1).encode())
    fs.move(temporary, f"{path}/manifest.json")
    return entries


def manifest(folder: str) -> list[dict]:
    fs, path = _open(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        return json.loads(f.read())["files"]


def members(stream, size: int = 1 << 20):
    """The decompressed members of a gzip stream, one after another."""
    rest = b""
    while True:
        rest = rest or stream.read(size)
        if not rest:
            return
        unpack, out = zlib.decompressobj(31), []
        while not unpack.eof:
            if not rest and not (rest := stream.read(size)):
                raise ValueError("a member is cut short")
            out.append(unpack.decompress(rest))
            rest = unpack.unused_data if unpack.eof else b""
        yield b"".join(out)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of one record; wrong lengths and digests raise."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != f"sha1:{digest32(block)}":
        raise ValueError(f"record {fields.get('WARC-Record-ID')} is damaged")
    return fields, block


def read(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, payload (null for revisits), payload_bytes, payload_digest, record_type, refers_to of all records."""
    ship(spark)
    schema = "page_id long, url string, payload binary, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = [e["name"] for e in manifest(folder)]
    types = [pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def part(batches):
        fs, path = _open(folder)
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=[c.split()[0] for c in schema.split(", ")])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{path}/{name}", compression=None) as f:
                    for data in members(f):
                        fields, block = parse(data)
                        http, _, payload = block.partition(b"\r\n\r\n")
                        revisit = fields["WARC-Type"] == "revisit"
                        size = int(http.rsplit(b"Content-Length: ", 1)[1])
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        if not revisit and (len(payload) != size or digest32(payload) != digest):
                            raise ValueError(f"payload of page {fields['WARC-Page-ID']} is damaged")
                        number = lambda x: int(x) if x else None
                        rows.append((number(fields["WARC-Page-ID"]), fields["WARC-Target-URI"], None if revisit else payload, size, digest, fields["WARC-Type"], number(fields.get("WARC-Refers-To-Page-ID", ""))))
                        held += len(data)
                        if held > 4 << 20:
                            yield pack(rows)
                            rows, held = [], 0
                if rows:
                    yield pack(rows)

    files = spark.createDataFrame(list(enumerate(names)), "k int, name string").repartitionById(max(1, len(names)), "k").select("name")
    return files.mapInArrow(part, schema)


def round_trip(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write, read back and return what each record says of its page."""
    write(pages, folder, least)
    return read(pages.sparkSession, folder).drop("payload", "url")
