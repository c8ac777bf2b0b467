"""Exact top-k search by a vector-approximation file.

Vectors become integers, floor(scale * x), kept as doubles, which hold them exactly. Each component is coded by one of
256 cells; the cells of a dimension are cut at quantiles of a sample of at most MAX_SAMPLE vectors, the outer ones end
at the exact least and greatest values. The file holds a byte for each component beside the exact integers, in columns
that are read apart.

A scan of the bytes alone bounds every inner product from both sides, for blocks of at most QUERY_BLOCK queries at a
time against all rows; a task keeps a row for a query only while its upper bound reaches the k-th best lower bound it has
seen. Blocks of queries are dealt like the file's parts, every block to every part, so they never pass the driver and a
task holds one block and one batch of rows. Then exact vectors are read in the order of the bounds, in growing
rounds, until a query's k-th exact score exceeds every bound that is left. The result is exact whatever the cells are;
they only decide how much is read. The best of a query are found in two steps, first within each of SALT parts of the
rows, so that no query's candidates meet in one task.

Scores are exact whole numbers, and so are ranks: products are summed in 64 bits where no sum can leave them and by
Python's whole numbers otherwise. A score that does not fit the result's 64 bits raises an error when it is read rather
than being cut. Bounds of such vectors are doubles with their rounding added, or infinite.

Shorter vectors count as filled with zeros. Rows without an id, null vectors and vectors with null or non-finite
components take no part; of rows that share a vec_id the greatest vector counts. Fewer than k other rows give fewer
results; without queries or rows the result is empty. Ties go to the smaller vec_id. Extra columns take no part.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import by_hash, keep, remove, ship, shuffle_partitions, table_path
from .vectors import matrix, packed_rows, unpacked, usable, whole_groups

CELLS = 256
MAX_SAMPLE = 20_000
QUERY_BLOCK = 8192
#: Queries and rows that are compared at once.
ASKED, ROWS = 512, 2048
#: Parts that a query's candidates are dealt into before their best are put together.
SALT = 16
#: Rows of the file in one part of the scan.
PART_ROWS = 1 << 16


def integers(e: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * e) as doubles: whole numbers, and exact; beyond the largest double it stays there."""
    with np.errstate(over="ignore"):
        big = np.finfo(np.float64).max
        return np.clip(np.floor(scale * e), -big, big)


def products(a: np.ndarray, b: np.ndarray) -> list[int] | np.ndarray:
    """Exact inner products of the rows of two matrices of whole numbers."""
    with np.errstate(over="ignore"):
        most = (np.abs(a) * np.abs(b)).sum(axis=1)
    out = np.zeros(len(a), object)
    small = (most < 2.0**61) & (np.abs(a).max(axis=1, initial=0) < 2.0**62) & (np.abs(b).max(axis=1, initial=0) < 2.0**62)
    out[small] = (a[small].astype(np.int64) * b[small].astype(np.int64)).sum(axis=1)
    for k in np.flatnonzero(~small):
        out[k] = sum(int(x) * int(y) for x, y in zip(a[k].tolist(), b[k].tolist(), strict=True))
    return out


def cell_edges(sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest value of each cell of each dimension (cells by dimensions)."""
    cuts = np.quantile(sample, np.arange(1, CELLS) / CELLS, axis=0, method="lower") if len(sample) else np.zeros((CELLS - 1, len(low)))
    cuts = np.maximum.accumulate(np.ceil(cuts), axis=0)
    return np.vstack((low, cuts)), np.vstack((cuts, high))  # both ends count to a cell: bounds stay valid for ties


def code(values: np.ndarray, lower: np.ndarray) -> np.ndarray:
    out = np.empty(values.shape, np.uint8)
    for d in range(values.shape[1]):
        out[:, d] = np.searchsorted(lower[1:, d], values[:, d], side="right")
    return out


def build(table: DataFrame, scale: float = 1024.0) -> tuple[DataFrame, int, np.ndarray, np.ndarray]:
    """The file (vec_id, code, exact), its width, and the cells' ends."""
    ship(table.sparkSession)
    rows = keep(usable(table, zero=True), "vectors")
    width = rows.agg(F.max(F.size("e"))).first()[0] or 0
    ranges = rows.select(F.posexplode("e").alias("d", "x")).groupBy("d").agg(F.min("x").alias("low"), F.max("x").alias("high")).toPandas()  # a row a dimension
    low, high = np.zeros(width), np.zeros(width)
    low[ranges["d"].to_numpy(int)], high[ranges["d"].to_numpy(int)] = ranges["low"].to_numpy(float), ranges["high"].to_numpy(float)
    low, high = integers(np.minimum(low, 0), scale), integers(np.maximum(high, 0), scale)
    sample = by_hash(rows, MAX_SAMPLE, rows.count(), "vec_id").select("e").toArrow()["e"].combine_chunks()
    sample = sample.chunk(0) if isinstance(sample, pa.ChunkedArray) and sample.num_chunks else sample
    lower, upper = cell_edges(integers(matrix(sample, width), scale) if len(sample) else np.zeros((0, width)), low, high)
    shared = table.sparkSession.sparkContext.broadcast(lower)

    def part(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                piece = batch.slice(lo, ROWS)
                exact = integers(matrix(piece.column(1), width), scale)
                yield pa.RecordBatch.from_arrays([piece.column(0), packed_rows(code(exact, shared.value)), packed_rows(exact)], names=["vec_id", "code", "exact"])

    return keep(rows.mapInArrow(part, "vec_id long, code binary, exact binary"), "vafile"), width, lower, upper


def scan(file: DataFrame, blocks: DataFrame, width: int, lower: np.ndarray, upper: np.ndarray, k: int) -> DataFrame:
    """(query_id, vec_id, low, high) of the rows that a task could not rule out for a query. blocks: block, ids, exact."""
    spark = file.sparkSession
    shared = spark.sparkContext.broadcast((lower, upper))
    rows = file.count()
    parts = max(1, -(-rows // PART_ROWS), min(shuffle_partitions(spark), rows // ROWS))
    # packed groups of ROWS rows: what is dealt are few fat rows
    packs = file.select("vec_id", "code").mapInArrow(_packs(width), "n int, ids binary, codes binary").withColumn("part", F.pmod(F.xxhash64("ids"), F.lit(parts)).cast("int"))
    places = blocks.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).select("block", "part", F.lit(0).alias("kind"), F.col("n"), F.col("ids"), F.col("exact").alias("data"))
    numbers = blocks.select(F.col("block").alias("b")).agg(F.max("b")).first()[0]
    rows = packs.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(numbers)))).select("block", "part", F.lit(1).alias("kind"), "n", "ids", F.col("codes").alias("data"))
    dealt = places.unionByName(rows).withColumn("place", F.col("block").cast("long") * parts + F.col("part")).repartition("place").sortWithinPartitions("place", "kind").select("place", "kind", "n", "ids", "data")

    def part(batches):
        low, high = shared.value
        dims = np.arange(width)
        now, ids, sides, kth, held = None, None, [], [], []

        def done():
            for number, found in enumerate(held):
                own = ids[number * ASKED :]
                i, rows, least, most = _still(found, kth[number])
                for at in range(0, len(i), 1 << 16):
                    s = slice(at, at + (1 << 16))
                    yield pa.RecordBatch.from_arrays([pa.array(own[i[s]]), pa.array(rows[s]), pa.array(least[s]), pa.array(most[s])], names=["query_id", "vec_id", "low", "high"])

        for batch in batches:
            for r in range(batch.num_rows):
                kind, n, names, data = (batch.column(c)[r].as_py() for c in range(1, 5))
                if kind == 0:
                    if now is not None:
                        yield from done()
                    now, ids = batch.column(0)[r].as_py(), np.frombuffer(names, np.int64)
                    q = np.frombuffer(data, np.float64).reshape(n, width)
                    sides = [(np.maximum(x, 0).T, np.minimum(x, 0).T, np.abs(x).T) for x in (q[at : at + ASKED] for at in range(0, n, ASKED))]
                    kth = [np.full((x[0].shape[1], k), -np.inf) for x in sides]
                    held = [[] for _ in sides]
                    continue
                rows, codes = np.frombuffer(names, np.int64), np.frombuffer(data, np.uint8).reshape(n, width)
                a, b = low[codes, dims], high[codes, dims]
                large = np.maximum(np.abs(a), np.abs(b))
                for number, (plus, minus, size) in enumerate(sides):
                    with np.errstate(over="ignore", invalid="ignore"):
                        most, least = (b @ plus + a @ minus).T, (a @ plus + b @ minus).T
                        # what rounding can take from a sum of so many products, by the sum of their sizes
                        slack = (large @ size).T * ((width + 4) * 2.0**-52)
                        slack[slack < 2.0**-6] = 0  # all sums are whole numbers below 2^46: exact
                        most, least = most + slack, least - slack
                    most[~np.isfinite(most)], least[~np.isfinite(least)] = np.inf, -np.inf
                    own = ids[number * ASKED : number * ASKED + len(most), None] == rows[None, :]
                    most[own], least[own] = -np.inf, -np.inf
                    kth[number] = -np.partition(-np.concatenate((kth[number], least), axis=1), k - 1, axis=1)[:, :k]
                    i, j = np.nonzero((most >= kth[number].min(axis=1)[:, None]) & ~own)
                    held[number].append((i, rows[j], least[i, j], most[i, j]))
                    if sum(len(h[0]) for h in held[number]) > 1 << 17:
                        held[number] = [_still(held[number], kth[number])]
                        if len(held[number][0][0]) > 1 << 16:  # ties: they go on to be dealt, as nothing here can rule them out
                            i, names_, least, most = held[number].pop()
                            yield pa.RecordBatch.from_arrays([pa.array(ids[number * ASKED :][i]), pa.array(names_), pa.array(least), pa.array(most)], names=["query_id", "vec_id", "low", "high"])
        if now is not None:
            yield from done()

    return dealt.mapInArrow(part, "query_id long, vec_id long, low double, high double")


def _packs(width: int):
    def part(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                piece = batch.slice(at, ROWS)
                yield pa.RecordBatch.from_arrays([pa.array([piece.num_rows], pa.int32()), pa.array([piece.column(0).to_numpy().tobytes()], pa.binary()), pa.array([b"".join(piece.column(1).to_pylist())], pa.binary())], names=["n", "ids", "codes"])

    return part


def query_blocks(file: DataFrame, asked: DataFrame, width: int) -> DataFrame | None:
    """block, n, ids and exact of the queries (vec_id): about QUERY_BLOCK in each block."""
    rows = file.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "exact")
    count = rows.count()
    if not count:
        return None
    blocks = -(-count // (QUERY_BLOCK * 3 // 4))

    def part(batches):
        for table in whole_groups(batches):
            block = table["block"].to_numpy()
            edges = np.concatenate((np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1]))), [len(block)]))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                piece = table.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([pa.array([block[lo]], pa.int32()), pa.array([hi - lo], pa.int32()), pa.array([piece["vec_id"].to_numpy().tobytes()], pa.binary()), pa.array([b"".join(piece["exact"].to_pylist())], pa.binary())], names=["block", "n", "ids", "exact"])

    dealt = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "exact").repartition("block").sortWithinPartitions("block")
    return keep(dealt.mapInArrow(part, "block int, n int, ids binary, exact binary"), "queries")


def _still(held: list[tuple], kth: np.ndarray) -> tuple:
    if not held:
        return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0), np.zeros(0)
    i, rows, least, most = (np.concatenate(x) for x in zip(*held, strict=True))
    stays = most >= kth.min(axis=1)[i]
    return i[stays], rows[stays], least[stays], most[stays]


def sort_key(x: int) -> bytes:
    """Bytes that sort as whole numbers of any size do."""
    size = (x.bit_length() + 7) // 8
    raw = b"\x80" + size.to_bytes(2, "big") + abs(x).to_bytes(size, "big")
    return raw if x >= 0 else bytes(255 - b for b in raw)


def _double(x: int) -> float:
    try:
        return float(x)
    except OverflowError:
        return float("inf") if x > 0 else float("-inf")


def _scores(pairs: DataFrame, file: DataFrame, width: int) -> DataFrame:
    """Of pairs the exact score: a key to sort by, the nearest double, and the value where it fits 64 bits."""
    schema = "query_id long, vec_id long, score binary, near double, value long"

    def part(batches):
        for batch in batches:
            a, b = unpacked(batch.column(2), np.float64, width), unpacked(batch.column(3), np.float64, width)
            score = [int(x) for x in products(a, b)]
            values = [x if -(1 << 63) <= x < 1 << 63 else None for x in score]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(map(sort_key, score), pa.binary()), pa.array(map(_double, score), pa.float64()), pa.array(values, pa.int64())], names=[c.split()[0] for c in schema.split(", ")])

    own = file.select(F.col("vec_id").alias("query_id"), F.col("exact").alias("q"))
    return pairs.select("query_id", "vec_id").join(file.select("vec_id", "exact"), "vec_id").join(own, "query_id").select("query_id", "vec_id", "q", "exact").mapInArrow(part, schema)


def first(rows: DataFrame, by: str, k: int, name: str) -> DataFrame:
    """The k first of each query by falling by, then vec_id, with their place as name: in SALT parts, then of these."""
    salt = F.pmod(F.xxhash64("vec_id"), F.lit(SALT))
    order = [F.desc(by), F.asc("vec_id")]
    some = rows.withColumn("_salt", salt).withColumn("_r", F.row_number().over(Window.partitionBy("query_id", "_salt").orderBy(*order))).where(F.col("_r") <= k).drop("_salt", "_r")
    return some.withColumn(name, F.row_number().over(Window.partitionBy("query_id").orderBy(*order))).where(F.col(name) <= k)


def top_k(table: DataFrame, every: int = 100, k: int = 10, scale: float = 1024.0) -> DataFrame:
    """query_id, rank, vec_id and score for the rows whose vec_id is divisible by every, against all others."""
    spark = table.sparkSession
    file, width, lower, upper = build(table, scale)
    blocks = query_blocks(file, file.where(F.col("vec_id") % every == 0), width)
    if blocks is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = keep(scan(file, blocks, width, lower, upper, k), "bounds")
    bar = first(found.select("query_id", "low", "vec_id"), "low", k, "r").where(F.col("r") == k).select("query_id", F.col("low").alias("bar"))
    left = keep(found.join(bar, "query_id", "left").where("bar IS NULL OR high >= bar").select("query_id", "vec_id", "high"), "candidates")
    exact, size = None, 2 * k
    while True:
        todo = left
        if exact is not None:
            done = exact.where(F.col("rank") == k).select("query_id", F.col("near").alias("kth"))
            # what was read before lies above the least bound that was read, or shares it and has a smaller id
            todo = left.join(done, "query_id", "left").where("kth IS NULL OR high >= kth").drop("kth").join(read, "query_id", "left").where("at IS NULL OR high < at OR (high = at AND vec_id > upto)").drop("at", "upto")
        todo = keep(first(todo, "high", size, "place"), "todo")
        if todo.isEmpty():
            break
        now = todo.groupBy("query_id").agg(F.max(F.struct("place", "high", "vec_id")).alias("z")).select("query_id", F.col("z.high").alias("at"), F.col("z.vec_id").alias("upto"))
        read = keep(now if exact is None else read.join(now.select("query_id"), "query_id", "left_anti").unionByName(now), "read")
        scored = _scores(todo, file, width)
        if exact is not None:
            scored = scored.unionByName(exact.drop("rank"))
        new = keep(first(scored, "score", k, "rank"), "exact")
        if exact is not None:
            remove(spark, table_path(exact)) if exact.inputFiles() else None
        exact, size = new, size * 4
    failure = F.raise_error(F.concat(F.lit("the score of "), "query_id", F.lit(" and "), "vec_id", F.lit(" does not fit 64 bits"))).cast("long")
    return exact.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.coalesce("value", failure).alias("score"))
