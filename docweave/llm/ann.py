"""Approximate nearest neighbours by inner product: an NN-descent graph and greedy search on it.

Vectors get one more component that makes all norms equal, so that near vectors of the graph are those of large
inner product; the graph works on byte-quantised vectors, each with its own scale, results on the original ones in
double precision. The HEADS longest vectors are also compared with every query, as few links lead to them.

The graph starts rough: every row goes to its SPREAD nearest of at most MAX_PIVOTS pivots (a bounded sample, one for about
PIVOT_ROWS rows), a cell of more than CELL rows is dealt into blocks by hash, and each block gives its rows their nearest
within. What makes it good is NN-descent: every node joins JOIN of its neighbours and of those whose neighbour it is, new
links before old ones, each pair of them with a new link is compared, and the better candidates (at most SEND a node
and join) go back to their nodes. A link is new until it was joined once. Rounds end when fewer than CHANGE of the
links are new. In-degrees are cut only for comparing, as the method has it; every row is indexed.

A search starts at the query's own node and repeatedly opens the best unopened nodes of its beam, all queries at once, until
every query has opened the FRONT best that it knows: a join of opened nodes with the adjacency table, which is bucketed
by node and so never moves again.

Null, zero and non-finite vectors take no part; of rows that share a vec_id the greatest vector counts; shorter vectors
count as filled with zeros. Fewer than k others give fewer results. Ties go to the smaller vec_id. Without queries or
rows the result is empty. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .runtime import by_hash, keep, new_folder, remove, ship, shuffle_partitions, table_path
from .vectors import best, lists, matrix, packed_rows, unpacked, usable, whole_groups

NEIGHBOURS = 32
JOIN, SEND = 24, 24
PIVOT_ROWS = 256
MAX_PIVOTS = 4096
SPREAD = 3
CELL = 512
#: Share of links that must change for another round of descent.
CHANGE = 0.02
BEAM, OPEN, FRONT = 256, 128, 224
_ROWS = 512
#: Longest vectors that every query is compared with.
HEADS = 256
#: Bytes after the components of x.
TAIL = 8


def _norms(rows: DataFrame, width: int) -> DataFrame:
    """vec_id and norm of every row."""

    def part(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                e = matrix(batch.column(1).slice(lo, 2048), width)
                large = np.abs(e).max(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, 2048), pa.array((large * np.sqrt(((e / large) ** 2).sum(axis=1, keepdims=True)))[:, 0])], names=["vec_id", "norm"])

    return rows.select("vec_id", "e").mapInArrow(part, "vec_id long, norm double")


def _heads(rows: DataFrame, width: int, most: int) -> DataFrame:
    """vec_id and norm of the longest rows."""
    return _norms(rows, width).orderBy(F.desc("norm"), "vec_id").limit(most)


def quantise(table: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, x, e): packed for the graph (see decoded), and the original; and the components of x.

    Bytes have a scale a vector. The sphere is that of the largest norm after the HEADS largest, which are shortened
    to it for the graph: a few long vectors change nothing for the others.
    """
    ship(table.sparkSession)
    rows = keep(usable(table, zero=False), "vectors")
    width = rows.agg(F.max(F.size("e"))).first()[0] or 0
    radius = min((r["norm"] for r in _heads(rows, width, HEADS + 1).collect()), default=1.0)

    def part(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                piece = batch.slice(lo, 2048)
                e = matrix(piece.column(1), width)
                large = np.abs(e).max(axis=1, keepdims=True)
                e /= large
                length = np.sqrt((e * e).sum(axis=1, keepdims=True))
                short = np.minimum(1.0, large * length / radius)
                fill = short**2 / (1.0 + np.sqrt(1.0 - short**2))  # 1 - the extra component, exact where that is near 1
                tail = np.concatenate((short / length / 127, fill), axis=1).astype(np.float32)
                x = np.concatenate((np.rint(e * 127).astype(np.int8).view(np.uint8), tail.view(np.uint8)), axis=1)
                yield pa.RecordBatch.from_arrays([piece.column(0), packed_rows(x), piece.column(1)], names=["vec_id", "x", "e"])

    return keep(rows.mapInArrow(part, "vec_id long, x binary, e array<double>"), "quantised"), width


def decoded(raw: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Components, and what the extra component lacks to 1, of rows of width bytes, a scale and that."""
    tail = np.ascontiguousarray(raw[:, width:]).view(np.float32)
    return raw[:, :width].view(np.int8).astype(np.float32) * tail[:, :1], tail[:, 1]


def _rows_of(values: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    return decoded(unpacked(values, np.uint8, width + TAIL), width)


def _scores(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Inner products less 1, extra components included: less 1, so that short vectors keep their differences."""
    return a[0] @ b[0].T - (a[1][:, None] + b[1] - a[1][:, None] * b[1])


def _merged(rows: DataFrame, most: int) -> DataFrame:
    """(u, v, s, fresh) of lists per node from rows of lists for the same nodes: the best most of each. A link that is old in any row is not fresh."""
    schema = "u long, v array<long>, s array<float>, fresh array<boolean>"

    def part(batches):
        for table in whole_groups(batches):
            v, s, old = (table[c].combine_chunks() for c in ("v", "s", "old"))
            v, s, old = ((c.chunk(0) if isinstance(c, pa.ChunkedArray) else c) for c in (v, s, old))
            owner = np.repeat(table["u"].to_numpy(), np.diff(v.offsets.to_numpy()))
            extra = old.flatten().to_numpy(zero_copy_only=False).astype(np.int8)
            owner, v, s, extra = best(owner, v.flatten().to_numpy(), s.flatten().to_numpy(), most, extra)
            nodes, count = np.unique(owner, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), lists(count, pa.array(v)), lists(count, pa.array(s.astype(np.float32))), lists(count, pa.array(extra == 0))], names=["u", "v", "s", "fresh"])

    return rows.select("u", "v", "s", "old").repartition("u").sortWithinPartitions("u").mapInArrow(part, schema)


def _nearest(ids: np.ndarray, x: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row its nearest others: counts, ids, scores."""
    k = min(most, len(ids) - 1)
    out_v, out_s = [], []
    for lo in range(0, len(ids), _ROWS):
        s = _scores((x[0][lo : lo + _ROWS], x[1][lo : lo + _ROWS]), x)
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -np.inf
        top = np.argpartition(-s, k - 1, axis=1)[:, :k]
        out_v.append(ids[top])
        out_s.append(np.take_along_axis(s, top, axis=1))
    return np.full(len(ids), k), np.concatenate(out_v).reshape(-1), np.concatenate(out_s).reshape(-1)


def start(vectors: DataFrame, width: int, neighbours: int = NEIGHBOURS) -> DataFrame:
    """First lists (u, v, s, fresh) from cells."""
    spark = vectors.sparkSession
    rows = vectors.count()
    pivots = min(MAX_PIVOTS, rows // PIVOT_ROWS)
    if pivots:
        chosen = by_hash(vectors.select("vec_id", "x"), pivots, rows, "vec_id").toArrow()
        shared = spark.sparkContext.broadcast(_rows_of(chosen["x"], width))

    def cells(batches):
        centre = shared.value
        spread = min(SPREAD, len(centre[1]))
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                piece = batch.slice(lo, 2048)
                near = _scores(_rows_of(piece.column(1), width), centre)
                near = np.argpartition(-near, spread - 1, axis=1)[:, :spread].astype(np.int32)
                yield pa.RecordBatch.from_arrays([piece.column(0), lists(np.full(len(near), spread), pa.array(near.reshape(-1))), piece.column(1)], names=["vec_id", "cells", "x"])

    rows_x = vectors.select("vec_id", "x")
    if pivots:
        placed = rows_x.mapInArrow(cells, "vec_id long, cells array<int>, x binary").select("vec_id", F.explode("cells").alias("cell"), "x")
    else:
        placed = rows_x.select("vec_id", F.lit(0).alias("cell"), "x")
    sizes = placed.groupBy("cell").count().collect()  # a row a pivot
    blocks = np.ones(max(1, pivots), np.int64)
    for r in sizes:
        blocks[r["cell"]] = -(-r["count"] // CELL)
    first = np.concatenate(([0], np.cumsum(blocks)[:-1]))
    of = spark.createDataFrame([(int(c), int(f), int(b)) for c, (f, b) in enumerate(zip(first, blocks, strict=True))], "cell int, first long, blocks long")
    dealt = placed.join(F.broadcast(of), "cell").select((F.col("first") + F.pmod(F.xxhash64("vec_id", "cell"), F.col("blocks"))).alias("key"), "vec_id", "x")

    def near(batches):
        for table in whole_groups(batches):
            keys = table["key"].to_numpy()
            ids, data = table["vec_id"].to_numpy(), table["x"]
            edges = np.concatenate((np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))), [len(keys)]))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                if b - a < 2:
                    continue
                count, v, s = _nearest(ids[a:b], _rows_of(data.slice(a, b - a), width), neighbours)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b]), lists(count, pa.array(v)), lists(count, pa.array(s)), lists(count, pa.array(np.zeros(len(v), bool)))], names=["u", "v", "s", "old"])

    found = dealt.repartition("key").sortWithinPartitions("key").mapInArrow(near, "u long, v array<long>, s array<float>, old array<boolean>")
    return keep(_merged(found, neighbours), "graph")


def _sides(graph: DataFrame, most: int) -> DataFrame:
    """(centre, member, fresh): most of each node's neighbours, and at most most of the nodes whose neighbour it is; fresh links first."""
    links = F.arrays_zip(F.col("v").alias("member"), F.col("fresh").alias("fresh"))
    some = F.slice(F.concat(F.filter(links, lambda z: z["fresh"]), F.filter(links, lambda z: ~z["fresh"])), 1, most)
    out = graph.select(F.col("u").alias("centre"), F.explode(some).alias("z")).select("centre", "z.member", "z.fresh")
    back = out.select(F.col("member").alias("centre"), F.col("centre").alias("member"), "fresh")
    order = Window.partitionBy("centre").orderBy(F.desc("fresh"), F.xxhash64("member", "centre"))
    back = back.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).drop("r")
    return out.unionByName(back)


def _old(most: int):
    """Of a node's links, which were fresh for the last time: all but the fresh ones beyond the first most of them."""
    start = F.struct(F.lit(0).alias("n"), F.array().cast("array<boolean>").alias("old"))

    def step(acc, fresh):
        n = acc["n"] + fresh.cast("int")
        return F.struct(n.alias("n"), F.concat(acc["old"], F.array(~fresh | (n <= most))).alias("old"))

    return F.aggregate("fresh", start, step, lambda acc: acc["old"])


def descend(graph: DataFrame, vectors: DataFrame, width: int, neighbours: int = NEIGHBOURS, join: int = JOIN) -> DataFrame:
    """One round: compare neighbours of neighbours, keep the best of each node."""
    member = vectors.join(graph.select(F.col("u").alias("vec_id"), F.element_at("s", -1).alias("kth")), "vec_id").select(F.col("vec_id").alias("member"), "x", "kth")
    rows = _sides(graph, join).join(member, "member").select("centre", "member", "fresh", "kth", "x").repartition("centre").sortWithinPartitions("centre")
    def part(batches):
        for table in whole_groups(batches):
            centre, ids = table["centre"].to_numpy(), table["member"].to_numpy()
            fresh, kth = table["fresh"].to_numpy(), table["kth"].to_numpy()
            x, fill = _rows_of(table["x"], width)
            edges = np.concatenate((np.flatnonzero(np.concatenate(([True], centre[1:] != centre[:-1]))), [len(centre)]))
            owner, other, score = [], [], []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                s = _scores((x[a:b], fill[a:b]), (x[a:b], fill[a:b]))
                good = (s > kth[a:b, None]) & (fresh[a:b, None] | fresh[None, a:b]) & (ids[a:b, None] != ids[None, a:b])
                s = np.where(good, s, -np.inf)
                k = min(SEND, b - a)
                top = np.argpartition(-s, k - 1, axis=1)[:, :k]
                s = np.take_along_axis(s, top, axis=1)
                i, j = np.nonzero(s > -np.inf)
                owner.append(ids[a:b][i]), other.append(ids[a:b][top[i, j]]), score.append(s[i, j])
            owner, other, score, _ = best(np.concatenate(owner), np.concatenate(other), np.concatenate(score), neighbours)
            nodes, count = np.unique(owner, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(nodes), lists(count, pa.array(other)), lists(count, pa.array(score.astype(np.float32))), lists(count, pa.array(np.zeros(len(other), bool)))], names=["u", "v", "s", "old"])

    found = rows.mapInArrow(part, "u long, v array<long>, s array<float>, old array<boolean>")
    old = graph.select("u", "v", "s", _old(join).alias("old"))
    return keep(_merged(found.unionByName(old), neighbours), "graph")


def neighbour_graph(vectors: DataFrame, width: int, neighbours: int = NEIGHBOURS, rounds: int | None = None) -> DataFrame:
    """The graph, by descent until few links change; rounds: no more than so many."""
    graph, done = start(vectors, width, neighbours), 0
    while rounds is None or done < rounds:
        done += 1
        new = descend(graph, vectors, width, neighbours)
        remove(graph.sparkSession, table_path(graph)) if graph.inputFiles() else None
        graph = new
        share = graph.agg(F.avg(F.size(F.filter("fresh", lambda x: x)) / F.size("fresh"))).first()[0]
        if (share or 0) < CHANGE:
            break
    return graph


def search(graph: DataFrame, vectors: DataFrame, width: int, asked: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of the nodes in asked (vec_id)."""
    spark = graph.sparkSession
    buckets = shuffle_partitions(spark)
    name, folder = f"docweave_{uuid.uuid4().hex}", new_folder(spark, "adjacency")
    both = _sides(graph, NEIGHBOURS).select("centre", "member").distinct().join(vectors.select(F.col("vec_id").alias("member"), "x"), "member")

    def pack(batches):
        for table in whole_groups(batches):
            node, count = np.unique(table["centre"].to_numpy(), return_counts=True)
            edges = np.concatenate(([0], np.cumsum(count))) * (width + TAIL)
            x = unpacked(table["x"], np.uint8, width + TAIL)
            data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(node), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(x.tobytes())]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(node), lists(count, table["member"].combine_chunks()), data], names=["u", "v", "x"])

    fat = both.select("centre", "member", "x").repartition(buckets, "centre").sortWithinPartitions("centre", "member").mapInArrow(pack, "u long, v array<long>, x binary")
    fat.repartition(buckets, "u").write.bucketBy(buckets, "u").option("path", folder).option("compression", "zstd").saveAsTable(name)
    near = spark.table(name).withColumnRenamed("x", "near")
    queries = vectors.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").select(F.col("vec_id").alias("q"), "x")
    beam = keep(queries.select("q", "x", F.array("q").alias("v"), F.array(F.lit(0.0).cast("float")).alias("s"), F.array(F.lit(False)).alias("opened"), F.lit(True).alias("old")), "beam")

    def opened(batches):
        """(q, v, s) of what the opened nodes lead to."""
        for batch in batches:
            rows = []
            for r in range(batch.num_rows):
                q, floor = batch.column(0)[r].as_py(), batch.column(2)[r].as_py()
                x = decoded(np.frombuffer(batch.column(1)[r].as_py(), np.uint8)[None], width)[0][0]
                ids = batch.column(3)[r].values.to_numpy()
                # the extra component is the graph's: a query has none
                s = decoded(np.frombuffer(batch.column(4)[r].as_py(), np.uint8).reshape(-1, width + TAIL), width)[0] @ x
                good = (s > floor) & (ids != q)
                rows.append((q, ids[good], s[good]))
            count = np.array([len(r[1]) for r in rows], np.int64)
            v = np.concatenate([r[1] for r in rows]) if rows else np.zeros(0, np.int64)
            s = np.concatenate([r[2] for r in rows]) if rows else np.zeros(0, np.float32)
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), lists(count, pa.array(v)), lists(count, pa.array(s.astype(np.float32)))], names=["q", "v", "s"])

    def merge(batches):
        for table in whole_groups(batches):
            v, s, o = (table[c].combine_chunks() for c in ("v", "s", "opened"))
            v, s, o = ((c.chunk(0) if isinstance(c, pa.ChunkedArray) else c) for c in (v, s, o))
            owner = np.repeat(table["q"].to_numpy(), np.diff(v.offsets.to_numpy()))
            done = o.flatten().to_numpy(zero_copy_only=False).astype(np.int8)
            owner, v, s, done = best(owner, v.flatten().to_numpy(), s.flatten().to_numpy(), BEAM, done)
            node, count = np.unique(owner, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(node), lists(count, pa.array(v)), lists(count, pa.array(s)), lists(count, pa.array(done == 1))], names=["q", "v", "s", "opened"])

    ids = F.broadcast(_heads(vectors, width, HEADS).select("vec_id"))  # HEADS rows
    longest = vectors.select("vec_id", "e").join(ids, "vec_id").orderBy("vec_id").toArrow()
    heads = spark.sparkContext.broadcast((longest["vec_id"].to_numpy(), matrix(longest["e"].combine_chunks(), width)))

    def headed(batches):
        """(query_id, vec_id): the k best of the longest vectors for each query."""
        for batch in batches:
            ids, e = heads.value
            q = batch.column(0).to_numpy()
            s = matrix(batch.column(1), width) @ e.T
            s[q[:, None] == ids] = -np.inf
            top = np.argsort(-s, axis=1, kind="stable")[:, :k]
            owner, other = np.repeat(q, top.shape[1]), ids[top].reshape(-1)
            yield pa.RecordBatch.from_arrays([pa.array(owner[owner != other]), pa.array(other[owner != other])], names=["query_id", "vec_id"])

    step = 0
    while True:
        waits = F.slice(F.filter(F.slice(F.arrays_zip("v", "opened"), 1, FRONT), lambda z: ~z["opened"]), 1, OPEN)
        if beam.where(F.size(waits) > 0).isEmpty():
            break
        todo = beam.select("q", "x", F.when(F.size("s") >= BEAM, F.element_at("s", -1)).otherwise(F.lit(float("-inf")).cast("float")).alias("floor"), F.transform(waits, lambda z: z["v"]).alias("go"))
        go = todo.select("q", "x", "floor", F.explode("go").alias("u"))
        met = go.hint("shuffle_hash").join(near, "u").select("q", "x", "floor", "v", "near").mapInArrow(opened, "q long, v array<long>, s array<float>")
        met = met.select("q", "v", "s", F.transform("v", lambda v: F.lit(False)).alias("opened"))
        gone = F.transform(F.arrays_zip("v", "opened"), lambda z: z["opened"] | F.array_contains(F.col("go"), z["v"]))
        now = beam.join(todo.select("q", "go"), "q").select("q", "v", "s", gone.alias("opened"))
        if not step:  # the query itself only leads to others
            now = now.select("q", F.slice("v", 1, 0).alias("v"), F.slice("s", 1, 0).alias("s"), F.slice("opened", 1, 0).alias("opened"))
        merged = now.unionByName(met).repartition("q").sortWithinPartitions("q").mapInArrow(merge, "q long, v array<long>, s array<float>, opened array<boolean>")
        new = keep(merged.join(queries, "q").select("q", "x", "v", "s", "opened"), "beam")
        remove(spark, table_path(beam)) if beam.inputFiles() else None
        beam, step = new, step + 1
    pairs = beam.select(F.col("q").alias("query_id"), F.explode(F.slice("v", 1, 3 * k)).alias("vec_id"))
    long = vectors.join(asked.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "e").mapInArrow(headed, "query_id long, vec_id long")
    pairs = pairs.unionByName(long).distinct()
    exact = pairs.join(vectors.select("vec_id", "e"), "vec_id").join(vectors.select(F.col("vec_id").alias("query_id"), F.col("e").alias("f")), "query_id")
    score = F.aggregate(F.zip_with("e", "f", lambda a, b: F.coalesce(a, F.lit(0.0)) * F.coalesce(b, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    out = exact.select("query_id", "vec_id", score.alias("score")).withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    out = keep(out.select("query_id", "rank", "vec_id", "score"), "nearest")
    spark.sql(f"DROP TABLE IF EXISTS {name}")
    remove(spark, folder)
    return out


def nearest(table: DataFrame, every: int = 20, k: int = 20, rounds: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score for the rows whose vec_id is divisible by every, against all others."""
    vectors, width = quantise(table)
    graph = neighbour_graph(vectors, width, rounds=rounds)
    return search(graph, vectors, width, vectors.where(F.col("vec_id") % every == 0), k)
