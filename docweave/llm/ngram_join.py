"""N-gram Jaccard join: MinHash bands find candidates, full n-gram sets decide.

A text's set are the 64-bit hashes of its runs of five words (A-Z lower-cased, cut at white space); a text of one
to four words has one run, of all its words. Texts of equal sets form a class at once (by a 64-bit hash of the
set), so exact copies never meet in a join. Of each class one signature is cut into bands; bands and rows are
chosen so that a pair at the threshold shares a band with the target recall.

Only classes that share a bucket (a band hash) are ever compared, and two classes are compared in one bucket: that of the
first band that they share, which the band hashes sent along tell. So no pair becomes a row, nothing has to be made
distinct, and a chain of buckets costs no more than its buckets. Of a bucket of at most SMALL classes only those travel
that have a partner to be compared with there. A larger one is dealt into blocks of about BLOCK_BYTES of sets, block
against block, each compared tile by tile in matrix products; a task holds two blocks at most. Sets are only moved
for classes that have a candidate: a fixed-size bitmap of their ids filters the second pass.

Every row of the input gives one row: its class (the least doc_id of its connected component) and its links (the
number of other rows at or above the threshold, copies included). Null, empty and blank texts have no runs: they
link to nothing and their class is their own id. Equal rows are copies of each other. An empty table gives an empty
result; extra columns take no part, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .runtime import keep, packed, ship, trim
from .toxicity import pieces
from .wordbytes import _GOLD, Words, mix, shingles

WORDS = 5
THRESHOLD = 0.8
RECALL = 0.999
MOST_HASHES = 128
SMALL = 32
BLOCK_BYTES = 16 << 20
#: Sets of one matrix product, on either side.
TILE = 512
SALT = 16
#: Bits of the bitmap of candidate ids (1 MB).
BITS = 1 << 23
PIECE = 1 << 20


def bands_for(threshold: float, recall: float, most: int = MOST_HASHES) -> tuple[int, int]:
    """Bands and rows: the longest rows whose bands reach the recall at the threshold with at most so many hashes."""
    best = (1, 1)
    for rows in range(1, most + 1):
        p = threshold**rows
        bands = 1 if p >= 1 else max(1, math.ceil(math.log(1 - recall) / math.log1p(-p)))
        if bands * rows <= most:
            best = (bands, rows)
    return best


def text_sets(texts: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of all texts one after another, and how many each has."""
    hashes, runs = shingles(Words(texts), words)
    edges = np.concatenate(([0], np.cumsum(runs)))
    sets = [np.unique(hashes[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.array([len(s) for s in sets], np.int64)


def set_ids(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(values ^ _GOLD), dtype=np.uint64)))
    edges = np.concatenate(([0], np.cumsum(sizes)))
    return mix((run[edges[1:]] - run[edges[:-1]]) + sizes.astype(np.uint64) * _GOLD).view(np.int64)


def band_hashes(values: np.ndarray, sizes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One row for each set that is not empty: a hash of each band of its MinHash signature."""
    full = sizes > 0
    at = (np.cumsum(sizes) - sizes)[full]
    odd = mix(np.arange(1, bands * rows + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    flip = mix(odd)
    out = np.zeros((int(full.sum()), bands), np.uint64)
    for k in range(bands * rows):
        least = np.minimum.reduceat((values ^ flip[k]) * odd[k], at) if len(at) else np.zeros(0, np.uint64)
        out[:, k // rows] = mix(out[:, k // rows] + least + odd[k])
    return out


def _text(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def text_hash():
    return F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))


def sketch(docs: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """doc_id, hash of the text, set id, set size and band hashes of every row."""
    ship(docs.sparkSession)

    def part(batches):
        for batch in batches:
            for lo, hi in pieces(batch.column(1), PIECE):
                values, sizes = text_sets(batch.column(1).slice(lo, hi - lo), words)
                found = band_hashes(values, sizes, bands, rows)
                offsets = np.concatenate(([0], np.cumsum((sizes > 0) * bands))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found.reshape(-1).view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo), pa.array(set_ids(values, sizes)), pa.array(sizes), lists], names=["doc_id", "th", "sid", "n", "bands"])
        trim()

    return _text(docs).select("doc_id", "text", text_hash().alias("th")).mapInArrow(part, "doc_id long, th long, sid long, n long, bands array<long>")


def may_hold(docs: DataFrame, ids: DataFrame, name: str = "_may") -> DataFrame:
    """docs with a flag that is true where ids (doc_id) may hold the row's doc_id and false where it surely doesn't.

    The ids become a bitmap of BITS bits: a table of at most BITS / 64 rows, small enough to broadcast at any size of ids.
    """
    bit = F.pmod(F.xxhash64("doc_id"), F.lit(BITS))
    cell, mask = F.floor(bit / 64).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))
    cells = ids.groupBy(cell.alias("_cell")).agg(F.bit_or(mask).alias("_bits"))
    marked = docs.withColumn("_cell", cell).join(F.broadcast(cells), "_cell", "left")
    return marked.withColumn(name, F.coalesce(F.col("_bits").bitwiseAND(mask) != 0, F.lit(False))).drop("_cell", "_bits")


def candidate_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(sid, n, set, copies) of the classes in wanted (sid, doc_id, copies)."""

    def part(batches):
        for batch in batches:
            for lo, hi in pieces(batch.column(0), PIECE):
                values, sizes = text_sets(batch.column(0).slice(lo, hi - lo), words)
                edges = np.concatenate(([0], np.cumsum(sizes))) * 8
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(edges.astype(np.int64).tobytes()), pa.py_buffer(values.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(values, sizes)), pa.array(sizes), sets.cast(pa.binary())], names=["sid", "n", "set"])
        trim()

    near = may_hold(_text(docs), wanted.select("doc_id")).where("_may").select("text")
    found = near.mapInArrow(part, "sid long, n long, set binary")
    return keep(found.join(wanted.select("sid", "copies"), "sid").dropDuplicates(["sid"]), "sets", "snappy")


def _links(left: list[np.ndarray], right: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which pairs of sets reach the threshold: common elements by matrix products over slices of the elements."""
    both = left + right
    sizes = np.array([len(x) for x in both])
    owner = np.repeat(np.arange(len(both)), sizes)
    values, column, count = np.unique(np.concatenate(both), return_inverse=True, return_counts=True)
    useful = np.flatnonzero(count > 1)
    place = np.full(len(values), -1)
    place[useful] = np.arange(len(useful))
    column = place[column]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    wide = 4096
    for lo in range(0, len(useful), wide):
        a, b = np.searchsorted(column, (lo, lo + wide))
        dense = np.zeros((len(both), wide), np.float32)
        dense[owner[a:b], column[a:b] - lo] = 1
        common += dense[: len(left)] @ dense[len(left) :].T
    total = sizes[: len(left), None] + sizes[None, len(left) :] - common
    return common >= threshold * total - 1e-6


def _roots(sids: np.ndarray, links: np.ndarray) -> np.ndarray:
    """The least sid of each one's component under a symmetric matrix of links."""
    label = sids.copy()
    near = links | np.eye(len(sids), dtype=bool)
    top = np.iinfo(np.int64).max
    while True:
        new = np.where(near, label[None, :], top).min(axis=1)
        if (new == label).all():
            return label
        label = new


def cells(classes: DataFrame, threshold: float, small: int, block_bytes: int) -> DataFrame:
    """(band, j, p, q, own, sid): who meets whom. Sets of one (band, j, p, q) are compared, own p with own q."""
    places = classes.select("sid", "n", F.posexplode("bands").alias("j", "band"))
    buckets = places.groupBy("band", "j").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("weight")).where("size > 1")
    buckets = buckets.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    held = keep(places.withColumn("salt", F.pmod("sid", F.lit(SALT)).cast("int")).join(buckets, ["band", "j", "salt"]).drop("salt"), "buckets")

    few = held.where(F.col("size") <= small).join(classes.select("sid", "bands"), "sid").groupBy("band", "j").agg(F.collect_list(F.struct("sid", "n", "bands")).alias("m"))
    before = lambda x, y: F.exists(F.slice(F.zip_with(x["bands"], y["bands"], lambda a, b: a == b), F.lit(1), F.col("j")), lambda e: e)
    near = lambda x, y: (x["sid"] != y["sid"]) & (F.least(x["n"], y["n"]) >= threshold * F.greatest(x["n"], y["n"]) - 1e-6) & ~before(x, y)
    meets = F.filter("m", lambda x: F.exists("m", lambda y: near(x, y)))
    zero = F.lit(0)
    few = few.select("band", "j", zero.alias("p"), zero.alias("q"), zero.alias("own"), F.explode(meets).alias("x")).select("band", "j", "p", "q", "own", "x.sid")

    blocks = held.where(F.col("size") > small).withColumn("blocks", F.ceil(F.col("weight") * 8 / block_bytes).cast("int"))
    blocks = blocks.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    many = blocks.select("band", "j", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "sid")
    return keep(few.unionByName(many), "cells")


def compared(left: tuple, right: tuple, j: int, threshold: float) -> np.ndarray:
    """Which pairs of two tiles (sids, copies, bands, sets) are links that no band before j finds."""
    near = _links(left[3], right[3], threshold)
    near &= left[0][:, None] != right[0][None, :]
    for k in range(j):
        if not near.any():
            break
        near &= left[2][:, k, None] != right[2][None, :, k]
    return near


def verify(cells_: DataFrame, classes: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """(sid, links, root) from all pairs that meet in a cell."""
    rows = cells_.join(sets, "sid").join(classes.select("sid", "bands"), "sid").select("band", "j", "p", "q", "own", "sid", "copies", "bands", "set")
    rows = rows.repartition("band", "j", "p", "q").sortWithinPartitions("band", "j", "p", "q")

    def tiles(part: list[tuple]) -> list[tuple]:
        cut = [part[k : k + TILE] for k in range(0, len(part), TILE)]
        return [(np.array([r[5] for r in x], np.int64), np.array([r[6] for r in x], np.int64), np.array([r[7] for r in x], np.int64), [np.frombuffer(r[8], np.uint64) for r in x]) for x in cut]

    def solve(group: list[tuple]):
        _, j, p, q = group[0][:4]
        left = tiles([g for g in group if g[4] == p])
        right = left if p == q else tiles([g for g in group if g[4] == q])
        ids, links, roots = [], [], []
        for a, x in enumerate(left):
            for b, y in enumerate(right):
                if p == q and b < a:
                    continue
                hit = compared(x, y, j, threshold)
                if p == q and a == b:
                    ids.append(x[0]), links.append(hit @ x[1]), roots.append(_roots(x[0], hit))
                    continue
                both = np.concatenate((x[0], y[0]))
                full = np.zeros((len(both), len(both)), bool)
                full[: len(x[0]), len(x[0]) :] = hit
                full[len(x[0]) :, : len(x[0])] = hit.T
                ids.append(both), links.append(np.concatenate((hit @ y[1], hit.T @ x[1]))), roots.append(_roots(both, full))
        if not ids:
            return None
        ids, links, roots = np.concatenate(ids), np.concatenate(links), np.concatenate(roots)
        some = links > 0
        return pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(links[some]), pa.array(roots[some])], names=["sid", "links", "root"])

    def part(batches):
        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(9)), strict=True):
                if group and row[:4] != group[0][:4]:
                    if (out := solve(group)) is not None:
                        yield out
                    group = []
                group.append(row)
        if group and (out := solve(group)) is not None:
            yield out
        trim()

    return rows.mapInArrow(part, "sid long, links long, root long")


def _joined(docs: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, recall: float = RECALL, small: int = SMALL, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, th, class_id, n_links and stays (whether a row is the one of its class that deduplicate keeps) of every row."""
    bands, rows = bands_for(threshold, recall)
    marked = keep(sketch(docs, words, bands, rows), "sketch")
    least = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "th"))).alias("least")
    classes = keep(marked.where("n > 0").groupBy("sid", "n", "bands").agg(least, F.count(F.lit(1)).alias("copies")), "classes")
    met = cells(classes, threshold, small, block_bytes)
    wanted = keep(classes.select("sid", F.col("least.doc_id").alias("doc_id"), "copies").join(met.select("sid").distinct(), "sid", "left_semi"), "wanted")
    sets = candidate_sets(docs, wanted, words)
    found = keep(verify(met, classes, sets, threshold), "links")
    return finish(marked, classes, found)


def ngram_join(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id and n_links of every row of docs."""
    return _joined(docs, **options).select("doc_id", "class_id", "n_links")


def finish(marked: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """Every row's class and links from the links between classes."""
    roots = components(found.select(F.col("sid").alias("a"), F.col("root").alias("b")), "roots")
    links = found.groupBy("sid").agg(F.sum("links").alias("links"))
    known = classes.select("sid", "least", "copies").join(links, "sid", "left").join(roots.withColumnRenamed("node", "sid"), "sid", "left").where("copies > 1 OR root IS NOT NULL")
    known = keep(known.withColumn("root", F.coalesce("root", "sid")), "known")
    first = known.groupBy("root").agg(F.min("least").alias("first"))
    info = known.join(first, "root").select("sid", "first", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    info = info.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    dealt = marked.select("doc_id", "th", "sid", "n", F.pmod(F.xxhash64("doc_id"), F.lit(SALT)).cast("int").alias("salt"))
    stays = F.coalesce((F.col("doc_id") == F.col("first.doc_id")) & (F.col("th") == F.col("first.th")), F.lit(True))
    out = dealt.where("n > 0").join(info, ["sid", "salt"], "left").select("doc_id", "th", F.coalesce("first.doc_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), stays.alias("stays"))
    return out.unionByName(dealt.where("n = 0").select("doc_id", "th", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(True).alias("stays")))


def deduplicate(docs: DataFrame, **options) -> DataFrame:
    """docs with one row of each class, of the least doc_id (of its texts, if it has several in the class, that of the least hash); rows without an id stay.

    Only rows that may go are shuffled; equal rows of one doc_id become one.
    """
    rows = keep(_joined(docs, **options).where("doc_id IS NOT NULL").select("doc_id", "th", "stays"), "joined")
    gone = rows.where(~F.col("stays")).select("doc_id", "th").distinct()
    twice = rows.groupBy("doc_id").count().where("count > 1").select("doc_id")
    marked = may_hold(packed(docs, "doc_id", "text"), gone.select("doc_id").unionByName(twice))
    suspects = marked.where("_may").withColumn("th", text_hash()).drop("_may").join(gone, ["doc_id", "th"], "left_anti")
    once = suspects.where("doc_id IS NOT NULL").dropDuplicates(["doc_id", "th"]).unionByName(suspects.where("doc_id IS NULL"))
    return marked.where("NOT _may").select("_row.*").unionByName(once.select("_row.*"))
