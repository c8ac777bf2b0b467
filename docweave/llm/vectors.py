"""What the two vector searches share: usable rows, one row an id, and groups of rows within sorted partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(table: DataFrame, zero: bool) -> DataFrame:
    """(vec_id, e): vectors as doubles that are whole and finite and, unless zero is set, not all zero; one row an id (the greatest vector)."""
    e = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    rows = table.select(F.col("vec_id").cast("long").alias("vec_id"), e.alias("e")).where("vec_id IS NOT NULL AND e IS NOT NULL")
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(~bad)
    if not zero:
        rows = rows.where(F.exists("e", lambda x: x != 0))
    if rows.groupBy("vec_id").count().where("count > 1").limit(1).count():
        rows = rows.groupBy("vec_id").agg(F.max("e").alias("e"))
    return rows


def matrix(lists: pa.Array, width: int) -> np.ndarray:
    """A list array as rows of a matrix, short ones filled with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    values = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = np.zeros((len(sizes), width))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = values
    return out


def packed_rows(rows: np.ndarray) -> pa.Array:
    """Each row of a matrix as one binary value."""
    rows = np.ascontiguousarray(rows)
    step = rows.shape[1] * rows.itemsize
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * step).astype(np.int64).tobytes()), pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def unpacked(values: pa.Array, dtype, width: int) -> np.ndarray:
    if not len(values):
        return np.zeros((0, width), dtype)
    return np.frombuffer(b"".join(values.to_pylist()), dtype).reshape(len(values), width)


def lists(sizes: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), values)


def whole_groups(batches, column: int = 0):
    """Batches of rows sorted by a column, put together so that no group of equal values is cut."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(column).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(key, key[-1]))
        if cut == 0 and held and held[-1].column(column)[held[-1].num_rows - 1].as_py() == key[0]:
            held.append(batch)
            continue
        if cut == 0:
            if held:
                yield pa.Table.from_batches(held).combine_chunks()
            held = [batch]
            continue
        held.append(batch.slice(0, cut))
        yield pa.Table.from_batches(held).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def best(owner: np.ndarray, ids: np.ndarray, scores: np.ndarray, most: int, extra: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """Of each owner the most entries of largest score (then smaller id), each id once: owner, ids, scores, extra, by owner and rank.

    Of entries of one owner and id the one with larger extra, then score, counts.
    """
    extra = np.zeros(len(ids), np.int8) if extra is None else extra
    order = np.lexsort((-scores, -extra, ids, owner))
    owner, ids, scores, extra = owner[order], ids[order], scores[order], extra[order]
    head = np.ones(len(ids), bool)
    head[1:] = (owner[1:] != owner[:-1]) | (ids[1:] != ids[:-1])
    owner, ids, scores, extra = owner[head], ids[head], scores[head], extra[head]
    order = np.lexsort((ids, -scores, owner))
    owner, ids, scores, extra = owner[order], ids[order], scores[order], extra[order]
    first = np.ones(len(ids), bool)
    first[1:] = owner[1:] != owner[:-1]
    start = np.flatnonzero(first)
    rank = np.arange(len(ids)) - np.repeat(start, np.diff(np.append(start, len(ids))))
    keep = rank < most
    return owner[keep], ids[keep], scores[keep], extra[keep]
