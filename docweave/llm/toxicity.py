"""Toxicity: averaged subword-bag embeddings under a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its byte 3- to 5-grams and of the word itself, hashed into a
fixed table; a text's vector is the mean over its words; a linear softmax on top gives the class. Misspelt
words share most n-grams, hence vectors, with the words they come from.

Training runs on the driver over a bounded sample of labelled rows (MAX_TRAIN, by hash of the id), so its cost
does not grow with the corpus. Since the softmax is linear, a trained model scores a text as the mean over its
words of one number for each hashed n-gram, so executors get one vector of BUCKETS floats and no more.
Texts are scored whole, in one map without any shuffle.

Null or empty texts, and texts of white space, have no words: their vector is zero and their score is the
model's bias. Rows are scored one by one, so repeated rows get equal scores. Labels other than 0 and 1, null
labels and labels without a text are left out of training; if several labels have one id, the largest holds.
With no usable labels of both classes the score is the share of label 1 (0 without any).
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import by_hash, ship, trim
from .wordbytes import _GOLD, _MASK, Words, mix

BUCKETS = 1 << 18
DIM = 4
GRAMS = (3, 4, 5)
#: At most so many labelled rows are learned from, those with the smallest hash of doc_id.
MAX_TRAIN = 8000
#: Longer texts are not learned from, so that a sample's bytes are bounded too.
TRAIN_BYTES = 1 << 16
EPOCHS = 12
BATCH = 64
RATE = 0.3
DECAY = 2e-5
THRESHOLD = 0.3
_SHIFT = np.uint64(64 - 18)
_ODD = mix(np.arange(9, dtype=np.uint64) * _GOLD + _GOLD) | np.uint64(1)
#: Texts are scored in pieces of about so many bytes, to bound memory.
PIECE = 256 << 10


def _slots(words: Words, n: int, size: int) -> np.ndarray:
    """Of each of the first size byte places: the slot of the n-gram that starts there."""
    lanes = np.ndarray((size,), "<u8", buffer=words.data, strides=(1,))
    return (((lanes & _MASK[n]) * _ODD[n]) >> _SHIFT).astype(np.int32)


def _inside(words: Words, size: int) -> dict[int, np.ndarray]:
    """Of each byte place: whether the n bytes from there lie in one word, for each n."""
    ends = np.zeros(size + 8, bool)
    ends[words.ends - 1] = True
    word = np.zeros(size + 8, np.int8)
    word[words.starts] = 1
    word[words.ends] -= 1
    link = (np.cumsum(word, dtype=np.int8) > 0) & ~ends  # with the next byte
    out, run = {}, np.ones(size, bool)
    for k in range(1, max(GRAMS)):
        run = run & link[k - 1 : k - 1 + size]
        if k + 1 in GRAMS:
            out[k + 1] = run
    return out


def bags(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, slot and weight of every feature occurrence; a text's weights sum to 1."""
    size, count = len(words.data) - 16, np.diff(words.first)
    text = np.repeat(np.arange(len(count)), count)
    length = words.ends - words.starts
    weight = 1.0 / (_features(length) * np.maximum(count, 1)[text])
    of, slots, weights = [text], [(mix(words.hash) >> _SHIFT).astype(np.int32)], [weight]
    word = np.zeros(size, np.int32)
    word[words.starts[1:]] = 1
    word = np.cumsum(word)
    for n, ok in _inside(words, size).items() if len(words) else ():
        at = word[ok]
        of.append(text[at])
        slots.append(_slots(words, n, size)[ok])
        weights.append(weight[at])
    return np.concatenate(of), np.concatenate(slots), np.concatenate(weights)


def _features(length: np.ndarray) -> np.ndarray:
    return 1 + sum(np.maximum(length - n + 1, 0) for n in GRAMS)


@dataclass
class Model:
    """gain: what each slot adds to the logit of label 1; bias: the logit of a text without words."""

    gain: np.ndarray
    bias: float

    def logits(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts)
        count, size = np.diff(words.first), len(words.data) - 16
        if not len(words):
            return np.full(len(count), self.bias)
        places = np.zeros(size)
        for n, ok in _inside(words, size).items():
            places += self.gain[_slots(words, n, size)] * ok
        run = np.concatenate(([0.0], np.cumsum(places)))
        total = run[words.ends] - run[words.starts] + self.gain[(mix(words.hash) >> _SHIFT).astype(np.int32)]
        run = np.concatenate(([0.0], np.cumsum(total / _features(words.ends - words.starts))))
        return (run[words.first[1:]] - run[words.first[:-1]]) / np.maximum(count, 1) + self.bias


def _batch(texts: pa.Array, labels: np.ndarray) -> tuple:
    """The rows of one batch: distinct slots, of every entry its slot's place and weight, and the entries of each text."""
    text, slot, weight = bags(Words(texts))
    key = text.astype(np.int64) * BUCKETS + slot
    key, where = np.unique(key, return_inverse=True)
    weight = np.bincount(where, weights=weight).astype(np.float32)
    used, where = np.unique((key % BUCKETS).astype(np.int32), return_inverse=True)
    return used, where.astype(np.int32), np.bincount(key // BUCKETS, minlength=len(texts)), weight, labels


def fit(texts: list[str | None] | pa.Array | pa.ChunkedArray, labels: np.ndarray, seed: int = 7) -> Model:
    """Learn table and softmax together by Adagrad on the cross-entropy."""
    labels = np.asarray(labels, dtype=np.int64)
    if len(labels) == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if len(labels) else 0.0
        return Model(np.zeros(BUCKETS, np.float32), float(np.log((share + 1e-6) / (1 - share + 1e-6))))
    draw = np.random.default_rng(seed)
    order = draw.permutation(len(texts))
    texts = pa.array(texts, pa.string()) if isinstance(texts, list) else texts
    batches = [_batch(texts.take(pa.array(order[k : k + BATCH])), labels[order[k : k + BATCH]]) for k in range(0, len(order), BATCH)]
    del texts
    table = draw.uniform(-0.01, 0.01, (BUCKETS, DIM)).astype(np.float32)
    soft = draw.uniform(-1, 1, (DIM, 2)).astype(np.float32)
    bias = np.log(np.array([np.mean(labels == 0), np.mean(labels == 1)])).astype(np.float32)
    seen, seen_soft = np.full((BUCKETS, DIM), 1e-8, np.float32), np.full((DIM, 2), 1e-8, np.float32)
    for _ in range(EPOCHS):
        for b in draw.permutation(len(batches)):
            used, where, sizes, weight, label = batches[b]
            text = np.repeat(np.arange(len(label)), sizes)
            own = table[used]
            vectors = np.stack([np.bincount(text, weights=own[where, j] * weight, minlength=len(label)) for j in range(DIM)], axis=1)
            z = vectors @ soft + bias
            z -= z.max(axis=1, keepdims=True)
            p = np.exp(z)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(label)), label] -= 1
            p /= len(label)
            g_soft = vectors.T @ p
            back = (p @ soft.T).astype(np.float32)
            g = np.stack([np.bincount(where, weights=weight * back[text, j], minlength=len(used)) for j in range(DIM)], axis=1).astype(np.float32)
            g += DECAY * own
            seen[used] += g * g
            table[used] = own - RATE * g / np.sqrt(seen[used])
            seen_soft += g_soft * g_soft
            soft -= (RATE * g_soft / np.sqrt(seen_soft)).astype(np.float32)
            bias -= RATE * p.sum(axis=0)
    return Model((table @ (soft[:, 1] - soft[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def held_out(doc_id="doc_id"):
    """Rows that are never learned from."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Model:
    """Fit on at most max_train labelled rows outside the held-out quarter."""
    usable = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out())
    chosen = by_hash(usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), max_train, labels.count() // 2, "doc_id")
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.coalesce(F.octet_length("text"), F.lit(0)) <= TRAIN_BYTES).join(F.broadcast(chosen), "doc_id").orderBy(F.xxhash64("doc_id", "text"), "text").limit(max_train).select("text", "toxic").toArrow()
    model = fit(rows["text"], rows["toxic"].to_numpy())
    del rows
    trim()
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of every row of docs."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((model.gain, model.bias))

    def part(batches):
        scorer = Model(*shared.value)
        for batch in batches:
            text, out = batch.column(1), []
            for lo, hi in pieces(text):
                out.append(1 / (1 + np.exp(-scorer.logits(text.slice(lo, hi - lo)))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(out) if out else np.zeros(0))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(part, "doc_id long, score double")


def reject(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score threshold or more: one map, no shuffle."""
    spark = docs.sparkSession
    ship(spark)
    shared, at = spark.sparkContext.broadcast((model.gain, model.bias)), docs.columns.index("text")

    def part(batches):
        scorer = Model(*shared.value)
        for batch in batches:
            text = batch.column(at)
            stays = [1 / (1 + np.exp(-scorer.logits(text.slice(lo, hi - lo)))) < threshold for lo, hi in pieces(text)]
            yield batch.filter(pa.array(np.concatenate(stays) if stays else np.zeros(0, bool)))
        trim()

    return docs.mapInArrow(part, docs.schema)


def pieces(text: pa.Array, size: int = PIECE) -> list[tuple[int, int]]:
    """Row ranges of about size bytes each."""
    lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
    mark = np.cumsum(lengths) // size
    cuts = np.flatnonzero(np.diff(mark)) + 1
    edges = [0, *cuts.tolist(), len(text)]
    return [(a, b) for a, b in zip(edges[:-1], edges[1:], strict=True) if b > a]


def toxicity(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    """doc_id, held_out, score and predicted of every row of docs."""
    scored = score(docs, train(docs, labels, max_train))
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
