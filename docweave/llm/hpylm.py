"""A hierarchical Pitman-Yor language model, Chinese-restaurant seating sampled by Gibbs.

A token's context is the word before it (or the start of the text). A context's restaurant is found by a hash of the whole
word: SLOTS restaurants for each of 32 classes of the word's last byte. A class's restaurants share the parent of that
class, the classes share the root, and the root's base is uniform over the known words and one unknown. So
words that are frequent enough to tell apart have a restaurant of their own, the rare ones share some, and every text
position has a context whatever the vocabulary; there are at most 1,048,577 restaurants, whose totals every task
can hold. What grows with the corpus are their dishes: every pair of word and context is counted over all training texts.

Counting and sampling are dealt by word, since all dishes of a word in all restaurants depend on each other only through
the restaurants' totals. A sweep resamples the number of tables of every dish from its conditional given all others
(weights a^t S(c, t) with generalised Stirling numbers up to CLOSED customers, and the normal or Poisson limit of
the same weights beyond), level by level; restaurant totals are those of the sweep before. Then the concentration of each
level is drawn from its conditional given all totals, over GRID. After BURN sweeps, SAMPLES seatings are kept and
their predictive probabilities averaged. Discounts are the usual estimate n1 / (n1 + 2 n2) of each level.

Rows move as compressed blocks of many words, not one by one. Scores of the at most HEAD most frequent pairs go to all
tasks as one table of bounded size; the other positions are dealt by word, scored where the word's dishes are, and summed
for each text. So a frequent word is no hot key, and nothing is dropped.

Null texts are empty and have one token, the end. Words are known by 64-bit hashes. Rows without an id count as
training rows. Without training rows every probability is 1. Every row of the input gives one row; an empty table gives
none. Extra columns take no part, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import keep, remove, ship, shuffle_partitions, table_path
from .toxicity import pieces
from .vectors import whole_groups
from .wordbytes import _GOLD, Words, mix

END = np.uint64(0x7F4A7C15D1B54A33)
#: Bits of a context's slot, below its class; the last class is the start of a text.
SLOT, CLASSES = 15, 33
START = (CLASSES - 1) << SLOT
BURN, SAMPLES = 4, 4
#: Concentrations that are drawn from, with equal odds before the data.
GRID = np.geomspace(0.05, 2000.0, 64)
CLOSED = 48
HEAD = 1 << 20
#: Bits of a key that tell where its like begin among the most frequent pairs.
FIRST = 20
#: Tasks of the last step but one of a sum over all restaurants.
WAYS = 8
#: Tokens counted before a task sends what it has.
CHUNK = 3 << 20
PIECE = 1 << 20


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), dtype)


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes and context codes of all tokens, ends included, and how many each text has."""
    words = Words(texts)
    count = np.diff(words.first)
    n = len(words)
    code = (words.data[words.ends - 1] & 31).astype(np.int32) << SLOT
    code += (words.hash >> np.uint64(40)).astype(np.int32) & ((1 << SLOT) - 1)
    text = np.repeat(np.arange(len(count)), count)
    at = np.arange(n) + text
    total = n + len(count)
    w, before = np.full(total, END), np.full(total, START, np.int32)
    w[at] = words.hash
    before[at + 1] = code  # a text has its end after its last word, so the next place is in the same text
    return w, before, count + 1


def _types(w: np.ndarray, code: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs in order of word and code, with the sum of their counts."""
    order = np.argsort(w)
    w = w[order]
    at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, np.int64)
    words, both = w[at], code[order].astype(np.int64)
    both += np.repeat(np.arange(len(at)) << (SLOT + 6), np.diff(np.append(at, len(w))))  # a word's place and the code, as one number
    if c is None:
        both.sort()
    else:
        again = np.argsort(both)
        both, c = both[again], c[order][again]
    at = np.flatnonzero(np.concatenate(([True], both[1:] != both[:-1]))) if len(both) else np.zeros(0, np.int64)
    total = np.diff(np.append(at, len(both))) if c is None else np.add.reduceat(c, at) if len(at) else np.zeros(0, np.int64)
    both = both[at]
    return words[both >> (SLOT + 6)], (both & ((1 << (SLOT + 6)) - 1)).astype(np.int32), total.astype(np.int64)


def _runs(w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate(([True], w[1:] != w[:-1]))) if len(w) else np.zeros(0, int)
    return w[at], np.diff(np.append(at, len(w))).astype(np.int32)


def _bucket(w: np.ndarray, buckets: int) -> np.ndarray:
    return ((w >> np.uint64(33)) % np.uint64(buckets)).astype(np.uint16 if buckets <= 1 << 16 else np.int32)  # the narrow ones are sorted by digits


def trains():
    """Rows that are learned from."""
    return ~F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1, F.lit(False))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_COUNTED = "bucket int, words binary, runs binary, codes binary, counts binary"


def count(docs: DataFrame, buckets: int) -> DataFrame:
    """Blocks of pairs and counts of docs' texts, a bucket of words each."""

    def send(held: list[tuple]):
        w, code, c = _types(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        bucket = _bucket(w, buckets)
        order = np.argsort(bucket, kind="stable")
        w, code, c, bucket = w[order], code[order], c[order], bucket[order]
        edges = np.searchsorted(bucket, np.arange(buckets + 1))
        rows = [(b, *_block(w[lo:hi], code[lo:hi], c[lo:hi])) for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if hi > lo]
        return _batch(rows, _COUNTED)

    def part(batches):
        held, size = [], 0
        for batch in batches:
            for lo, hi in pieces(batch.column(0), PIECE):
                w, code, _ = tokens(batch.column(0).slice(lo, hi - lo))
                held.append((w, code))
                size += len(w)
                if size >= CHUNK:
                    yield send(held)
                    held, size = [], 0
        if held:
            yield send(held)

    return docs.select("text").mapInArrow(part, _COUNTED)


def _block(w: np.ndarray, code: np.ndarray, c: np.ndarray) -> tuple[bytes, ...]:
    words, runs = _runs(w)
    return _pack(words), _pack(runs), _pack(code.astype(np.int32)), _pack(c)


_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "float": pa.float32(), "array<long>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32()), "array<binary>": pa.list_(pa.binary()), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [x.strip().split(" ", 1) for x in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[t]) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


class Dishes:
    """The dishes of one bucket: words, the pairs of word and class, and the pairs of word and context."""

    def __init__(self, words: np.ndarray, runs: np.ndarray, codes: np.ndarray, counts: np.ndarray):
        self.words, self.codes, self.counts = words, codes, counts
        self.word = np.repeat(np.arange(len(words)), runs)
        one = codes >> SLOT
        head = np.ones(len(codes), bool)
        head[1:] = (self.word[1:] != self.word[:-1]) | (one[1:] != one[:-1])
        self.pair_at = np.flatnonzero(head)
        self.pair = np.cumsum(head) - 1
        self.pair_word, self.pair_code = self.word[self.pair_at], one[self.pair_at]
        self.word_at = np.flatnonzero(np.concatenate(([True], self.pair_word[1:] != self.pair_word[:-1]))) if len(self.pair_word) else np.zeros(0, int)
        self.word_count = np.bincount(self.word, weights=counts, minlength=len(words)).astype(np.int64)

    def up(self, t2: np.ndarray, t1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Customers of the classes' restaurants and of the root: a table below sends one."""
        return (np.add.reduceat(t2, self.pair_at) if len(t2) else t2), (np.add.reduceat(t1, self.word_at) if len(t1) else t1)


class Totals:
    """Customers and tables of every restaurant, discounts and concentrations; what all tasks share. vocabulary: known words."""

    def __init__(self, discounts: tuple[float, float, float], vocabulary: int, concentrations: tuple[float, float, float] = (1.0, 1.0, 1.0)):
        self.d, self.v, self.th = discounts, vocabulary, concentrations
        self.c2, self.t2 = np.zeros(START + 1, np.int64), np.zeros(START + 1, np.int64)
        self.c1, self.t1 = np.zeros(CLASSES), np.zeros(CLASSES)
        self.c0 = self.t0 = 0.0
        self.held: bytes | None = None

    def __getstate__(self) -> dict:
        """Packed for the way: most restaurants of a small corpus are empty, and all seatings share one packed c2."""
        self.held = self.held or _pack(self.c2)
        return {**self.__dict__, "c2": None, "t2": _pack(self.t2)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ = state
        self.c2, self.t2 = _unpack(self.held, np.int64), _unpack(state["t2"], np.int64)

    def root(self, c, t):
        return (c - self.d[0] * t + (self.th[0] + self.d[0] * self.t0) / (self.v + 1)) / (self.th[0] + self.c0)

    def one(self, code, c, t, parent):
        return (c - self.d[1] * t + (self.th[1] + self.d[1] * self.t1[code]) * parent) / (self.th[1] + self.c1[code])

    def two(self, code, c, t, parent):
        return (c - self.d[2] * t + (self.th[2] + self.d[2] * self.t2[code]) * parent) / (self.th[2] + self.c2[code])

    def concentrations(self, draw: np.random.Generator) -> tuple[float, float, float]:
        """One for each level, from its conditional given customers and tables of all restaurants of the level."""
        out = []
        for d, c, t in ((self.d[0], np.array([self.c0]), np.array([self.t0])), (self.d[1], self.c1, self.t1), (self.d[2], self.c2, self.t2)):
            (cs, nc), (ts, nt) = np.unique(c[c > 0], return_counts=True), np.unique(t[c > 0], return_counts=True)
            weight = np.array([nt @ (log_gamma(x / d + ts) - log_gamma(x / d)) - nc @ (log_gamma(x + cs) - log_gamma(x)) if len(cs) else 0.0 for x in GRID])
            out.append(float(GRID[np.argmax(weight + draw.gumbel(size=len(GRID)))]))
        return tuple(out)


def log_gamma(x):
    """By the series of Stirling at x + 8."""
    x = np.asarray(x, float)
    y = x + 8
    low = np.log(x) + np.log(x + 1) + np.log(x + 2) + np.log(x + 3) + np.log(x + 4) + np.log(x + 5) + np.log(x + 6) + np.log(x + 7)
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - low


def stirling(d: float, most: int = CLOSED) -> np.ndarray:
    """Logarithms of the generalised Stirling numbers S(c, t) of discount d, for c and t up to most."""
    out = np.full((most + 1, most + 1), -np.inf)
    out[1, 1] = 0.0
    for c in range(1, most):
        t = np.arange(1, c + 1)
        out[c + 1, 1 : c + 1] = out[c, 1 : c + 1] + np.log(c - d * t)
        out[c + 1, 2 : c + 2] = np.logaddexp(out[c + 1, 2 : c + 2], out[c, 1 : c + 1])
    return out


def sample_tables(c: np.ndarray, a: np.ndarray, d: float, draw: np.random.Generator) -> np.ndarray:
    """Of dishes with c customers, the number of their tables, from weights a^t S(c, t)."""
    t = np.minimum(c, 1).astype(np.int64)
    table = stirling(d)
    log_a = np.log(np.maximum(a, 1e-300))
    small = np.minimum(c, CLOSED)
    many = np.flatnonzero(small > 1)
    many = many[np.argsort(small[many], kind="stable")]
    edges = np.searchsorted(small[many], np.arange(2, CLOSED + 2))
    for k, (lo, hi) in enumerate(zip(edges[:-1], edges[1:], strict=True), 2):
        for at in range(lo, hi, 1 << 15):
            rows = many[at : min(hi, at + (1 << 15))]
            z = log_a[rows] * np.arange(1, k + 1)[:, None] + table[k, 1 : k + 1, None]
            z -= z.max(axis=0)
            run = np.cumsum(np.exp(z), axis=0)
            t[rows] = 1 + (run[:-1] <= draw.random(len(rows)) * run[-1]).sum(axis=0)
    rest = np.flatnonzero(c > CLOSED)
    if len(rest):
        t[rest] = _many_tables(c[rest].astype(float), np.maximum(a[rest], 1e-300), d, draw)
    return t


def _many_tables(c: np.ndarray, a: np.ndarray, d: float, draw: np.random.Generator) -> np.ndarray:
    """The same for many customers, from the generating function exp((a / d) (1 - (1 - z)^d)) of all seatings.

    At the z where its mean is c, tables are Poisson with mean (a / d) (1 - (1 - z)^d); given c their variance
    is smaller by c / (1 + (1 - d) z / (1 - z)).
    """
    low, high = np.full(len(c), -200.0), np.full(len(c), -1e-12)  # log(1 - z)
    for _ in range(70):
        u = (low + high) / 2
        above = np.log(a) + np.log1p(-np.exp(u)) + (d - 1) * u > np.log(c)
        low, high = np.where(above, u, low), np.where(above, high, u)
    u = (low + high) / 2
    mean = a / d * -np.expm1(d * u)
    spread = np.maximum(mean - c / (1 + (1 - d) * -np.expm1(u) * np.exp(np.minimum(-u, 700))), 1e-9)
    t = 1 + np.where(mean > 8, np.rint(draw.normal(mean, np.sqrt(spread))), draw.poisson(np.minimum(mean, 8)))
    return np.clip(t, 1, c).astype(np.int64)


_STATE = "bucket int, words binary, runs binary, codes binary, counts binary, t2 array<binary>, t1 array<binary>, t0 array<binary>, place binary, amount binary, tokens long, vocabulary long, ones array<long>, large array<long>"
#: Places of totals: customers and tables of contexts, of classes, of the root.
_C2, _T2 = 0, START + 1
_C1, _T1, _C0, _T0 = 2 * _T2, 2 * _T2 + CLASSES, 2 * _T2 + 2 * CLASSES, 2 * _T2 + 2 * CLASSES + 1


def _state(bucket: int, blocks: tuple[bytes, ...], dishes: Dishes, t2s: list, t1s: list, t0s: list) -> tuple:
    t2, t1, t0 = t2s[-1], t1s[-1], t0s[-1]
    c1, c0 = dishes.up(t2, t1)
    place, amount = [], []
    for base, at, x in ((_C2, dishes.codes, dishes.counts), (_T2, dishes.codes, t2), (_C1, dishes.pair_code, c1), (_T1, dishes.pair_code, t1)):
        total = np.bincount(at, weights=x)
        some = np.flatnonzero(total)
        place += [some + base]
        amount += [total[some].astype(np.int64)]
    place = np.concatenate([*place, [_C0, _T0]]).astype(np.int32)
    amount = np.concatenate([*amount, [c0.sum(), t0.sum()]]).astype(np.int64)
    ones = [int((x == k).sum()) for x in (c0, c1, dishes.counts) for k in (1, 2)]
    large = [int((dishes.counts >= 1 << k).sum()) for k in range(48)]
    packs = lambda xs: [_pack(x.astype(np.int32)) for x in xs]
    return (bucket, *blocks, packs(t2s), packs(t1s), packs(t0s), _pack(place), _pack(amount), int(dishes.counts.sum()), len(dishes.words), ones, large)


def seat(counted: DataFrame) -> DataFrame:
    """First states: one table for every dish."""

    def part(batches):
        for table in whole_groups(batches):
            buckets = table["bucket"].to_numpy()
            edges = np.concatenate((np.flatnonzero(np.concatenate(([True], buckets[1:] != buckets[:-1]))), [len(buckets)]))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                w, code, c = [], [], []
                for r in table.slice(lo, hi - lo).to_pylist():
                    w.append(np.repeat(_unpack(r["words"], np.uint64), _unpack(r["runs"], np.int32)))
                    code.append(_unpack(r["codes"], np.int32))
                    c.append(_unpack(r["counts"], np.int64))
                w, code, c = _types(np.concatenate(w), np.concatenate(code), np.concatenate(c))
                words, runs = _runs(w)
                dishes = Dishes(words, runs, code, c)
                one = [np.ones(n, np.int64) for n in (len(code), len(dishes.pair_at), len(words))]
                yield _batch([_state(int(buckets[lo]), _block(w, code, c), dishes, *[[x] for x in one])], _STATE)

    return keep(counted.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(part, _STATE), "seating")


def totals(states: DataFrame, before: Totals | None = None, seed: int = 0) -> tuple[Totals, int]:
    """The restaurants' totals (at most 2,097,222 sums) and the number of training tokens. before: those of the sweep before."""
    n, v, *ones = states.agg(F.sum("tokens"), F.sum("vocabulary"), *[F.sum(F.get("ones", F.lit(k))) for k in range(6)]).first()
    if before is not None:
        discounts = before.d
    else:
        pick = lambda a, b: min(0.95, max(0.05, (a or 0) / max(1, (a or 0) + 2 * (b or 0))))
        discounts = tuple(pick(ones[2 * k], ones[2 * k + 1]) for k in range(3))
    out = Totals(discounts, v or 0, before.th if before else (1.0, 1.0, 1.0))
    # one dense sum for each task, then for each of WAYS: what is left to collect has a fixed size
    sums = states.select("place", "amount").mapInArrow(_add, "place binary, amount binary").repartition(WAYS).mapInArrow(_add, "place binary, amount binary").collect()
    dense = np.zeros(_T0 + 1)
    for r in sums:
        dense[_unpack(r["place"], np.int32)] += _unpack(r["amount"], np.int64)
    for base, x in ((_C2, out.c2), (_T2, out.t2), (_C1, out.c1), (_T1, out.t1)):
        x[:] = dense[base : base + len(x)]
    out.c0, out.t0 = float(dense[_C0]), float(dense[_T0])
    if before is not None:
        before.held = before.held or _pack(before.c2)
        out.c2, out.held = before.c2, before.held  # one array for all seatings: customers of the lowest level never change
    out.th = out.concentrations(np.random.default_rng([seed, 1]))
    return out, int(n or 0)


def _add(batches):
    dense = np.zeros(_T0 + 1, np.int64)
    for batch in batches:
        for k in range(batch.num_rows):
            dense[_unpack(batch.column(0)[k].as_py(), np.int32)] += _unpack(batch.column(1)[k].as_py(), np.int64)
    some = np.flatnonzero(dense).astype(np.int32)
    if len(some):
        yield _batch([(_pack(some), _pack(dense[some]))], "place binary, amount binary")


def _open(r: dict) -> tuple[Dishes, list, list, list]:
    dishes = Dishes(_unpack(r["words"], np.uint64), _unpack(r["runs"], np.int32), _unpack(r["codes"], np.int32), _unpack(r["counts"], np.int64))
    return dishes, *[[_unpack(x, np.int32).astype(np.int64) for x in r[k]] for k in ("t2", "t1", "t0")]


def sweep(states: DataFrame, now: Totals, number: int, add: bool) -> DataFrame:
    """Resample every dish's tables; the new seating joins the kept ones or replaces the last."""
    shared = states.sparkSession.sparkContext.broadcast(now)

    def part(batches):
        all_ = shared.value
        for batch in batches:
            for r in batch.to_pylist():
                dishes, t2s, t1s, t0s = _open(r)
                draw = np.random.default_rng([number, r["bucket"]])
                c1, c0 = dishes.up(t2s[-1], t1s[-1])
                root = all_.root(c0, t0s[-1])
                one = all_.one(dishes.pair_code, c1, t1s[-1], root[dishes.pair_word])
                t2 = sample_tables(dishes.counts, (all_.th[2] + all_.d[2] * all_.t2[dishes.codes]) * one[dishes.pair], all_.d[2], draw)
                c1 = dishes.up(t2, t1s[-1])[0]
                t1 = sample_tables(c1, (all_.th[1] + all_.d[1] * all_.t1[dishes.pair_code]) * root[dishes.pair_word], all_.d[1], draw)
                c0 = dishes.up(t2, t1)[1]
                t0 = sample_tables(c0, np.full(len(c0), (all_.th[0] + all_.d[0] * all_.t0) / (all_.v + 1)), all_.d[0], draw)
                kept = [(x if add else x[:-1]) + [y] for x, y in ((t2s, t2), (t1s, t1), (t0s, t0))]
                yield _batch([_state(r["bucket"], (r["words"], r["runs"], r["codes"], r["counts"]), dishes, *kept)], _STATE)

    new = keep(states.mapInArrow(part, _STATE), "seating")
    shared.destroy()  # what it was needed for is stored
    return new


class Seats:
    """What predicted needs of a bucket, made once for all its blocks: sorted keys, and by sample each dish's customers without its tables' discounts; a last place, 0, is for what is not there."""

    def __init__(self, dishes: Dishes, t2s: list, t1s: list, t0s: list, samples: list[Totals]):
        self.words, self.samples = dishes.words, samples
        self.pairs = dishes.pair_word.astype(np.int64) << 9 | dishes.pair_code
        self.types = dishes.word.astype(np.int64) << 21 | dishes.codes
        self.counts = np.append(dishes.word_count, 0).astype(np.int64)
        less = lambda c, d, t: np.append(c - d * t, 0.0)
        self.less = []
        for t2, t1, t0, all_ in zip(t2s, t1s, t0s, samples, strict=True):
            c1, c0 = dishes.up(t2, t1)
            self.less.append((less(c0, all_.d[0], t0), less(c1, all_.d[1], t1), less(dishes.counts, all_.d[2], t2)))


def predict(dishes: Dishes, t2s: list, t1s: list, t0s: list, samples: list[Totals], w: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean predictive probability of words after codes, and the words' counts."""
    return predicted(Seats(dishes, t2s, t1s, t0s, samples), w, code)


def predicted(seats: Seats, w: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same from a bucket that is laid out already."""

    def find(keys: np.ndarray, key: np.ndarray, may: np.ndarray | None = None) -> np.ndarray:
        if not len(keys):
            return np.zeros(len(key), np.int64)
        k = np.searchsorted(keys, key)
        hit = keys[np.minimum(k, len(keys) - 1)] == key
        return np.where(hit if may is None else hit & may, k, len(keys))

    at = find(seats.words, w)
    known = at < len(seats.words)
    pair = find(seats.pairs, at << 9 | code >> SLOT, known)
    type_ = find(seats.types, at << 21 | code, known)
    mean = np.zeros(len(w))
    customers = seats.samples[0].c2[code] if seats.samples else None  # one array for all seatings
    for (zero, one, two), all_ in zip(seats.less, seats.samples, strict=True):
        p = (zero[at] + (all_.th[0] + all_.d[0] * all_.t0) / (all_.v + 1)) / (all_.th[0] + all_.c0)
        own = code >> SLOT
        p = (one[pair] + (all_.th[1] + all_.d[1] * all_.t1)[own] * p) / (all_.th[1] + all_.c1)[own]
        p = (two[type_] + (all_.th[2] + all_.d[2] * all_.t2[code]) * p) / (all_.th[2] + customers)
        mean += p / len(seats.samples)
    return mean, seats.counts[at]


def _key(w: np.ndarray, code: np.ndarray) -> np.ndarray:
    return mix(w + code.astype(np.uint64) * _GOLD)


def head(states: DataFrame, samples: list[Totals], most: int = HEAD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, log10 probabilities and word counts of the most frequent pairs: those of at least the least power of two that leaves at most most."""
    sizes = states.agg(*[F.sum(F.get("large", F.lit(k))) for k in range(48)]).first()
    power = next((k for k, x in enumerate(sizes) if (x or 0) <= most), 48)
    shared = states.sparkSession.sparkContext.broadcast(samples)

    def part(batches):
        for batch in batches:
            for r in batch.to_pylist():
                dishes, *tables = _open(r)
                often = dishes.counts >= 1 << power
                w, code = dishes.words[dishes.word[often]], dishes.codes[often]
                p, c = predict(dishes, *tables, shared.value, w, code)
                yield pa.RecordBatch.from_arrays([pa.array(_key(w, code).view(np.int64)), pa.array(np.log10(p)), pa.array(c)], names=["key", "p", "c"])

    rows = states.mapInArrow(part, "key long, p double, c long").toArrow()  # most rows at most
    shared.destroy()
    key = rows["key"].to_numpy().view(np.uint64)
    order = np.argsort(key)
    return key[order], rows["p"].to_numpy()[order], rows["c"].to_numpy()[order]


def starts(keys: np.ndarray) -> np.ndarray:
    """For each value of the first bits of a key, where keys of it begin in the sorted keys."""
    return np.searchsorted(keys, np.arange(1 << FIRST, dtype=np.uint64) << np.uint64(64 - FIRST)).astype(np.int32)


def lookup(keys: np.ndarray, begin: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key would stand in keys (at most the last place), and whether it does. Keys are hashes, so few share their first bits."""
    if not len(keys):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    last = len(keys) - 1
    at = np.minimum(begin[key >> np.uint64(64 - FIRST)], last)
    found = keys[at]
    more = np.flatnonzero((found < key) & (at < last))
    while len(more):
        at[more] += 1
        found[more] = keys[at[more]]
        more = more[(found[more] < key[more]) & (at[more] < last)]
    return at, found == key


def score(docs: DataFrame, states: DataFrame, samples: list[Totals], n: int, buckets: int) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of every row."""
    spark = docs.sparkSession
    top = spark.sparkContext.broadcast(head(states, samples))
    shared = spark.sparkContext.broadcast(samples)
    norm = float(np.log10(n + 0.5 * (samples[0].v + 1)))
    sent = "bucket int, kind int, chunk long, ids binary, n binary, known binary, base binary, model binary, w binary, code binary, text binary, words binary, runs binary, codes binary, counts binary, t2 array<binary>, t1 array<binary>, t0 array<binary>"
    fields = [x.split(" ")[0] for x in sent.split(", ")]
    row = lambda **k: tuple(k.get(f) for f in fields)

    def places(batches):
        keys, probabilities, counts = top.value
        begin = starts(keys)
        chunk = TaskContext.get().partitionId() << 28
        for batch in batches:
            for lo, hi in pieces(batch.column(1), 8 * PIECE):
                texts = batch.column(1).slice(lo, hi - lo)
                w, code, count_ = tokens(texts)
                text = np.repeat(np.arange(len(count_)), count_)
                key = _key(w, code)
                at, hit = lookup(keys, begin, key)
                sums = [np.bincount(text[hit], weights=x, minlength=len(count_)) for x in (counts[at[hit]] > 0, np.log10(counts[at[hit]] + 0.5), probabilities[at[hit]])]
                ids = batch.column(0).slice(lo, hi - lo)
                numbers = ids.fill_null(0).to_numpy()
                rows = [row(bucket=int(chunk % buckets), kind=2, chunk=chunk, ids=_pack(numbers), n=_pack(count_), known=_pack(sums[0]), base=_pack(sums[1]), model=_pack(sums[2]), code=_pack(ids.is_null().to_numpy(zero_copy_only=False)))]
                w, code, text = w[~hit], code[~hit], text[~hit].astype(np.int32)
                bucket = _bucket(w, buckets)
                order = np.argsort(bucket, kind="stable")
                w, code, text, bucket = w[order], code[order], text[order], bucket[order]
                edges = np.searchsorted(bucket, np.arange(buckets + 1))
                rows += [row(bucket=b, kind=1, chunk=chunk, w=_pack(w[x:y]), code=_pack(code[x:y]), text=_pack(text[x:y])) for b, (x, y) in enumerate(zip(edges[:-1], edges[1:], strict=True)) if y > x]
                chunk += 1
                yield _batch(rows, sent)

    back = "chunk long, ids binary, n binary, known binary, base binary, model binary, text binary, nulls binary"

    def answer(batches):
        for table in whole_groups(batches):
            state = None
            for r in table.to_pylist():
                if r["kind"] == 0:
                    state = (r["bucket"], Seats(*_open(r), shared.value))
                elif r["kind"] == 2:
                    yield _batch([(r["chunk"], r["ids"], r["n"], r["known"], r["base"], r["model"], None, r["code"])], back)
                else:
                    if state is None or state[0] != r["bucket"]:
                        none = np.zeros(0, np.int64)
                        state = (r["bucket"], Seats(Dishes(none.astype(np.uint64), none, none, none), *[[none] * len(shared.value)] * 3, shared.value))
                    p, c = predicted(state[1], _unpack(r["w"], np.uint64), _unpack(r["code"], np.int32).astype(np.int64))
                    yield _batch([(r["chunk"], None, None, _pack(c), None, _pack(np.log10(p).astype(np.float32)), r["text"], None)], back)

    def total(batches):
        for table in whole_groups(batches):
            chunks = table["chunk"].to_numpy()
            edges = np.concatenate((np.flatnonzero(np.concatenate(([True], chunks[1:] != chunks[:-1]))), [len(chunks)]))
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                rows = table.slice(lo, hi - lo).to_pylist()
                own = next(r for r in rows if r["ids"] is not None)
                count_ = _unpack(own["n"], np.int64)
                known, base, model = (_unpack(own[k], np.float64).copy() for k in ("known", "base", "model"))
                for r in rows:
                    if r["ids"] is None:
                        text, c = _unpack(r["text"], np.int32), _unpack(r["known"], np.int64)
                        known += np.bincount(text, weights=c > 0, minlength=len(known))
                        base += np.bincount(text, weights=np.log10(c + 0.5), minlength=len(known))
                        model += np.bincount(text, weights=_unpack(r["model"], np.float32), minlength=len(known))
                ids = pa.array(_unpack(own["ids"], np.int64), mask=_unpack(own["nulls"], bool))
                yield pa.RecordBatch.from_arrays([ids, pa.array(count_), pa.array(known.astype(np.int64)), pa.array(base - count_ * norm), pa.array(model)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    found = _rows(docs).mapInArrow(places, sent)
    kept = [f for f in ("words", "runs", "codes", "counts", "t2", "t1", "t0")]
    types = dict(x.split(" ", 1) for x in sent.split(", "))
    seats = states.select(*[F.col(f) if f in ("bucket", *kept) else F.lit(0 if f == "kind" else None).cast(types[f]).alias(f) for f in fields])
    dealt = found.unionByName(seats).repartition("bucket").sortWithinPartitions("bucket", "kind").mapInArrow(answer, back)
    return dealt.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(total, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def learn(docs: DataFrame, burn: int = BURN, samples: int = SAMPLES) -> tuple[DataFrame, list[Totals], int, int]:
    """The kept seatings with their totals, the number of training tokens, and of buckets."""
    ship(docs.sparkSession)
    buckets = 2 * shuffle_partitions(docs.sparkSession)
    states = seat(count(docs.where(trains()), buckets))
    now, n = totals(states)
    kept: list[Totals] = []
    for k in range(burn + samples):
        new = sweep(states, now, k, add=k > burn)
        remove(docs.sparkSession, table_path(states)) if states.inputFiles() else None
        states = new
        now, _ = totals(states, now, k + 1)
        if k >= burn:
            kept.append(now)
    return states, kept, n, buckets


def language_model(docs: DataFrame, burn: int = BURN, samples: int = SAMPLES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of docs."""
    states, kept, n, buckets = learn(docs, burn, samples)
    scored = score(docs, states, kept, n, buckets)
    held = ~trains()
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
