"""Words of Arrow string batches as numpy arrays: no Python object for each word.

Words are runs of bytes other than space and 0x09-0x0D; A-Z are lower-cased. UTF-8 keeps both exact,
since bytes below 0x80 only stand for themselves. A word is known by a 64-bit hash of all its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
_C1, _C2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a word that are hashed by lanes over all words at once; what follows is hashed word by word.
LANE_BYTES = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _C1
    x ^= x >> np.uint64(27)
    x *= _C2
    x ^= x >> np.uint64(31)
    return x


class Words:
    """data: lower-cased bytes (padded); starts, ends: of each word; first: of each text its first word, with one end entry."""

    __slots__ = ("data", "starts", "ends", "first", "_hash")

    def __init__(self, texts: pa.Array | pa.ChunkedArray):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], texts.type)
        texts = texts.fill_null("").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        n = hi - lo
        data = np.zeros(n + 16, dtype=np.uint8)
        data[n:] = 0x20
        if n:
            np.take(_LOWER, np.frombuffer(texts.buffers()[2], dtype=np.uint8)[lo:hi], out=data[:n])
        offsets = offsets - lo
        word = np.zeros(n + 2, dtype=bool)  # one place before and one after
        np.logical_not(_SPACE[data[:n]], out=word[1 : n + 1])
        cut = np.zeros(n + 1, dtype=bool)
        cut[offsets] = True
        self.data = data
        self.starts = np.flatnonzero(word[1:-1] & (~word[:-2] | cut[:-1]))
        self.ends = np.flatnonzero(word[1:-1] & (~word[2:] | cut[1:])) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self._hash = None

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def hash(self) -> np.ndarray:
        if self._hash is None:
            self._hash = hash_spans(self.data, self.starts, self.ends)
        return self._hash

    def word(self, k: int) -> bytes:
        return self.data[self.starts[k] : self.ends[k]].tobytes()


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[starts[i]:ends[i]]; data needs 8 bytes beyond the last end."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    lanes = np.ndarray((len(data) - 7,), "<u8", buffer=data, strides=(1,))
    size = ends - starts
    h = mix((lanes[starts] & _MASK[np.minimum(size, 8)]) + size.astype(np.uint64) * _GOLD)
    at, more = 8, np.flatnonzero(size > 8)
    while len(more) and at < LANE_BYTES:
        left = size[more] - at
        h[more] = mix((h[more] ^ (lanes[starts[more] + at] & _MASK[np.minimum(left, 8)])) * _GOLD)
        at += 8
        more = more[left > 8]
    for k in more:
        h[k] ^= np.uint64(xxhash.xxh64_intdigest(data[starts[k] + at : ends[k]].tobytes()))
    return h


def shingles(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word runs of each text, and the number in each; a text of 1 to n - 1 words has one, of all its words."""
    h, first = words.hash, words.first
    count = np.diff(first)
    runs = np.where(count >= n, count - n + 1, np.minimum(count, 1))
    at = np.repeat(first[:-1] - np.concatenate(([0], np.cumsum(runs)[:-1])), runs) + np.arange(runs.sum())
    length = np.minimum(np.repeat(count, runs), n)
    weights = mix(np.arange(1, n + 1, dtype=np.uint64) * _GOLD) | np.uint64(1)
    out = length.astype(np.uint64) * _GOLD
    padded = np.concatenate((h, np.zeros(n, np.uint64)))
    for k in range(n):
        part = padded[at + k] * weights[k]
        if k:
            part[length <= k] = 0
        out += part
    return mix(out), runs


def shown(texts: list[str | None]) -> list[list[bytes]]:
    """The words of each text, for tests."""
    w = Words(pa.array(texts, pa.string()))
    return [[w.word(k) for k in range(a, b)] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
