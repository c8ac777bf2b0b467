"""Byte-level BPE: DuckDB recursive queries on each partition encode, ordered aggregation decodes.

A text is cut by the tokenizer's pattern (cut() does this for whole batches, character class by character
class). Each distinct word becomes token-position rows that join the merge table; each step of a recursive query
contracts the leftmost pair of least rank of every word, until no word has a pair left. A word that is itself in
the vocabulary is that one token, as in the tiktoken library. Decoding joins the ids with the vocabulary and
aggregates the bytes in the order of the positions.

Encoded words stay in a direct-mapped table of bounded size on each Python worker (SLOTS words), by 64-bit hash,
so that a frequent word meets DuckDB once a worker. A recursion keeps the rows of all its steps, about half the square
of a word's bytes, so a query gets as many words as make WORK rows. Words of more than LONG bytes go through a heap
that does the same contractions, since a recursion would read the whole word again for every merge. Nothing is
shuffled; memory is bounded by PIECE bytes of text, DuckDB's limit, the table, and some 70 bytes for each byte of the
longest word. A text of more than PIECE bytes is cut where a match must start, whatever stands around, and
decoding takes RUN ids at a time.

Null texts are empty; an empty text has no tokens and decodes to no bytes; an empty table gives an empty result. Rows
without a doc_id are encoded like others. Texts that look like special tokens are plain text. Extra columns take no
part, whatever their names. Every row of the input gives one row, repeated or not.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import unicodedata
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import ship, trim
from .toxicity import pieces
from .wordbytes import hash_spans

#: Longest word that the recursive query gets, in bytes.
LONG = 256
#: Words that a worker remembers.
SLOTS = 1 << 19
#: Rows that the steps of one recursive query may make.
WORK = 2_000_000
PIECE = 2 << 20
#: Ids decoded by one query.
RUN = 1 << 19
DUCKDB_MB = 200
_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 0
#: Places where a match starts whatever stands further away: a single blank within text, what follows a line's end, a word after punctuation.
_APART = re.compile(r"(?<=\S) (?=\S)|(?<=\n)(?=\S)|(?<=[.,;:!?\u3001\u3002\uff01\uff0c\uff1f])(?=[^\W\d_])")

ENCODE = """
WITH RECURSIVE bpe(word, pos, tok, npos, ntok, step) AS (
  SELECT word, pos, tok, npos, ntok, 0 FROM start
  UNION ALL
  (WITH best AS (
     SELECT a.word, min(m.merged * 4294967296 + a.pos::BIGINT * 65536 + a.npos) AS b
     FROM bpe a JOIN merges m ON m.pair = a.tok::BIGINT * 65536 + a.ntok GROUP BY a.word)
   SELECT s.word, s.pos,
     CASE WHEN s.pos = (b >> 16) & 65535 THEN (b >> 32)::INTEGER ELSE s.tok END,
     CASE WHEN s.pos = (b >> 16) & 65535 THEN r.npos ELSE s.npos END,
     CASE WHEN s.pos = (b >> 16) & 65535 THEN r.ntok WHEN s.npos = (b >> 16) & 65535 THEN (b >> 32)::INTEGER ELSE s.ntok END,
     s.step + 1
   FROM bpe s JOIN best USING (word)
   LEFT JOIN bpe r ON r.word = s.word AND r.pos = b & 65535 AND s.pos = (b >> 16) & 65535
   WHERE s.pos <> b & 65535))
SELECT b.word, list(b.tok ORDER BY b.pos) AS toks
FROM bpe b JOIN (SELECT word, max(step) AS step FROM bpe GROUP BY word) USING (word, step) GROUP BY b.word ORDER BY b.word
"""

DECODE = """
SELECT doc, string_agg(hex, '' ORDER BY pos) AS hex FROM ids JOIN vocab USING (tok) GROUP BY doc ORDER BY doc
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """The ranks of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f) if a}


def character_classes() -> np.ndarray:
    """Of every code point: letter, number, white space (Unicode's property) or other."""
    out = np.zeros(0x110000, np.uint8)
    for c in range(0x110000):
        kind = unicodedata.category(chr(c))[0]
        out[c] = _LETTER if kind == "L" else _NUMBER if kind == "N" else _OTHER
    for c in (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        out[c] = _SPACE
    return out


def cut(text: bytes, edges: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Byte places where the pattern's matches start, in texts laid end to end that start at edges."""
    points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), "<u4")
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    raw = np.frombuffer(text, np.uint8)
    place = np.flatnonzero((raw & 0xC0) != 0x80)
    kind = classes[points]
    head = np.zeros(n + 1, bool)
    head[np.searchsorted(place, edges)] = True
    head[n] = True
    first = head[:n]
    start = first.copy()
    start[1:] |= kind[1:] != kind[:-1]
    space = kind == _SPACE
    # the last of a run of white space, before something else: apart, or at the head of what follows
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~head[1:n]) if n > 1 else np.zeros(0, int)
    start[last] = True
    start[last[points[last] == 0x20] + 1] = False
    quotes = np.flatnonzero(points == 0x27)
    if len(quotes):
        before = np.where(first[quotes], 0x0A, points[quotes - 1])
        opens = first[quotes] | ((kind[quotes - 1] != _OTHER) & (before != 0x20))
        ahead = np.concatenate((points, np.zeros(3, "<u4")))
        stop = np.concatenate((head, np.ones(3, bool)))
        one, two = np.where(stop[quotes + 1], 0, ahead[quotes + 1]), np.where(stop[quotes + 1] | stop[quotes + 2], 0, ahead[quotes + 2])
        short = np.isin(one, [115, 116, 109, 100])  # 's 't 'm 'd
        wide = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)  # 're 've 'll
        hit = opens & (short | wide)
        at, wide = quotes[hit], wide[hit]
        start[at] = True
        start[at + 1] = False
        start[(at + 2)[wide]] = False
        end = at + 2 + wide
        start[end[end < n]] = True
        # a blank just after cannot be lost: it starts its own match by class
    return place[start]


def heap_encode(word: bytes, byte: np.ndarray, merges: dict[int, int]) -> array:
    """The same contractions by a heap, for long words. byte: ids of single bytes; merges: of two ids (first * 65536 + second) the merged one."""
    n = len(word)
    tok = array("i", byte[np.frombuffer(word, np.uint8)].tobytes())
    left, right = array("i", range(-1, n - 1)), array("i", range(1, n + 1))
    heap = [r << 32 | k for k in range(n - 1) if (r := merges.get(tok[k] << 16 | tok[k + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        best = heapq.heappop(heap)
        k = best & 0xFFFFFFFF
        after = right[k]
        if tok[k] < 0 or after >= n or merges.get(tok[k] << 16 | tok[after]) != best >> 32:
            continue
        tok[k], tok[after] = best >> 32, -1
        right[k] = right[after]
        if right[k] < n:
            left[right[k]] = k
        for i, j in ((left[k], k), (k, right[k])):
            if i >= 0 and j < n and (r := merges.get(tok[i] << 16 | tok[j])) is not None:
                heapq.heappush(heap, r << 32 | i)
    return array("i", (t for t in tok if t >= 0))


def slices(text: str, size: int) -> list[str]:
    """A text in parts of about size characters whose matches are those of the whole."""
    out, at = [], 0
    while len(text) - at > size and (m := _APART.search(text, at + size)):
        out.append(text[at : m.start()])
        at = m.start()
    return [*out, text[at:]]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices starts[i], starts[i] + 1, ... of sizes[i] places each, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Codec:
    """Encoder and decoder of one Python worker."""

    def __init__(self, ranks: dict[bytes, int], classes: np.ndarray, slots: int = SLOTS):
        import duckdb

        self.ranks, self.classes = ranks, classes
        pairs = [(ranks[t[:k]] * 65536 + ranks[t[k:]], r) for t, r in ranks.items() for k in range(1, len(t)) if t[:k] in ranks and t[k:] in ranks]
        merges = np.array(pairs, np.int64).reshape(-1, 2)
        self.merges = dict(pairs)
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        top = max(ranks.values()) + 1
        by_id = [b""] * top
        for t, r in ranks.items():
            by_id[r] = t
        self.digits = np.frombuffer("".join(f"{k}," for k in range(top)).encode(), np.uint8)
        self.digit_size = np.array([len(str(k)) + 1 for k in range(top)], np.int64)
        self.digit_at = np.cumsum(self.digit_size) - self.digit_size
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{DUCKDB_MB}MB", "temp_directory": "", "preserve_insertion_order": False})
        self._table("merges", pair=merges[:, 0], merged=merges[:, 1])
        self._table("vocab", tok=np.arange(top, dtype=np.int32), hex=pa.array([t.hex() for t in by_id]))
        self.mask = np.uint64(slots - 1)
        self.known = np.zeros(slots, np.uint64)
        self.at = np.zeros(slots, np.int64)
        self.size = np.zeros(slots, np.int32)
        self._empty()

    def _table(self, name: str, **columns) -> None:
        self.db.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _empty(self) -> None:
        self.known[:] = 0
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _keep(self, ids: np.ndarray) -> int:
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros(max(len(self.pool), len(ids)), np.int32)))
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return self.used - len(ids)

    def words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and how many each has."""
        out: list = [None] * len(words)
        rest = []
        for k, w in enumerate(words):
            if (r := self.ranks.get(w)) is not None:
                out[k] = [r]
            elif len(w) > LONG:
                out[k] = np.frombuffer(heap_encode(w, self.byte, self.merges), np.int32)
            else:
                rest.append(k)
        work = np.cumsum([len(words[k]) * (len(words[k]) + 1) // 2 for k in rest]) // WORK
        for lo, hi in zip(edges := [0, *(np.flatnonzero(np.diff(work)) + 1).tolist()], [*edges[1:], len(rest)], strict=True) if rest else ():
            self._recurse(words, rest[lo:hi], out)
        counts = np.array([len(x) for x in out], np.int64)
        return (np.concatenate(out).astype(np.int32) if out else np.zeros(0, np.int32)), counts

    def _recurse(self, words: list[bytes], rest: list[int], out: list) -> None:
        """Encode words[k] for k in rest, by one recursive query."""
        size = np.array([len(words[k]) for k in rest], np.int64)
        ends = np.cumsum(size)
        pos = (np.arange(ends[-1]) - np.repeat(ends - size, size)).astype(np.int32)
        tok = self.byte[np.frombuffer(b"".join([words[k] for k in rest]), np.uint8)]
        following = np.append(tok[1:], -1)
        following[ends - 1] = -1
        self._table("start", word=np.repeat(np.arange(len(rest), dtype=np.int32), size), pos=pos, tok=tok, npos=pos + 1, ntok=following)
        found = self.db.sql(ENCODE).to_arrow_table()["toks"].combine_chunks()
        offsets = found.offsets.to_numpy()
        values = found.values.to_numpy(zero_copy_only=False)
        for j, k in enumerate(rest):
            out[k] = values[offsets[j] : offsets[j + 1]]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and how many each text has."""
        if len(texts) == 1 and len(text := texts[0].as_py() or "") > PIECE:
            found = [self._encode(pa.array([x]))[0] for x in slices(text, PIECE // 2)]
            return np.concatenate(found), np.array([sum(map(len, found))], np.int64)
        return self._encode(texts)

    def _encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        raw = texts.buffers()[2]
        text = raw.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).to_pybytes() if raw is not None and offsets[-1] > offsets[0] else b""
        offsets = offsets - offsets[0]
        starts = cut(text, offsets[:-1][offsets[:-1] < len(text)], self.classes)
        ends = np.append(starts[1:], len(text)) if len(starts) else starts
        h = hash_spans(np.frombuffer(text + b"\0" * 16, np.uint8), starts, ends) | np.uint64(1)
        if self.used > 16 * len(self.known):
            self._empty()
        slot = (h >> np.uint64(1)) & self.mask
        hit = self.known[slot] == h
        miss = np.flatnonzero(~hit)
        new, which, back = np.unique(h[miss], return_index=True, return_inverse=True)
        ids, sizes = self.words([text[starts[k] : ends[k]] for k in miss[which]])
        base = self._keep(ids)
        at, size = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        at[hit], size[hit] = self.at[slot[hit]], self.size[slot[hit]]
        new_at = base + np.cumsum(sizes) - sizes
        at[miss], size[miss] = new_at[back], sizes[back]
        place = (new >> np.uint64(1)) & self.mask
        self.known[place], self.at[place], self.size[place] = new, new_at, sizes
        # two new words of one slot: the last one written holds all three fields
        all_ids = self.pool[_spread(at, size)]
        run = np.concatenate(([0], np.cumsum(size)))
        edge = run[np.searchsorted(starts, offsets)]
        return all_ids, np.diff(edge)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The bytes of each text."""
        doc = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        out = [b""] * len(counts)
        for lo in range(0, len(ids), RUN):
            some = slice(lo, lo + RUN)
            self.db.register("ids", pa.table({"doc": doc[some], "pos": np.arange(len(doc[some]), dtype=np.int32), "tok": ids[some].astype(np.int32)}))
            found = self.db.sql(DECODE).to_arrow_table()
            self.db.unregister("ids")
            for k, x in zip(found["doc"].to_pylist(), found["hex"].to_pylist(), strict=True):
                out[k] += bytes.fromhex(x)
        return out

    def decimals(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The ids of each text in decimal, joined by commas."""
        size = self.digit_size[ids]
        text = self.digits[_spread(self.digit_at[ids], size)].tobytes()
        edges = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(counts)))]
        return [text[a : max(a, b - 1)] for a, b in zip(edges[:-1], edges[1:], strict=True)]


_CODEC: dict[str, Codec] = {}


def _codec(key: str, shared) -> Codec:
    if key not in _CODEC:
        _CODEC.clear()
        _CODEC[key] = Codec(*shared.value)
    return _CODEC[key]


def _mapped(docs: DataFrame, path: str, work, schema: str) -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast((read_ranks(path), character_classes()))
    key = f"{spark.sparkContext.applicationId}:{path}"
    names = [c.split()[0] for c in schema.split(", ")]

    def part(batches):
        codec = None
        for batch in batches:
            codec = codec or _codec(key, shared)
            for lo, hi in pieces(batch.column(1), PIECE):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), *work(codec, batch.column(1).slice(lo, hi - lo))], names=names)
        trim()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(part, schema)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every row of docs."""

    def work(codec: Codec, texts: pa.Array):
        ids, counts = codec.encode(texts)
        return [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), pa.array(ids))]

    return _mapped(docs, path, work, "doc_id long, ids array<int>")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """n_tokens, ids_sha256 and decoded_sha256 of every row of docs."""

    def work(codec: Codec, texts: pa.Array):
        ids, counts = codec.encode(texts)
        return [
            pa.array(counts, pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in codec.decimals(ids, counts)], pa.string()),
            pa.array([hashlib.sha256(x).hexdigest() for x in codec.decode(ids, counts)], pa.string()),
        ]

    return _mapped(docs, path, work, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
