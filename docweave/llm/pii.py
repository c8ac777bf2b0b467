"""Personal data: fixed patterns first, then a semi-Markov conditional random field for what they miss.

A text is cut into tokens; a segment is an entity of 1 to LONGEST tokens or a single other token. Whole segments
are scored by features of their full extent (shape, length, digits, first and last token, words before), and
bounded-entity dynamic programming finds the best segmentation: boundaries and types are chosen together. The
score of a segmentation is the sum of its segments', and its probability the share of exp(score) in that of all
segmentations, which the forward recursion sums.

An entity must start and end with a token that could belong to one and hold either an address sign (@, or "at" in
brackets) or four digits without letters; a token that could not is always alone. So every entity lies in a window around
such a place, which reaches LONGEST tokens to either side of a sign and to the end of what is neither letter nor
digit around digits, and the program decomposes exactly: only windows are decoded.

The field is trained by the gradient of the conditional log likelihood (forward-backward over segments, Adagrad in numpy)
on the windows of at most MAX_TRAIN documents of up to TRAIN_BYTES bytes (by hash of the id) with digits or an @, at
most MAX_CASES windows. Base matches are the labels there, and written-out variants of them (spaces in cards, "[at]" and
"[dot]" in addresses, phones without plus), so that it finds forms that the patterns miss. Spans that it adds never
overlap base spans, and base spans all stay.

Null texts are empty; empty texts have no spans. Rows without a doc_id are scanned but not learned from; an empty table
gives an empty result; extra columns take no part. Each row gives one row. Texts are read whole.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import by_hash, ship

# The kinds, their order and their patterns.
KINDS = ("email", "ip", "card", "phone")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
#: A match can only start where a run of digits does, which the look-behind says to keep long runs linear.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOCAL_SET = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

#: At most so many documents are learned from.
MAX_TRAIN = 2000
#: Of those only texts up to so many bytes, and at most so many windows.
TRAIN_BYTES, MAX_CASES = 1 << 16, 20_000
LONGEST = 20
EPOCHS, BATCH, RATE, DECAY = 8, 16, 0.3, 1e-4
#: An added span needs so much more than the best reading without it.
MARGIN = 0.0


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def _octet(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or "0") <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+, found from their @."""
    out, floor, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_SET:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, m.end()))
            floor = m.end()
            at = text.find("@", floor)
        else:
            at = text.find("@", at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of all base matches that stay, by kind and then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    out += [(1, m.start(), m.end()) for m in _IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d):
            out.append((2, m.start(), m.end()))
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return out


_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
#: Where an entity could be: an address sign, or four digits with nothing but punctuation and blanks between.
_SIGN = re.compile(r"@|[\[({]\x20?at\x20?[\])}]", re.IGNORECASE)
_DIGITS = re.compile(r"[0-9](?:[@.+()\[\]{}%_:/\s-]*[0-9]){3,}")
_BETWEEN = frozenset("0123456789@.+()[]{}%_:/-")
_AHEAD = re.compile(r"(?:(?:[0-9]+|[^\W\d_]+|\S)\s*){0,20}")
_CUES = frozenset(("at", "dot", "tel", "phone", "call", "card", "ip", "mail", "email", "fax"))
_PUNCT = frozenset("@.+-()[]{}%_:/")


def _back(text: str, at: int, count: int) -> int:
    """Where the count-th token before a place starts."""
    reach = 8 * count
    while True:
        lo = max(0, at - reach)
        found = [m.start() for m in _TOKEN.finditer(text, lo, at)]
        if lo == 0 or len(found) > count:  # the first one may be cut
            return found[-count] if len(found) >= count else 0
        reach *= 2


def windows(text: str) -> list[tuple[int, int]]:
    """Pieces of the text that hold every possible entity and the token before it; pieces that touch are one."""
    out = []
    for m in _SIGN.finditer(text) if "@" in text or "at" in text or "AT" in text or "At" in text or "aT" in text else ():
        out.append((_back(text, m.start(), LONGEST + 1), _AHEAD.match(text, m.start()).end()))
    for m in _DIGITS.finditer(text):
        a, b = m.span()
        while a > 0 and (text[a - 1] in _BETWEEN or text[a - 1].isspace()):
            a -= 1
        while b < len(text) and (text[b] in _BETWEEN or text[b].isspace()):
            b += 1
        out.append((_back(text, a, 1), b))
    fixed: list[tuple[int, int]] = []
    for a, b in sorted(out):
        if fixed and a <= fixed[-1][1]:
            fixed[-1] = (fixed[-1][0], max(b, fixed[-1][1]))
        else:
            fixed.append((a, b))
    return fixed


def _able(token: str) -> bool:
    return token[0] in "0123456789" or token in _PUNCT or token.lower() in _CUES or token.isascii() and token.isalpha()


def _edge(token: str) -> bool:
    return token[0] in "0123456789" or token == "+" or token == "(" or token.isascii() and token.isalpha()


def candidates(text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Token ranges that may be entities, by end and then start."""
    words = [text[a:b] for a, b in tokens]
    able, edge = [_able(w) for w in words], [_edge(w) for w in words]
    digits, signs, letters = [0], [0], [0]
    for k, w in enumerate(words):
        digits.append(digits[-1] + (len(w) if w[0] in "0123456789" else 0))
        signs.append(signs[-1] + (w == "@" or w.lower() == "at" and k > 0 and words[k - 1] in "[({"))
        letters.append(letters[-1] + w[0].isalpha())
    out, last = [], -1  # the last token that can be in no entity
    for j in range(1, len(words) + 1):
        if not able[j - 1]:
            last = j - 1
        elif edge[j - 1]:
            for i in range(max(last + 1, j - LONGEST), j):
                if edge[i] and (signs[j] > signs[i] or digits[j] - digits[i] >= 4 and letters[j] == letters[i]):
                    out.append((i, j))
    return out


def segment_features(text: str, tokens: list[tuple[int, int]], i: int, j: int) -> list[str]:
    """Of the segment of tokens i to j - 1, as a whole."""
    a, b = tokens[i][0], tokens[j - 1][1]
    body = text[a:b]
    digits = re.sub("[^0-9]", "", body)
    shape = re.sub(r"(.)\1+", r"\1+", re.sub(r"\s", "_", re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "9", body))))
    kinds = "".join(sorted(set(re.sub(r"[^\W\d_]", "a", re.sub("[0-9]", "9", re.sub(r"\s", "_", body))))))
    low = body.lower()
    before = text[tokens[i - 1][0] : tokens[i - 1][1]].lower() if i else "^"
    out = [f"n{min(len(digits), 20)}", f"k{kinds}", f"s{shape[:24]}", f"l{j - i}", f"b{before if before in _CUES or before in _PUNCT else '*'}", f"gap{before != '^' and text[a - 1].isspace()}"]
    if len(digits) >= 13:
        out.append(f"luhn{luhn(digits)}{16 <= len(digits) <= 19}")
    if "@" in body or "at" in low:
        out.append(f"at{body.count('@')}{len(re.findall(r'[\[({] ?at ?[\])}]', low))}.{min(2, body.count('.') + len(re.findall(r'[\[({] ?dot ?[\])}]', low)))}")
        out.append(f"ends{low.rsplit('.', 1)[-1].isalpha()}{' ' in re.sub(r' ?[\[({] ?(at|dot) ?[\])}] ?', '', low)}")
    if body.count(".") == 3:
        parts = body.split(".")
        out.append(f"quad{all(p.isdigit() and int(p) < 256 for p in parts)}")
    return out


def forward(n: int, spans: list[tuple[int, int]], score: list[float]) -> list[float]:
    """Logarithms of the sums over all segmentations of the first 0 to n tokens; spans by end, each with its log weight."""
    alpha, at = [0.0] * (n + 1), 0
    for j in range(1, n + 1):
        terms = [alpha[j - 1]]
        while at < len(spans) and spans[at][1] == j:
            terms.append(alpha[spans[at][0]] + score[at])
            at += 1
        top = max(terms)
        alpha[j] = terms[0] if len(terms) == 1 else top + math.log(sum(math.exp(x - top) for x in terms))
    return alpha


def backward(n: int, spans: list[tuple[int, int]], score: list[float]) -> list[float]:
    """The same of the tokens from each place on."""
    turned = sorted(((n - j, n - i, k) for k, (i, j) in enumerate(spans)), key=lambda s: (s[1], s[0]))
    return forward(n, [(i, j) for i, j, _ in turned], [score[k] for *_, k in turned])[::-1]


class Field:
    """Weights of (kind, feature) and the decoder; a single other token has score 0."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    def scores(self, features: list[str]) -> np.ndarray:
        total = np.zeros(len(KINDS))
        for f in features:
            if (w := self.weights.get(f)) is not None:
                total += w
        return total

    def decode(self, text: str, tokens: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
        """(kind, first token, end token) of the best segmentation's entities."""
        n, spans, at = len(tokens), candidates(text, tokens), 0
        best, back = [0.0] * (n + 1), [(-1, 0)] * (n + 1)
        for j in range(1, n + 1):
            best[j], back[j] = best[j - 1], (-1, j - 1)
            while at < len(spans) and spans[at][1] == j:
                i = spans[at][0]
                s = self.scores(segment_features(text, tokens, i, j))
                k = int(s.argmax())
                if s[k] > MARGIN and best[i] + s[k] > best[j]:
                    best[j], back[j] = best[i] + float(s[k]), (k, i)
                at += 1
        out, j = [], n
        while j:
            k, i = back[j]
            if k >= 0:
                out.append((k, i, j))
            j = i
        return out[::-1]


def tokenise(text: str, a: int, b: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, a, b)]


def _gold(tokens: list[tuple[int, int]], spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Entities as token ranges; spans that do not fit the tokens or overlap an earlier one are left out."""
    start, end = {a: i for i, (a, _) in enumerate(tokens)}, {b: i + 1 for i, (_, b) in enumerate(tokens)}
    out, floor = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a in start and b in end and start[a] >= floor and end[b] - start[a] <= LONGEST:
            out.append((k, start[a], end[b]))
            floor = end[b]
    return out


def variants(text: str, spans: list[tuple[int, int, int]], draw: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """The text with its entities written in other ways, and where they are then."""
    out, at, found = [], 0, []
    size = 0
    for k, a, b in sorted(spans, key=lambda s: s[1]):
        if a < at:
            continue
        body = text[a:b]
        if k == 0:
            body = draw.choice((body.replace("@", " [at] ").replace(".", " [dot] "), body.replace("@", "(at)"), body.replace("@", " (at) "), body.replace("@", " @ "), body))
        elif k == 2:
            digits = re.sub("[^0-9]", "", body)
            body = draw.choice((".".join(digits[i : i + 4] for i in range(0, len(digits), 4)), "  ".join(digits[i : i + 4] for i in range(0, len(digits), 4)), " ".join(digits[i : i + 4] for i in range(0, len(digits), 4)), body))
        elif k == 3:
            body = draw.choice((re.sub(r"^\+[0-9]+[ .-]?", "", body), body.replace("+", "00"), body))
        out += [text[at:a], body]
        size += a - at
        found.append((k, size, size + len(body)))
        size += len(body)
        at = b
    return "".join([*out, text[at:]]), found


class Case:
    """A window to learn from: its candidates with their features, and which of them are entities of which kind."""

    __slots__ = ("n", "spans", "owner", "feature", "gold")

    def __init__(self, text: str, tokens: list[tuple[int, int]], gold: list[tuple[int, int, int]], index: dict[str, int]):
        self.n, self.spans = len(tokens), candidates(text, tokens)
        features = [[index.setdefault(f, len(index)) for f in segment_features(text, tokens, i, j)] for i, j in self.spans]
        self.owner = np.repeat(np.arange(len(features)), [len(f) for f in features]).astype(np.int32)
        self.feature = np.array([f for fs in features for f in fs], np.int32)
        self.gold = np.zeros((len(self.spans), len(KINDS)), np.float32)
        place = {s: k for k, s in enumerate(self.spans)}
        for k, i, j in gold:
            if (i, j) in place:
                self.gold[place[i, j], k] = 1

    def scores(self, weights: np.ndarray) -> np.ndarray:
        return np.stack([np.bincount(self.owner, weights=weights[self.feature, k], minlength=len(self.spans)) for k in range(len(KINDS))], axis=1)

    def likelihood(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Log probability of the entities, and each candidate's probability to be an entity of each kind."""
        s = self.scores(weights)
        top = s.max(axis=1, initial=-np.inf, keepdims=True)
        whole = (top + np.log(np.exp(s - top).sum(axis=1, keepdims=True)))[:, 0]
        alpha, beta = (f(self.n, self.spans, whole.tolist()) for f in (forward, backward))
        i, j = (np.array([x[k] for x in self.spans], int) for k in (0, 1))
        inside = np.array(alpha)[i] + whole + np.array(beta)[j] - alpha[-1]
        return float((s * self.gold).sum() - alpha[-1]), np.exp(inside[:, None] + s - whole[:, None])


def train(texts: Iterable[str], seed: int = 5, max_cases: int = MAX_CASES) -> Field:
    """Conditional log likelihood of segmentations, by Adagrad; the base matches and their variants are the truth. Texts are read one by one."""
    draw, cases, index = random.Random(seed), [], {}
    for text in texts:
        spans = base_spans(text)
        for t, s in ((text, spans), variants(text, spans, draw)):
            for a, b in windows(t):
                tokens = tokenise(t, a, b)
                if tokens and len(cases) < max_cases:
                    case = Case(t, tokens, _gold(tokens, [x for x in s if a <= x[1] and x[2] <= b]), index)
                    cases.extend([case] if case.spans else [])
    weights = np.zeros((len(index), len(KINDS)))
    seen = np.full(weights.shape, 1e-8)
    for _ in range(EPOCHS):
        draw.shuffle(cases)
        for lo in range(0, len(cases), BATCH):
            some = cases[lo : lo + BATCH]
            used, where = np.unique(np.concatenate([c.feature for c in some]), return_inverse=True)
            gap = np.concatenate([(c.likelihood(weights)[1] - c.gold)[c.owner] for c in some])
            g = np.stack([np.bincount(where, weights=gap[:, k], minlength=len(used)) for k in range(len(KINDS))], axis=1) + DECAY * weights[used]
            seen[used] += g * g
            weights[used] -= RATE * g / np.sqrt(seen[used])
    return Field({f: weights[k] for f, k in index.items() if weights[k].any()})


def all_spans(text: str, field: Field) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each (kind, start, end) by kind and then start."""
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    added = []
    for a, b in windows(text):
        tokens = tokenise(text, a, b)
        for k, i, j in field.decode(text, tokens):
            lo, hi = tokens[i][0], tokens[j - 1][1]
            if not any(x < hi and lo < y for x, y in taken):
                added.append((k, lo, hi))
    return base, sorted(base + added)


def fit(docs: DataFrame, max_train: int = MAX_TRAIN) -> Field:
    """Train on at most max_train documents that hold digits or an @: with and without personal data."""
    docs = docs.select("doc_id", F.col("text").cast("string").alias("text")).where(F.octet_length("text") <= TRAIN_BYTES)
    rows = docs.where(F.col("doc_id").isNotNull() & F.col("text").rlike(r"[0-9]{2}|@"))
    # one document in sixteen may hold as much, at the least
    ids = by_hash(rows.select("doc_id"), max_train, docs.count() // 16, "doc_id").distinct()
    rows = docs.join(F.broadcast(ids), "doc_id").orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(max_train)
    return train(r["text"] for r in rows.toLocalIterator())


def find(docs: DataFrame, field: Field) -> DataFrame:
    """doc_id and the arrays base and spans of (kind, start, end) of every row."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(field.weights)
    span = "array<struct<kind:int,start:int,end:int>>"
    arrow = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def part(batches):
        own = Field(shared.value)
        for batch in batches:
            both = [all_spans(t or "", own) for t in batch.column(1).to_pylist()]
            lists = [pa.array([[dict(zip(("kind", "start", "end"), s, strict=True)) for s in x[k]] for x in both], arrow) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists], names=["doc_id", "base", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(part, f"doc_id long, base {span}, spans {span}")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the base kinds, hash of the base spans, and all spans."""
    names = F.array(*[F.lit(k) for k in KINDS])
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]  # noqa: B023
    return found.select("doc_id", *counts, F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def personal_data(docs: DataFrame, max_train: int = MAX_TRAIN) -> DataFrame:
    return digest(find(docs, fit(docs, max_train)))
