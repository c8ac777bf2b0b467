"""The language model lays a bucket out once, however many blocks of positions it scores there."""

import numpy as np
import pytest

from docweave.llm import hpylm


def bucket(draw, n=400):
    words = np.sort(draw.integers(0, 2**64, 50, dtype=np.uint64))
    w, code, c = hpylm._types(words[draw.integers(0, 50, n)], draw.integers(0, 200, n).astype(np.int32) << 10)
    u, runs = hpylm._runs(w)
    dishes, samples, seats = hpylm.Dishes(u, runs, code, c), [], ([], [], [])
    for k in range(3):
        t2 = np.minimum(c, 1 + draw.integers(0, 2, len(c)))
        t1 = np.ones(len(dishes.pair_at), np.int64)
        t0 = np.ones(len(u), np.int64)
        c1, c0 = dishes.up(t2, t1)
        all_ = hpylm.Totals((0.5, 0.6, 0.7), 60, (1.0, 2.0 + k, 3.0))
        all_.c2, all_.t2 = (np.bincount(code, weights=x, minlength=hpylm.START + 1).astype(np.int64) for x in (c, t2))
        all_.c1, all_.t1 = (np.bincount(dishes.pair_code, weights=x, minlength=hpylm.CLASSES) for x in (c1, t1))
        all_.c0, all_.t0 = float(c0.sum()), float(t0.sum())
        samples.append(all_)
        for held, x in zip(seats, (t2, t1, t0), strict=True):
            held.append(x)
    return dishes, seats, samples


def plain(dishes, seats, samples, w, code):
    """One position, by the formulas."""
    p = 0.0
    for t2, t1, t0, all_ in zip(*seats, samples, strict=True):
        c1, c0 = dishes.up(t2, t1)
        at = np.flatnonzero(dishes.words == w)
        of = lambda x, where: x[where[0]] if len(where) else 0
        one = np.flatnonzero((dishes.pair_word == at[0]) & (dishes.pair_code == code >> hpylm.SLOT)) if len(at) else at
        two = np.flatnonzero((dishes.word == at[0]) & (dishes.codes == code)) if len(at) else at
        q = all_.one(code >> hpylm.SLOT, of(c1, one), of(t1, one), all_.root(of(c0, at), of(t0, at)))
        p += all_.two(code, of(dishes.counts, two), of(t2, two), q) / len(samples)
    return p


def test_one_layout_scores_all_blocks(monkeypatch):
    draw = np.random.default_rng(3)
    dishes, seats, samples = bucket(draw)
    laid = hpylm.Seats(dishes, *seats, samples)
    monkeypatch.setattr(hpylm.Dishes, "up", None)  # nothing of the bucket's size is made again
    blocks = []
    for _ in range(5):
        w, code = dishes.words[draw.integers(0, len(dishes.words), 40)], draw.integers(0, 220, 40) << 10
        w[::9] += np.uint64(1)  # words that are not there
        blocks.append((w, code, *hpylm.predicted(laid, w, code)))
    monkeypatch.undo()
    for w, code, p, c in blocks:
        assert p == pytest.approx([plain(dishes, seats, samples, x, y) for x, y in zip(w, code, strict=True)], rel=1e-12)
        assert c.tolist() == [int(dishes.counts[dishes.word == np.flatnonzero(dishes.words == x)[0]].sum()) if x in dishes.words else 0 for x in w]


def test_lookup_and_types_are_those_of_plain_search():
    draw = np.random.default_rng(5)
    keys = np.unique(np.concatenate((draw.integers(0, 2**64, 3000, dtype=np.uint64), np.arange(40, dtype=np.uint64), np.uint64(2**64 - 1) - np.arange(5, dtype=np.uint64))))
    asked = np.concatenate((keys, draw.integers(0, 2**64, 3000, dtype=np.uint64), np.arange(50, dtype=np.uint64)))
    at, hit = hpylm.lookup(keys, hpylm.starts(keys), asked)
    assert (at == np.minimum(np.searchsorted(keys, asked), len(keys) - 1)).all() and (hit == np.isin(asked, keys)).all()
    assert not hpylm.lookup(keys[:0], hpylm.starts(keys[:0]), asked)[1].any()
    w, code, c = keys[draw.integers(0, 50, 4000)], draw.integers(0, 9, 4000).astype(np.int32) * (hpylm.START // 8), draw.integers(1, 5, 4000)
    for counts in (None, c):
        want: dict = {}
        for x, y, z in zip(w.tolist(), code.tolist(), np.ones(4000, int).tolist() if counts is None else c.tolist(), strict=True):
            want[x, y] = want.get((x, y), 0) + z
        assert [((int(x), int(y)), int(z)) for x, y, z in zip(*hpylm._types(w, code, counts), strict=True)] == sorted(want.items())
