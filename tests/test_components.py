"""Connected components against brute force, and what they leave behind."""

import os
import random

from docweave.operators import community
from docweave.session import shared_folder


def brute(pairs):
    root = {x: x for p in pairs for x in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def solved(spark, pairs):
    out = community.components(spark.createDataFrame(pairs, "source string, target string"))
    return {r["id"]: r["component"] for r in out.collect()}


def graph():
    draw = random.Random(3)
    pairs = [(f"n{draw.randrange(400)}", f"n{draw.randrange(400)}") for _ in range(260)]
    path = [f"m{k}" for k in range(200)]
    draw.shuffle(path)
    return [*pairs, *zip(path, path[1:]), *[("hub", f"leaf{k}") for k in range(100)], ("one", "two"), ("two", "one"), ("loop", "loop")]


def test_components_leave_one_table(spark):
    folder = f"{shared_folder(spark).removeprefix('file://')}/docweave"
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    pairs = graph()
    assert solved(spark, pairs) == brute(pairs)
    assert len(set(os.listdir(folder)) - before) <= 3  # the tables of rounds go when a later one holds all


def test_components_of_ids_that_share_a_key(spark, monkeypatch):
    key, seeds = community._key, []
    monkeypatch.setattr(community, "_key", lambda c, seed: (seeds.append(seed), key(c, seed) % (2 if seed == 0 else 1 << 62))[1])
    pairs = [("a", "b"), ("c", "d"), ("b", "e"), (None, "x")]
    assert solved(spark, pairs) == {"a": "a", "b": "a", "e": "a", "c": "c", "d": "c"} and max(seeds) == 1


def test_components_of_nothing(spark):
    assert solved(spark, []) == {} and solved(spark, [("z", "z")]) == {"z": "z"}
