"""Louvain dealt by components against Louvain on a version's whole graph."""

import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from docweave.operators import community
from docweave.plans import QUERIES
from docweave.session import shared_folder


def clique(name, n):
    return [(f"{name}{i}", f"{name}{j}") for i in range(n) for j in range(i)]


def ring(name, cliques, size):
    return [e for k in range(cliques) for e in [*clique(f"{name}{k}_", size), (f"{name}{k}_0", f"{name}{(k + 1) % cliques}_1")]]


def groups(found):
    out = {}
    for n, c in found.items():
        out.setdefault(c, set()).add(n)
    return {frozenset(g) for g in out.values()}


def test_a_component_needs_only_the_total_of_the_others():
    left, right = ring("a", 4, 6), ring("b", 5, 5)
    whole = groups(community.louvain(left + right))
    parts = set()
    for edges in (left, right):
        nodes = sorted({x for e in edges for x in e})
        a, b = (np.array([nodes.index(e[k]) for e in edges]) for k in (0, 1))
        found = community._louvain(np.minimum(a, b), np.maximum(a, b), len(nodes), 2.0 * len(left + right), 7)
        parts |= groups(dict(zip(nodes, found.tolist(), strict=True)))
    assert parts == whole and len(whole) > 2


def test_communities_of_many_components(spark):
    draw = random.Random(5)
    versions = {"l@1": ring("a", 4, 6) + ring("b", 5, 5) + [("x", "y")], "l@2": [e for k in range(40) for e in clique(f"c{k}_", 3 + k % 4)], None: clique("a", 4)}
    rows = [(v, *(e if draw.random() < 0.5 else e[::-1])) for v, edges in versions.items() for e in edges * 2] + [("l@1", "x", "x"), ("l@1", None, "x")]
    draw.shuffle(rows)
    df = spark.createDataFrame(rows, "version_id string, source string, target string").repartition(5)
    found = {}
    for r in community.communities(df).collect():
        found.setdefault(r["version_id"], {}).setdefault(r["cluster"], []).append(r["id"])
    for v, edges in versions.items():
        want = sorted((sorted(g) for g in groups(community.louvain(edges)) if len(g) >= 3), key=lambda g: (-len(g), g[0]))
        assert [sorted(found[v][k]) for k in range(len(found[v]))] == want


def test_communities_of_nothing(spark):
    assert community.communities(spark.createDataFrame([], "version_id string, source string, target string")).collect() == []


def test_labels_of_a_version_in_many_components(spark, tmp_path):
    rows = [("N", 10 * k + s, 10 * k + p) for k in range(60) for s in range(3) for p in range(k % 3 + 1)]
    spark.createDataFrame(rows, "l_returnflag string, l_suppkey long, l_partkey long").write.parquet(str(tmp_path / "lineitem.parquet"))
    shared = f"{shared_folder(spark).removeprefix('file://')}/docweave"
    before = set(os.listdir(shared)) if os.path.isdir(shared) else set()
    found = QUERIES["cluster_labels"](spark, str(tmp_path)).collect()
    assert sorted(r["node_count"] for r in found) == [4] * 20 + [5] * 20 + [6] * 20 and {r["version_id"] for r in found} == {"shop@N"}
    assert sorted(int(r["id"].rsplit("::", 1)[1]) for r in found) == list(range(60))
    last = spark.read.parquet(*[f"{shared}/{x}" for x in set(os.listdir(shared)) - before if spark.read.parquet(f"{shared}/{x}").columns[1:3] == ["size", "first"]])
    tasks = last.select(F.input_file_name().alias("f")).distinct().count()
    assert tasks > 1  # one version, many tasks


def plain(a, b, n, total, seed, resolution):
    """Louvain that looks at every node in every round."""
    weight, member, draw = {(x, y): 1 for x, y in zip(a.tolist(), b.tolist(), strict=True)}, list(range(n)), random.Random(seed)
    while True:
        near, degree = [{} for _ in range(n)], [0] * n
        for (x, y), w in weight.items():
            degree[x] += w
            degree[y] += w
            if x != y:
                near[x][y] = near[y][x] = w
        com, mass, order, rounds, moved = list(range(n)), list(degree), list(range(n)), 0, True
        draw.shuffle(order)
        while moved:
            rounds, moved = rounds + 1, False
            for k in order:
                own, links = com[k], {}
                for m, w in near[k].items():
                    links[com[m]] = links.get(com[m], 0) + w
                mass[own] -= degree[k]
                best, most = own, links.get(own, 0) - resolution * mass[own] * degree[k] / total
                for c in sorted(links):
                    if (gain := links[c] - resolution * mass[c] * degree[k] / total) > most + 1e-12:
                        best, most = c, gain
                mass[best] += degree[k]
                com[k], moved = best, moved or best != own
        place = {c: k for k, c in enumerate(sorted(set(com)))}
        com = [place[c] for c in com]
        member, n, old, weight = [com[m] for m in member], len(place), weight, {}
        if rounds == 1:
            return member
        for (x, y), w in old.items():
            e = (min(com[x], com[y]), max(com[x], com[y]))
            weight[e] = weight.get(e, 0) + w


def test_passing_over_nodes_changes_no_result():
    r = np.random.default_rng(3)
    for k in range(24):
        n, size = int(r.integers(50, 1500)), int(r.integers(2, 40))
        x = r.integers(0, n, 8 * n)
        y = (r.integers(0, n, 8 * n), r.integers(0, n // 20, 8 * n), np.minimum(x // size * size + r.integers(0, size, 8 * n), n - 1))[k % 3]
        code = np.unique(np.minimum(x, y)[x != y] * n + np.maximum(x, y)[x != y])
        a, b = code // n, code % n
        total, resolution = 2.0 * len(a) * (1 + 59 * (k % 2)), (1.0, 0.5, 2.0)[k // 3 % 3]
        assert community._louvain(a, b, n, total, 7, resolution).tolist() == plain(a, b, n, total, 7, resolution)


def test_settled_nodes_are_passed_over(monkeypatch):
    seen, best = [], community._best
    monkeypatch.setattr(community, "_best", lambda *x: seen.append(1) or best(*x))
    monkeypatch.setattr(community, "_MANY", 0)
    edges = ring("a", 200, 8)
    n = len({x for e in edges for x in e})
    assert len(set(community.louvain(edges).values())) < 200
    assert n <= len(seen) < 3 * n  # every node is looked at in the first round, few afterwards


def test_components_are_found_on_forests(spark, monkeypatch):
    r, met, roots = np.random.default_rng(4), [], community._roots
    rows = [("l@1", f"s{k % 3}_{s}", f"p{k % 3}_{p}") for k in range(9) for s, p in r.integers(0, 60, (400, 2)).tolist()]
    monkeypatch.setattr(community, "_roots", lambda level, *x: met.append((level.count(), level.where("a = b").count())) or roots(level, *x))
    found = {}
    for c in community.communities(spark.createDataFrame(rows, "version_id string, source string, target string").repartition(7)).collect():
        found.setdefault(c["cluster"], set()).add(c["id"])
    want = groups(community.louvain([(s, p) for _, s, p in rows]))
    assert {frozenset(g) for g in found.values()} == {g for g in want if len(g) >= 3}
    assert met[0][1] == 0 and met[0][0] < len(set(rows)) / 2


def test_forests_of_blocks_keep_components(spark):
    r = np.random.default_rng(6)
    pairs = [(int(10**12 + x), int(10**12 + y)) for x, y in r.integers(0, 400, (300, 2)).tolist() if x != y]

    def components(edges):
        up = {x: x for e in pairs for x in e}
        for a, b in edges:
            while up[a] != a:
                a = up[a]
            while up[b] != b:
                b = up[b]
            up[max(a, b)] = min(a, b)
        for x in sorted(up):
            up[x] = up[up[x]]
        return up

    df = spark.createDataFrame(pairs, "x long, y long").repartition(6)
    for block in (1, 7, 1 << 21):
        assert components([tuple(e) for e in community._forests(df, block).collect()]) == components(pairs)
    assert community._forests(df.where("false")).count() == 0


def test_forests_have_no_large_hubs():
    nodes = np.arange(10, 5010)
    for root in (np.full(5000, 3010), nodes // 2500 * 2500 + 10, nodes):
        a, b = community._stars(nodes, root, 100)
        assert len(a) == 5000 - len(set(root.tolist())) and (a != b).all()
        assert max([0, *np.unique(b, return_counts=True)[1]]) < 100 + 50
        assert all(root[x - 10] == root[y - 10] for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert [len(x) for x in community._stars(nodes[:0], nodes[:0])] == [0, 0]


def test_a_component_read_in_many_batches():
    edges = sorted({(min(e), max(e)) for e in ring("a", 30, 8)})
    batch = pa.RecordBatch.from_pylist([{"version_id": None, "root": 5, "m": len(edges), "a": a, "b": b} for a, b in edges])
    one = community._Component(batch.slice(0, 1))
    for k in range(0, len(edges), 50):
        one.add(batch.slice(k, 50))
        one._place()
    found = one.solve(7)
    got = {}
    for r in found.to_pylist():
        got.setdefault((r["version_id"], r["first"], r["size"]), set()).add(r["id"])
    assert {frozenset(g) for g in got.values()} == groups(community.louvain(edges))
    assert all(v is None and min(g) == first and len(g) == size for (v, first, size), g in got.items())
