"""Communities of related nodes: connected components as DataFrame rounds, and seeded Louvain on the components of each version's graph."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docweave.session import cut_lineage, forget


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """id and component (its least id), by contraction.

    Ids become 64-bit keys (hashes; if two ids share one, all are hashed anew). In a round every node takes its neighbour of
    the most edges (or itself), then what that one took, and nodes of one label become one node; edges within are gone. So a round works on a fraction of
    the one before, and any label is a node of the same component, whatever ties do. Tables are written each round, so lineage stays short.
    """
    ends = edges.select(F.col("source").alias("a"), F.col("target").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
    ids = ends.select(F.col("a").alias("id")).union(ends.select("b")).distinct()
    kind = ids.schema["id"].dataType
    for seed in range(rounds):
        nodes = cut_lineage(ids.withColumn("key", _key(F.col("id"), seed)))
        if nodes.groupBy("key").count().where("count > 1").isEmpty():
            break
        forget(nodes)
    else:
        raise RuntimeError("ids share keys")
    level = cut_lineage(ends.select(*[_key(F.col(c).cast(kind), seed).alias(c) for c in ("a", "b")]).where("a <> b"))
    root, labels = _roots(level, rounds)
    found = nodes.join(root, nodes["key"] == root["node"], "left").select("id", F.coalesce("root", "key").alias("root"))
    found = cut_lineage(found)
    for t in (nodes, *labels):
        forget(t)
    return found.join(found.groupBy("root").agg(F.min("id").alias("component")), "root").select("id", "component")


def _roots(level: DataFrame, rounds: int = 60) -> tuple[DataFrame, list[DataFrame]]:
    """node and root of every node of level (a, b: keys, a <> b), a table of cut_lineage that goes; and the tables that the result is read from."""
    root, labels = level.select(F.col("a").alias("node"), F.col("a").alias("root")).limit(0), []
    while not level.isEmpty():
        if len(labels) == rounds:
            raise RuntimeError("components did not settle")
        labels.append(_labels(level, len(labels)))
        ours, theirs = (labels[-1].select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in ("a", "b"))
        near = level.join(ours, "a").join(theirs, "b").where("_a <> _b")
        new = cut_lineage(near.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
        forget(level)
        level = new
    for k, step in enumerate(reversed(labels)):
        if k:
            above = step.join(root.withColumnRenamed("node", "label"), "label", "left")
            step = above.select("node", F.coalesce("root", "label").alias("root"))
        root = step.toDF("node", "root")
    return root, labels


def _key(c, seed: int):
    return F.xxhash64(F.lit(seed), c)


def _labels(level: DataFrame, number: int) -> DataFrame:
    """node and label of every node of level (a, b): of its neighbours and itself the one of the most edges (then by a hash that is new in each round), and of that one the same."""
    both = level.unionByName(level.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = lambda n, c: F.least(n, F.lit((1 << 22) - 1)) * F.lit(1 << 40) + F.xxhash64(F.lit(-1 - number), c).bitwiseAND(F.lit((1 << 40) - 1))
    degree = both.groupBy("b").agg(F.count(F.lit(1)).alias("n"))
    ranked = both.join(degree, "b").select("a", "b", rank(F.col("n"), F.col("b")).alias("r"))
    best = ranked.groupBy("a").agg(F.count(F.lit(1)).alias("n"), F.max("r").alias("r"), F.max_by("b", "r").alias("b"))
    taken = cut_lineage(best.select(F.col("a").alias("node"), F.when(F.col("r") > rank(F.col("n"), F.col("a")), F.col("b")).otherwise(F.col("a")).alias("taken")))
    jump = taken.select(F.col("node").alias("taken"), F.col("taken").alias("label"))
    out = cut_lineage(taken.join(jump, "taken").select("node", "label"))
    forget(taken)
    return out


def louvain(edges: list[tuple[str, str]], seed: int = 7, resolution: float = 1.0) -> dict[str, int]:
    """Community of each node of one undirected graph: local moves by modularity gain, then the same on the graph of communities."""
    pairs = sorted({(a, b) if a <= b else (b, a) for a, b in edges})
    nodes = sorted({x for e in pairs for x in e})
    place = {n: k for k, n in enumerate(nodes)}
    a, b = (np.array([place[e[k]] for e in pairs], np.int32) for k in (0, 1))
    return dict(zip(nodes, _louvain(a, b, len(nodes), 2.0 * len(pairs), seed, resolution).tolist(), strict=True))


def _louvain(a: np.ndarray, b: np.ndarray, n: int, total: float, seed: int, resolution: float = 1.0) -> np.ndarray:
    """Communities, numbered from 0, of the nodes 0 to n - 1 of edges a, b. total: twice the weight of the graph that these edges are components of.

    A node is only ever compared with communities of its neighbours, so components settle apart from each other; all they share is total.
    """
    w, member, draw = None, np.arange(n), random.Random(seed)  # w None: 1 each
    while True:
        loop = np.flatnonzero(a == b)
        x, y, weight = (v if v is None or not len(loop) else np.delete(v, loop) for v in (a, b, w))
        size, order = np.bincount(x, minlength=n) + np.bincount(y, minlength=n), _order(x, y)
        far = np.concatenate((y, x))[order]
        if weight is not None:
            order[order >= len(x)] -= len(x)
            weight = weight[order]
        del order, x, y
        at, degree, linked = np.concatenate(([0], np.cumsum(size))), size.astype(float), np.flatnonzero(size)
        if weight is not None and len(linked):
            degree[linked] = np.add.reduceat(weight, at[linked])
        degree = degree + 2.0 * np.bincount(a[loop], weights=None if w is None else w[loop], minlength=n)
        com, moved_any = _moves(far, weight, at, degree, total, draw, resolution)
        del far, weight, at
        left, com = np.unique(com, return_inverse=True)
        member = com[member]
        if not moved_any:
            return member
        n = len(left)
        com = com.astype(np.int32 if n < 1 << 31 else np.int64)
        code = np.minimum(com[a], com[b]).astype(np.int64)  # an edge as one number; each is kept once, with the sum of its weights
        code *= n
        code += np.maximum(com[a], com[b])
        del a, b
        if w is None:
            code.sort()
        else:
            order = np.argsort(code, kind="stable")
            code, w = code[order], w[order]
            del order
        cut = np.concatenate(([0], np.flatnonzero(code[1:] != code[:-1]) + 1))
        w = np.diff(np.append(cut, len(code))).astype(float) if w is None else np.add.reduceat(w, cut)
        code = code[cut]
        a, b = (code // n).astype(com.dtype), (code % n).astype(com.dtype)
        del code, cut


def _order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Stable order of x and y, one after the other; by one sort in place where numbers and places fit 64 bits."""
    m = len(x)
    if x.dtype != np.int32 or m >= 1 << 31:
        return np.argsort(np.concatenate((x, y)), kind="stable")
    key = np.empty(2 * m, np.int64)
    key[:m], key[m:] = x, y
    key <<= 32
    key += np.arange(2 * m, dtype=np.uint32)
    key.sort()
    key &= 0xFFFFFFFF
    return key.astype(np.uint32)


_MANY = 48  # neighbours from which numpy counts them faster than a dictionary


def _moves(far: np.ndarray, weight: np.ndarray | None, at: np.ndarray, degree: np.ndarray, total: float, draw: random.Random, resolution: float) -> tuple[np.ndarray, bool]:
    """Communities after rounds of local moves, and whether any node moved. Node k has the neighbours far[at[k]:at[k + 1]], by weight (None: 1 each).

    A node is passed over when it would stay: none of its neighbours moved since it was looked at, and the degrees moved since then
    (shift) are below its limit, as they change a difference of its gains by at most 2 * resolution * degree / total each.
    """
    n = len(degree)
    com, mass, limit, order, shift = np.arange(n), degree.copy(), np.where(degree > 0, -1.0, np.inf), list(range(n)), 0.0
    com_of, mass_of, limit_of, degree_of, at_of = (memoryview(x) for x in (com, mass, limit, degree, at))
    draw.shuffle(order)
    small = np.diff(at) < _MANY
    moved_any, moved = False, n
    while moved:
        few, moved = moved < n // 8, 0
        for part in (order[i : i + 512] for i in range(0, n, 512)):
            if few:
                some = np.array(part)
                some = some[small[some] & (limit[some] <= shift)]
                if len(some) > 16:
                    _limits(some, far, weight, at, degree, com, mass, limit, shift, total, resolution)
            for k in part:
                if limit_of[k] > shift:
                    continue
                own, d, lo, hi = com_of[k], degree_of[k], at_of[k], at_of[k + 1]
                near = far[lo:hi]
                mass_of[own] -= d
                if hi - lo < _MANY:
                    links = {}
                    if weight is None:
                        for c in com[near].tolist():
                            links[c] = links.get(c, 0) + 1
                    else:
                        for c, x in zip(com[near].tolist(), weight[lo:hi].tolist(), strict=True):
                            links[c] = links.get(c, 0) + x
                    best, most, second = own, links.pop(own, 0) - resolution * mass_of[own] * d / total, -np.inf
                    for c in sorted(links):
                        gain = links[c] - resolution * mass_of[c] * d / total
                        if gain > most + 1e-12:
                            best, most, second = c, gain, max(most, second)
                        elif gain > second:
                            second = gain
                else:
                    best, most, second = _best(com[near], None if weight is None else weight[lo:hi], own, mass, d, total, resolution)
                mass_of[best] += d
                room = most - second - _doubt(most)
                limit_of[k] = shift + _reach(room, d, total, resolution) if room > 0 else -1.0
                if best != own:
                    com_of[k] = best
                    limit[near] = -1.0
                    moved, shift = moved + 1, shift + d
        moved_any = moved_any or moved > 0
    return com, moved_any


def _doubt(gain):
    """What rounding may change in a gain, generously."""
    return 1e-9 * (1 + abs(gain))


def _reach(room, d, total: float, resolution: float):
    """The degrees that may move elsewhere before a node of degree d whose best community is ahead by room would leave it."""
    return room * total / (2 * max(abs(resolution), 1e-9) * d)


def _best(near: np.ndarray, weight: np.ndarray | None, own: int, mass: np.ndarray, d: float, total: float, resolution: float) -> tuple[int, float, float]:
    """The community that a node of many neighbours (of communities near) takes, its gain and the next gain; mass is without the node."""
    if weight is None:
        near = np.sort(near)
    else:
        order = np.argsort(near, kind="stable")
        near, weight = near[order], weight[order]
    cut = np.concatenate(([0], np.flatnonzero(near[1:] != near[:-1]) + 1, [len(near)]))
    found, links = near[cut[:-1]], np.diff(cut) if weight is None else np.add.reduceat(weight, cut[:-1])
    gain = links - resolution * mass[found] * d / total
    p = int(np.searchsorted(found, own))
    if p < len(found) and found[p] == own:
        stay, gain[p] = float(gain[p]), -np.inf
    else:
        stay = -resolution * float(mass[own]) * d / total
    top = float(gain.max())
    best, most, place = own, stay, -1
    if top > stay + 1e-12:
        for j in np.flatnonzero(gain >= top - _doubt(top)).tolist():  # others are never the last to be taken
            if (g := float(gain[j])) > most + 1e-12:
                best, most, place = int(found[j]), g, j
        gain[place] = -np.inf
        return best, most, max(stay, float(gain.max()))
    return best, most, top


def _limits(nodes: np.ndarray, far: np.ndarray, weight: np.ndarray | None, at: np.ndarray, degree: np.ndarray, com: np.ndarray, mass: np.ndarray, limit: np.ndarray, shift: float, total: float, resolution: float) -> None:
    """Sets the limits of some nodes at once; -1 for those that would move."""
    n, size, d, own = len(degree), at[nodes + 1] - at[nodes], degree[nodes], com[nodes]
    stay, other = -resolution * (mass[own] - d) * d / total, np.full(len(nodes), -np.inf)
    links_at = np.arange(size.sum()) + np.repeat(at[nodes] - np.cumsum(size) + size, size)
    if len(links_at):
        code = np.repeat(np.arange(len(nodes)), size) * n + com[far[links_at]]
        order = None if weight is None else np.argsort(code, kind="stable")
        code = np.sort(code) if order is None else code[order]
        cut = np.concatenate(([0], np.flatnonzero(code[1:] != code[:-1]) + 1))
        links = np.diff(np.append(cut, len(code))) if order is None else np.add.reduceat(weight[links_at][order], cut)
        k, c = np.divmod(code[cut], n)
        ours = c == own[k]
        stay[k[ours]] += links[ours]
        gain = np.where(ours, -np.inf, links - resolution * mass[c] * d[k] / total)
        first = np.concatenate(([0], np.flatnonzero(k[1:] != k[:-1]) + 1))
        other[k[first]] = np.maximum.reduceat(gain, first)
    room = stay - other - _doubt(stay)
    limit[nodes] = np.where(room > 0, shift + _reach(room, d, total, resolution), -1.0)


class _Component:
    """The edges of one component, read as batches of version_id, root, m, a, b: ids are kept once, edges as their places."""

    def __init__(self, first: pa.RecordBatch):
        self.version, self.root, self.m = (first.column(k)[0].as_py() for k in range(3))
        self.ids, self.places, self.held = pa.array([], pa.string()), [], []

    def add(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch.select(["a", "b"]))
        if sum(map(len, self.held)) >= 1 << 18:
            self._place()

    def _place(self) -> None:
        coded = pa.concat_arrays([x.column(k) for k in (0, 1) for x in self.held]).dictionary_encode()
        at = pc.index_in(coded.dictionary, self.ids)
        new = pc.is_null(at)
        at = at.fill_null(0).to_numpy().copy()
        fresh = new.to_numpy(zero_copy_only=False)
        at[fresh] = np.arange(len(self.ids), len(self.ids) + np.count_nonzero(fresh), dtype=np.int32)
        self.ids = pa.concat_arrays([self.ids, coded.dictionary.filter(new)])
        self.places.append(at[coded.indices.to_numpy()].reshape(2, -1))
        self.held = []

    def solve(self, seed: int) -> pa.RecordBatch:
        """version_id, size, first (the least id of the community) and id of the nodes."""
        if self.held:
            self._place()
        by = pc.sort_indices(self.ids)
        ids, place = self.ids.take(by), np.empty(len(by), np.int32)
        place[by.to_numpy()] = np.arange(len(by), dtype=np.int32)
        sides = [np.concatenate([place[x[k]] for x in self.places]) for k in (0, 1)]
        self.ids, self.places = None, []
        found = _louvain(sides.pop(0), sides.pop(), len(ids), 2.0 * self.m, seed)
        _, first, which, size = np.unique(found, return_index=True, return_inverse=True, return_counts=True)
        version = pa.array([self.version] * len(ids), pa.string())
        return pa.RecordBatch.from_arrays([version, pa.array(size[which]), ids.take(pa.array(first[which])), ids], names=["version_id", "size", "first", "id"])


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of edges a, b and for each a node that its component shares."""
    coded = pa.array(np.concatenate((a, b))).dictionary_encode()
    nodes, at = coded.dictionary.to_numpy(), coded.indices.to_numpy()
    root, x, y = np.arange(len(nodes)), at[: len(a)], at[len(a) :]
    while len(x):
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up := root[root], root):
            root = up
        x, y = root[x], root[y]
        x, y = x[x != y], y[x != y]
    return nodes, nodes[root]


def _stars(nodes: np.ndarray, root: np.ndarray, most: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """The forest as edges: most nodes share a hub, and hubs of a component are linked to its first, so that few keys have many rows."""
    order = np.argsort(root, kind="stable")
    nodes, root = nodes[order], root[order]
    first = np.flatnonzero(np.concatenate(([True], root[1:] != root[:-1]))) if len(root) else np.empty(0, np.int64)
    base = np.repeat(first, np.diff(np.append(first, len(root))))
    own = np.arange(len(nodes)) - base
    hub = np.where(own % most == 0, base, base + own // most * most)
    linked = hub != base + own
    return nodes[linked], nodes[hub[linked]]


def _forests(edges: DataFrame, block: int = 1 << 21) -> DataFrame:
    """Edges a, b (a <> b) with the components of edges (two columns of keys), a table of cut_lineage: each task keeps a forest of what it has read, of at most twice block nodes."""

    def part(batches):
        a = b = np.empty(0, np.int64)
        held: list[pa.RecordBatch] = []
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held.append(batch)
            if held and (batch is None or sum(map(len, held)) >= block):
                a, b = _forest(*(np.concatenate([c, *(x.column(k).to_numpy() for x in held)]) for k, c in enumerate((a, b))))
                held = []
            if batch is None or len(a) >= block:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in _stars(a, b)], names=["a", "b"])
                a = b = np.empty(0, np.int64)

    return cut_lineage(edges.coalesce(edges.sparkSession.sparkContext.defaultParallelism).mapInArrow(part, "a long, b long"))


def communities(edges: DataFrame, min_size: int = 3, seed: int = 7) -> DataFrame:
    """version_id, cluster and id: Louvain within each version, communities of at least min_size nodes, largest first.

    A version's components are dealt over the tasks: none moves a node of another, and the one number that they share, the version's edges, is counted before.
    A connected component is held by one task, as numbers: at the peak about 100 bytes an edge, ids included (measured on 2.9 million edges of 0.3 million nodes).
    """
    spark = edges.sparkSession
    ends = [F.col(c).cast("string") for c in ("source", "target")]
    clean = edges.where("source <> target").select("version_id", F.least(*ends).alias("a"), F.greatest(*ends).alias("b"))
    clean = clean.repartition("version_id", "a").distinct()  # a node's edges together, so that _forests meets few nodes twice
    clean = cut_lineage(clean.withColumns({f"_{c}": F.xxhash64("version_id", c) for c in ("a", "b")}))  # ids that share a key share a task, no more
    root, labels = _roots(_forests(clean.select("_a", "_b").where("_a <> _b")))
    count = clean.groupBy("version_id").agg(F.count(F.lit(1)).alias("m"))
    whole = clean.join(root, clean["_a"] == root["node"], "left").join(count.withColumnRenamed("version_id", "_v"), F.col("version_id").eqNullSafe(F.col("_v")))
    whole = whole.select("version_id", F.coalesce("root", "_a").alias("root"), "m", "a", "b")
    dealt = whole.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "version_id", "root").sortWithinPartitions("version_id", "root")

    def part(batches):
        one = None
        for batch in batches:
            v, r = batch.column(0).dictionary_encode(null_encoding="encode").indices.to_numpy(), batch.column(1).to_numpy()
            cut = [0, *(np.flatnonzero((r[1:] != r[:-1]) | (v[1:] != v[:-1])) + 1).tolist(), len(r)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if hi > lo:
                    if one and (one.version, one.root) != (batch.column(0)[lo].as_py(), batch.column(1)[lo].as_py()):
                        yield one.solve(seed)
                        one = None
                    one = one or _Component(batch.slice(lo, 1))
                    one.add(batch.slice(lo, hi - lo))
        if one:
            yield one.solve(seed)

    found = cut_lineage(dealt.mapInArrow(part, "version_id string, size long, first string, id string").where(F.col("size") >= min_size))
    for t in (clean, *labels):
        forget(t)
    place = Window.partitionBy("version_id").orderBy(F.desc("size"), "first")  # a row a community
    ranks = found.where("id = first").select("version_id", "first", (F.row_number().over(place) - 1).cast("int").alias("cluster"))
    both = found.alias("f").join(ranks.alias("r"), F.col("f.version_id").eqNullSafe(F.col("r.version_id")) & (F.col("f.first") == F.col("r.first")))
    return both.select("f.version_id", "cluster", "id")


def labelled(members: DataFrame) -> DataFrame:
    """Cluster rows with the names they have where no model labels them."""
    g = members.groupBy("version_id", "cluster").agg(F.array_sort(F.collect_list("id")).alias("nodes"))
    n = F.size("nodes")
    return g.select(F.concat(F.col("version_id"), F.lit("::cluster::"), F.col("cluster")).alias("id"), F.split("version_id", "@")[0].alias("library_id"), "version_id", F.concat(F.lit("Cluster ("), n, F.lit(" nodes)")).alias("name"), F.lit("Community of related API symbols.").alias("summary"), n.alias("node_count"), "nodes")
