"""Neighbours, similarity, spanning trees, projections and paths."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stats import distance, dot
from ..store import cut

#: Points that one task holds as the other side of a distance block.
BLOCK = 4096


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float)


def near_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows by one matrix product; exact but for rounding."""
    return np.maximum(0, (x**2).sum(1)[:, None] + (y**2).sum(1) - 2 * x @ y.T)


def nearest(x: np.ndarray, own: np.ndarray, y: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each row of x the k nearest rows of y with another id, ties by id, and their distances.

    Candidates come from one matrix product; all that rounding could put among the k are compared by exact distances.
    """
    d2 = near_distances(x, y)
    d2[own[:, None] == ids] = np.inf
    slack = 1e-9 * ((x**2).sum(1) + (y**2).sum(1).max())
    edge = np.partition(d2, min(k, d2.shape[1]) - 1, axis=1)[:, min(k, d2.shape[1]) - 1]
    for i in range(len(x)):
        some = np.flatnonzero(d2[i] <= edge[i] + slack[i])
        some = some[np.isfinite(d2[i][some])]
        d = np.sqrt(((y[some] - x[i]) ** 2).sum(1))
        best = np.lexsort((ids[some], d))[:k]
        yield some[best], d[best]


def neighbours(points: DataFrame, k: int) -> DataFrame:
    """(id, neighbour, d, turn): the k nearest other points, ties by id.

    Points are dealt into blocks; each pair of blocks is one task's matrix product (rows of a stated block against all blocks),
    which keeps only k candidates per row, so what is shuffled is blocks * k rows a point, not all pairs.
    """
    n = points.count()
    if not 1 <= k <= n - 2:
        raise ValueError("k must be smaller than the total number of points!")
    blocks = max(1, -(-n // BLOCK))
    dealt = points.select("id", "x", F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("b"))
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = dealt.select("id", "x", F.lit(0).alias("side"), F.col("b").alias("row"), F.explode(every).alias("col"))
    right = dealt.select("id", "x", F.lit(1).alias("side"), F.explode(every).alias("row"), F.col("b").alias("col"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending")])
        side = np.array(table.column("side").to_pylist())
        ids, x = np.array(table.column("id").to_pylist()), _matrix(table.column("x"))
        a, b = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out = {"id": [], "neighbour": [], "d": []}
        if len(a) and len(b):
            for at in range(0, len(a), 256):
                for i, (best, d) in zip(a[at : at + 256], nearest(x[a[at : at + 256]], ids[a[at : at + 256]], x[b], ids[b], k)):
                    out["id"] += [ids[i]] * len(best)
                    out["neighbour"] += ids[b][best].tolist()
                    out["d"] += d.tolist()
        return pa.table({"id": pa.array(out["id"], pa.int64()), "neighbour": pa.array(out["neighbour"], pa.int64()), "d": pa.array(out["d"], pa.float64())})

    found = left.unionByName(right).groupBy("row", "col").applyInArrow(run, "id long, neighbour long, d double")
    turn = F.row_number().over(W.partitionBy("id").orderBy("d", "neighbour"))
    return found.withColumn("turn", turn).where(F.col("turn") <= k)


def jaccard(knn: DataFrame, weight: bool = True, strict: bool = False) -> DataFrame:
    """(id, neighbour, weight) of each neighbour link: shared neighbours u over 2k - u, scaled to a maximum of 1.

    Without shared neighbours the weight before scaling is 1, or 0 if ``strict``; without ``weight`` every link has 1.
    """
    lists = knn.groupBy("id").agg(F.array_sort(F.collect_list("neighbour")).alias("own"))
    links = knn.select("id", "neighbour").join(lists, "id").join(lists.select(F.col("id").alias("neighbour"), F.col("own").alias("other")), "neighbour")
    u, k = F.size(F.array_intersect("own", "other")), F.size("own")
    w = F.when(u > 0, u / (2.0 * k - u)).otherwise(0.0 if strict else 1.0) if weight else F.lit(1.0)
    links = links.select("id", "neighbour", w.alias("w"))
    most = links.agg(F.max("w")).scalar()
    return links.select("id", "neighbour", (F.col("w") / most).alias("weight"))


def nearest_vertex(points: DataFrame, vertices: DataFrame) -> DataFrame:
    """(id, vertex, d): the nearest vertex, the first on ties.  Vertices are the few nodes of a principal graph: their array goes along as one broadcast row."""
    all_ = vertices.agg(F.array_sort(F.collect_list(F.struct("vertex", "y"))).alias("vs"))
    near = F.array_min(F.transform("vs", lambda v: F.struct(distance(F.col("x"), v["y"]).alias("d"), v["vertex"].alias("vertex"))))
    return points.crossJoin(F.broadcast(all_)).select("id", near.alias("n")).select("id", F.col("n.vertex").alias("vertex"), F.col("n.d").alias("d"))


def project(points: DataFrame, segments: DataFrame, clamp: bool = True) -> DataFrame:
    """(id, t, q, d): points on the segment (a, b) that the row carries; t is the place along it, within 0..1 if clamped."""
    ab = F.zip_with("b", "a", lambda x, y: x - y)
    ap = F.zip_with("x", "a", lambda x, y: x - y)
    rows = points.join(segments, "key").withColumns({"ab": ab, "ap": ap})
    length = dot(F.col("ab"), F.col("ab"))
    t = F.when(length > 0, dot(F.col("ap"), F.col("ab")) / length).otherwise(0.0)
    rows = rows.withColumn("t", F.greatest(F.lit(0.0), F.least(F.lit(1.0), t)) if clamp else t)
    rows = rows.withColumn("q", F.zip_with("a", F.transform("ab", lambda v: v * F.col("t")), lambda x, y: x + y))
    return rows.select("id", "t", "q", distance(F.col("x"), F.col("q")).alias("d"))


class Distances:
    """Euclidean distances of the columns of ``points`` (dims x n), as ``d[i, j]`` and, to all others, ``d[i]``: made when asked for, never all at once."""

    def __init__(self, points: np.ndarray) -> None:
        self.points = np.asarray(points, float)

    def __len__(self) -> int:
        return self.points.shape[1]

    def __getitem__(self, at: int | tuple[int, int]) -> np.ndarray | float:
        if isinstance(at, tuple):
            return float(np.sqrt(((self.points[:, at[0]] - self.points[:, at[1]]) ** 2).sum()))
        return np.sqrt(((self.points - self.points[:, at, None]) ** 2).sum(0))

    def among(self, kept: np.ndarray) -> Distances:
        return Distances(self.points[:, kept])


def spanning_tree(d: np.ndarray | Distances, offset: bool = False) -> list[tuple[int, int, float]]:
    """Prim's tree of a small dense distance matrix, or of points by their ``Distances`` (a row at a time, so memory is linear in the points); with
    ``offset`` (of a matrix) the least non-zero distance is added, so coincident points keep an edge of some length."""
    n = len(d)
    if isinstance(d, Distances):
        return _point_tree(d)
    if offset and n > 1:
        off = d[d > 0]
        d = d + (off.min() if len(off) else 0)
    inside, best, parent = np.zeros(n, bool), np.full(n, np.inf), np.full(n, -1)
    edges, at = [], 0
    inside[0] = True
    for _ in range(n - 1):
        closer = ~inside & (d[at] < best)
        best[closer], parent[closer] = d[at][closer], at
        at = int(np.where(inside, np.inf, best).argmin())
        inside[at] = True
        edges.append((int(parent[at]), at, float(best[at])))
    return edges


def _point_tree(d: Distances, pack: int = 512) -> list[tuple[int, int, float]]:
    """The same tree in the same order; points of the tree leave the arrays every ``pack`` rounds."""
    n = len(d)
    left, rest = np.arange(n), d
    best, parent, out = np.full(n, np.inf), np.full(n, -1), np.zeros(n, bool)
    edges, at = [], 0
    for turn in range(n - 1):
        row, own = rest[at], int(left[at])
        out[at] = True
        best[at] = np.inf
        closer = np.flatnonzero((row < best) & ~out)
        best[closer], parent[closer] = row[closer], own
        at = int(best.argmin())
        if out[at]:  # all that are left are infinitely far
            at = int((~out).argmax())
        edges.append((int(parent[at]), int(left[at]), float(best[at])))
        if turn % pack == pack - 1:
            kept = np.flatnonzero(~out)
            at = int(np.searchsorted(kept, at))
            left, rest, best, parent, out = left[kept], rest.among(kept), best[kept], parent[kept], out[kept]
    return edges


def boruvka(edges: DataFrame) -> DataFrame:
    """Minimum spanning forest (src, dst, weight) of a large edge list: each round every component takes its least edge, then
    components merge by pointer halving."""
    edges = cut(edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "weight").where("src <> dst").groupBy("src", "dst").agg(F.min("weight").alias("weight")))
    labels = cut(edges.select(F.col("src").alias("v")).union(edges.select("dst")).distinct().select("v", F.col("v").alias("c")))
    chosen = None
    while True:
        a, b = labels.select(F.col("v").alias("src"), F.col("c").alias("ca")), labels.select(F.col("v").alias("dst"), F.col("c").alias("cb"))
        across = edges.join(a, "src").join(b, "dst").where("ca <> cb")
        both = across.select(F.col("ca").alias("c"), F.col("cb").alias("o"), "weight", "src", "dst").union(across.select("cb", "ca", "weight", "src", "dst"))
        best = cut(both.groupBy("c").agg(F.min(F.struct("weight", "src", "dst", "o")).alias("m")).select("c", "m.*"))
        if best.isEmpty():
            return chosen if chosen is not None else edges.limit(0)
        new = best.select("src", "dst", "weight").distinct()
        chosen = cut(new if chosen is None else chosen.union(new).distinct())
        # a component points at the other end of its edge; of two that point at each other the lesser is the root
        back = best.select(F.col("c").alias("o"), F.col("o").alias("oo"))
        to = best.join(back, "o", "left").select("c", F.when((F.col("oo") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("p"))
        to = cut(to)
        while True:
            nxt = to.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            step = cut(to.join(nxt, "p", "left").select("c", F.coalesce("pp", "p").alias("p"), (F.coalesce("pp", "p") != F.col("p")).alias("moved")))
            to = step.select("c", "p")
            if step.where("moved").isEmpty():
                break
        labels = cut(labels.join(to, "c", "left").select("v", F.coalesce("p", "c").alias("c")))


Adjacency = dict[int, dict[int, float]]


def adjacency(edges: list[tuple[int, int, float]]) -> Adjacency:
    out: Adjacency = {}
    for a, b, w in edges:
        out.setdefault(a, {})[b] = w
        out.setdefault(b, {})[a] = w
    return out


def distances(tree: Adjacency, root: int) -> tuple[dict[int, float], dict[int, int]]:
    """Shortest distances from a vertex and the predecessors."""
    far, before, heap = {root: 0.0}, {}, [(0.0, root)]
    while heap:
        d, v = heapq.heappop(heap)
        if d > far[v]:
            continue
        for u in sorted(tree.get(v, {})):
            if d + tree[v][u] < far.get(u, np.inf):
                far[u], before[u] = d + tree[v][u], v
                heapq.heappush(heap, (far[u], u))
    return far, before


def path(tree: Adjacency, a: int, b: int) -> list[int]:
    _, before = distances(tree, a)
    out = [b]
    while out[-1] != a:
        if out[-1] not in before:
            return []
        out.append(before[out[-1]])
    return out[::-1]


def diameter(tree: Adjacency) -> list[int]:
    """A longest shortest path, from its lesser end."""
    start = min(tree)
    far, _ = distances(tree, start)
    one = max(far, key=lambda v: (far[v], -v))
    far, _ = distances(tree, one)
    other = max(far, key=lambda v: (far[v], -v))
    return path(tree, min(one, other), max(one, other))


def louvain(edges: list[tuple[int, int, float]], seed: int = 0) -> dict[int, int]:
    """Communities of a weighted multigraph by local moving and aggregation."""
    graph: dict[int, dict[int, float]] = {}
    for a, b, w in edges:
        graph.setdefault(a, {})[b] = graph.setdefault(a, {}).get(b, 0) + w
        graph.setdefault(b, {})[a] = graph.setdefault(b, {}).get(a, 0) + w
    rng = np.random.default_rng(seed)
    label = {v: v for v in graph}
    while True:
        total = sum(sum(x.values()) for x in graph.values())
        degree = {v: sum(x.values()) for v, x in graph.items()}
        own, weight = {v: v for v in graph}, dict(degree)
        moved_any = False
        for _ in range(50):
            moved = False
            for v in rng.permutation(sorted(graph)).tolist():
                links: dict[int, float] = {}
                for u, w in graph[v].items():
                    if u != v:
                        links[own[u]] = links.get(own[u], 0) + w
                weight[own[v]] -= degree[v]
                gain = lambda c: links.get(c, 0) - degree[v] * weight.get(c, 0) / total  # noqa: B023, E731
                best = max([own[v], *sorted(links)], key=lambda c: (gain(c), c == own[v]))
                if gain(best) <= gain(own[v]) + 1e-12:
                    best = own[v]
                moved |= best != own[v]
                own[v] = best
                weight[best] = weight.get(best, 0) + degree[v]
            moved_any |= moved
            if not moved:
                break
        label = {v: own[c] for v, c in label.items()}
        if not moved_any:
            names = {c: i for i, c in enumerate(sorted(set(label.values())))}
            return {v: names[c] for v, c in label.items()}
        new: dict[int, dict[int, float]] = {}
        for v, x in graph.items():
            row = new.setdefault(own[v], {})
            for u, w in x.items():
                row[own[u]] = row.get(own[u], 0) + w
        graph = new


def modularity(edges: list[tuple[int, int, float]], label: dict[int, int]) -> float:
    total = 2 * sum(w for *_, w in edges)
    degree: dict[int, float] = {}
    inside = 0.0
    for a, b, w in edges:
        degree[label[a]] = degree.get(label[a], 0) + w
        degree[label[b]] = degree.get(label[b], 0) + w
        inside += 2 * w * (label[a] == label[b])
    return inside / total - sum(d * d for d in degree.values()) / total**2


def arrow_rows(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
    return np.concatenate([_matrix(b.column("x")) for b in batches])
