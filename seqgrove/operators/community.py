"""Communities of the similarity graph: Leiden with the resolution-weighted configuration model.

The quality is a sum over pairs with a global total weight, so connected components never gain by merging
and are optimised apart. Components of few edges are solved by a kernel, each in one task; vertices are visited in order of name there.
Larger ones are never gathered: they move, are refined and contracted in rounds of joins (``operators.community_rounds``)
until what is left of them fits a task. Reruns agree; labels of other implementations differ where several
partitions are equally good.
"""

from __future__ import annotations

from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqgrove.operators.components import components
from seqgrove.operators.numbering import numbered
from seqgrove.session import ship
from seqgrove.storage import materialise


def _move(adj: list[dict[int, float]], k: np.ndarray, label: np.ndarray, gamma: float, m2: float, inside: np.ndarray | None = None) -> bool:
    """Greedy local moves until none gains. inside: moves stay within equal values of it (refinement)."""
    total = np.bincount(label, k, len(adj)).astype(float)
    moved, todo, queued = False, deque(range(len(adj))), [True] * len(adj)
    while todo:
        v = todo.popleft()
        queued[v] = False
        own = label[v]
        total[own] -= k[v]
        to: dict[int, float] = {own: 0.0}
        for u, w in adj[v].items():
            if u != v and (inside is None or inside[u] == inside[v]):
                to[label[u]] = to.get(label[u], 0.0) + w
        best, gain = own, to[own] - gamma * k[v] * total[own] / m2
        for c in sorted(to):
            g = to[c] - gamma * k[v] * total[c] / m2
            if g > gain + 1e-12:
                best, gain = c, g
        total[best] += k[v]
        if best != own:
            label[v] = best
            moved = True
            for u in adj[v]:
                if label[u] != best and not queued[u]:
                    queued[u] = True
                    todo.append(u)
    return moved


def leiden(n: int, edges: list[tuple[int, int, float]], gamma: float = 2.0, total_weight: float | None = None, degree: list[float] | None = None, start: list[int] | None = None) -> np.ndarray:
    """A community for each of n vertices. total_weight: of the whole graph, if this is a part of it; degree: of vertices that stand
    for several, whose inner weight isn't among the edges; start: their communities so far."""
    m2 = 2 * (total_weight if total_weight is not None else sum(w for *_, w in edges))
    adj: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b, w in edges:
        adj[a][b] = adj[a].get(b, 0.0) + w
        if a != b:
            adj[b][a] = adj[b].get(a, 0.0) + w
    k = np.array([sum(x.values()) for x in adj]) if degree is None else np.asarray(degree, float)
    own = np.arange(n)  # the current vertex of each original one
    label = np.arange(n)
    if start is not None:  # named by one of the community's vertices
        first: dict[int, int] = {}
        label = np.array([first.setdefault(c, i) for i, c in enumerate(start)])
    while len(adj):
        moved = _move(adj, k, label, gamma, m2)
        refined = np.arange(len(adj))
        _move(adj, k, refined, gamma, m2, inside=label)
        names, small = np.unique(refined, return_inverse=True)
        if not moved or len(names) == len(adj):
            return label[own]
        new: list[dict[int, float]] = [{} for _ in names]
        for v, x in enumerate(adj):
            for u, w in x.items():
                new[small[v]][small[u]] = new[small[v]].get(small[u], 0.0) + w
        kk = np.bincount(small, k, len(names))
        up = np.zeros(len(names), np.int64)
        up[small] = label
        _, label = np.unique(up, return_inverse=True)
        # a community's label is one of its vertices, so that empty ones are free to be used
        first: dict[int, int] = {}
        label = np.array([first.setdefault(c, i) for i, c in enumerate(label.tolist())])
        adj, k, own = new, kk, small[own]
    return label[own]


#: Edges of a component (or of what is left of larger ones) that one task takes.
TASK_EDGES = 1_000_000


def communities(edges: DataFrame, gamma: float = 2.0, task_edges: int = TASK_EDGES, comp: DataFrame | None = None) -> DataFrame:
    """entity, community (its smallest member). edges: (src, dst, weight). Isolated entities don't appear. comp: their ``components``, if known."""
    from seqgrove.operators import community_rounds

    ship(edges.sparkSession)
    total = edges.agg(F.sum("weight").alias("w")).first()["w"] or 0.0
    comp = components(edges.select(F.col("src").alias("u"), F.col("dst").alias("v"))) if comp is None else comp
    labelled = edges.join(comp.select(F.col("u").alias("src"), F.col("v").alias("root")), "src", "left").withColumn("root", F.coalesce("root", "src")).select("root", "src", "dst", "weight")
    large = labelled.groupBy("root").agg(F.count("*").alias("n")).where(F.col("n") > task_edges).select("root")
    rest, out = labelled, None
    if large.take(1):
        large = materialise(large, "large-components")
        rest = labelled.join(large, "root", "left_anti")
        out = community_rounds.communities_in_rounds(labelled.join(large, "root", "left_semi").select("src", "dst", "weight"), gamma, total, task_edges)

    def solve(pdf):
        names = sorted({*pdf["src"], *pdf["dst"]})
        at = {x: i for i, x in enumerate(names)}
        rows = sorted((at[a], at[b], w) for a, b, w in zip(pdf["src"], pdf["dst"], pdf["weight"]))
        label = leiden(len(names), rows, gamma, total)
        first: dict[int, str] = {}
        return pd.DataFrame({"entity": names, "community": [first.setdefault(c, x) for x, c in zip(names, label.tolist())]})

    small = rest.groupBy("root").applyInPandas(solve, "entity string, community string")
    return small if out is None else small.unionByName(out)


def quality(edges: DataFrame, groups: DataFrame, gamma: float = 2.0) -> DataFrame:
    """quality: the sum over pairs of a community of weight less gamma times the expected weight, over twice the total.

    edges: (src, dst, weight), src <> dst; groups: (entity, community)."""
    total = edges.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"))
    degree = edges.select(F.col("src").alias("entity"), "weight").unionByName(edges.select(F.col("dst").alias("entity"), "weight")).groupBy("entity").agg(F.sum("weight").alias("k"))
    own = lambda v, name: groups.select(F.col("entity").alias(v), F.col("community").alias(name))
    inside = edges.join(own("src", "x"), "src").join(own("dst", "y"), "dst").where("x = y").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("a"))
    sizes = degree.join(groups, "entity").groupBy("community").agg(F.sum("k").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0)).alias("kk"))
    w = F.col("w")
    return inside.crossJoin(sizes).crossJoin(total).select(F.when(w > 0, F.col("a") / w - gamma * F.col("kk") / (4 * w * w)).otherwise(0.0).alias("quality"))  # one row each


def qualities(placed: DataFrame, groups: DataFrame, names: list[str], gamma: float = 2.0) -> DataFrame:
    """One row with the ``quality`` of several divisions, a column each.

    placed: edges (src, dst, weight) with the groups of their ends, x_<name> and y_<name>; groups: (entity, <name>...)."""
    sums = placed.agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("w"), *[F.coalesce(F.sum(F.when(F.col(f"x_{n}") == F.col(f"y_{n}"), F.col("weight"))), F.lit(0.0)).alias(f"in_{n}") for n in names])
    ends = placed.select(F.col("src").alias("entity"), "weight").unionByName(placed.select(F.col("dst").alias("entity"), "weight"))
    degree = ends.groupBy("entity").agg(F.sum("weight").alias("k")).join(groups, "entity")
    for n in names:
        k = degree.groupBy(n).agg(F.sum("k").alias("k")).agg(F.coalesce(F.sum(F.col("k") * F.col("k")), F.lit(0.0)).alias(f"kk_{n}"))
        sums = sums.crossJoin(k)  # one row each
    w = F.col("w")
    return sums.select(*[F.when(w > 0, F.col(f"in_{n}") / w - gamma * F.col(f"kk_{n}") / (4 * w * w)).otherwise(0.0).alias(n) for n in names])


def stable_ids(groups: DataFrame) -> DataFrame:
    """entity, cluster_id ``cluster_0001``...: groups in order of (smallest member, size)."""
    g = groups.groupBy("community").agg(F.min("entity").alias("first"), F.count("*").alias("size"))
    g = numbered(g, "n", "first", "size").withColumn("cluster_id", F.format_string("cluster_%04d", F.col("n") + 1))
    return groups.join(g.select("community", "cluster_id"), "community").select("entity", "cluster_id")
