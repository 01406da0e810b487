"""Complete-linkage refinement of communities and similarity summaries of clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqgrove.operators.components import components
from seqgrove.session import ship
from seqgrove.storage import materialise


def complete_linkage(dist: np.ndarray, cut: float) -> np.ndarray:
    """Labels of a square distance matrix: merged by nearest-neighbour chains, cut where the greatest
    distance inside a cluster would exceed ``cut``."""
    n = len(dist)
    d = dist.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    alive, parent, chain = np.ones(n, bool), np.arange(n), []
    merges = []
    for _ in range(n - 1):
        if not chain:
            chain.append(int(np.flatnonzero(alive)[0]))
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        chain.pop()
        chain.pop()
        a, b = min(a, b), max(a, b)
        merges.append((d[a, b], a, b))
        far = np.maximum(d[a], d[b])
        d[a], d[:, a] = far, far
        d[a, a] = np.inf
        alive[b] = False

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for height, a, b in merges:
        if height <= cut:
            parent[root(b)] = root(a)
    return np.array([root(i) for i in range(n)])


def sparse_linkage(n: int, near: list[dict[int, float]]) -> np.ndarray:
    """Labels of n nodes by complete linkage, from the distances that don't exceed the cut alone: near[i][j] = near[j][i].

    A pair that isn't there is too far, and so is any cluster that would hold it: of two merged nodes only common neighbours stay,
    at the greater distance. Nearest-neighbour chains, smaller nodes first among equals."""
    near = [dict(x) for x in near]
    parent = np.arange(n)
    chain: list[int] = []
    start = 0
    while True:
        if not chain:
            while start < n and not near[start]:
                start += 1
            if start == n:
                return np.array([_root(parent, i) for i in range(n)])
            chain.append(start)
        a = chain[-1]
        d, b = min((d, x) for x, d in near[a].items())
        if len(chain) > 1 and near[a].get(chain[-2], np.inf) <= d:
            b = chain[-2]
        if len(chain) < 2 or b != chain[-2]:
            chain.append(b)
            continue
        del chain[-2:]
        a, b = min(a, b), max(a, b)
        x, y = near[a], near[b]
        both = {k: max(x[k], y[k]) for k in (x if len(x) < len(y) else y) if k in x and k in y}
        for k in x:
            del near[k][a]
        for k in y:
            if k != a:
                del near[k][b]
        near[a], near[b] = both, {}
        for k, d in both.items():
            near[k][a] = d
        parent[b] = a
        start = min(start, a)
        # each of a chain is the nearest of the one before, so one that has lost all neighbours ends it
        chain = chain[: next((i for i, c in enumerate(chain) if not near[c]), len(chain))]


def _root(parent: np.ndarray, x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = int(parent[x])
    return x


def _clamped(score: Column) -> Column:
    """The distance of a score; missing ones count 0."""
    return 1.0 - F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.coalesce(F.nanvl(score, F.lit(0.0)), F.lit(0.0))))


def refine(members: DataFrame, pair_scores: DataFrame, min_similarity: float) -> DataFrame:
    """entity, community (its smallest member): communities split until every pair inside reaches the floor.

    members: (entity, community); pair_scores: (a, b, amb); pairs that are missing or null count 0, so only those that reach
    the floor need be given. Only such pairs can ever be merged, so a community falls into the components of their graph; each is
    solved by its sparse distances in one task."""
    if not 0 < min_similarity <= 1:
        raise ValueError("min_similarity lies in (0, 1]")
    ship(members.sparkSession)
    cut = 1.0 - min_similarity
    home = members.select(F.col("entity").alias("a"), "community")
    close = pair_scores.select("a", "b", _clamped(F.col("amb")).alias("dist")).where((F.col("dist") <= cut) & (F.col("a") != F.col("b")))
    close = close.join(home, "a").join(members.select(F.col("entity").alias("b"), F.col("community").alias("other")), "b").where("community = other").select("a", "b", "dist")
    close = materialise(close, "close-pairs")
    roots = components(close.select(F.col("a").alias("u"), F.col("b").alias("v")))
    parts = close.join(roots.select(F.col("u").alias("a"), F.col("v").alias("root")), "a", "left").select(F.coalesce("root", "a").alias("root"), "a", "b", "dist")

    def solve(rows):
        names = sorted({*rows["a"], *rows["b"]})
        at = {x: i for i, x in enumerate(names)}
        near: list[dict[int, float]] = [{} for _ in names]
        for a, b, d in zip(rows["a"], rows["b"], rows["dist"]):
            i, j = at[a], at[b]
            near[i][j] = near[j][i] = d
        label = sparse_linkage(len(names), near)
        for i, c in enumerate(label.tolist()):  # merged nodes are all near one of them
            if i != c and c not in near[i]:
                raise RuntimeError("a refined cluster holds a pair below the floor")
        return pd.DataFrame({"entity": names, "community": [names[c] for c in label.tolist()]})

    solved = parts.groupBy("root").applyInPandas(solve, "entity string, community string").withColumnRenamed("community", "cluster")
    return members.select("entity").join(solved, "entity", "left").select("entity", F.coalesce("cluster", "entity").alias("community"))


def placed(members: DataFrame, entity_profiles: DataFrame, group: str = "community") -> DataFrame:
    """(entity, group, profile): members (entity, group) with their profiles (entity, profile)."""
    return members.select("entity", group).join(entity_profiles.select("entity", "profile"), "entity").select("entity", group, "profile")


def profile_pairs(rows: DataFrame, group: str = "community") -> DataFrame:
    """(a, b), a <= b: the different pairs of profiles that some group holds, a profile with itself where two members have it."""
    sized = rows.groupBy(group, "profile").agg(F.count("*").alias("n"))
    a, b = sized.select(group, F.col("profile").alias("a"), "n"), sized.select(group, F.col("profile").alias("b"))
    return a.join(b, group).where("a < b or (a = b and n > 1)").select("a", "b").distinct()


def refine_profiles(rows: DataFrame, scores: DataFrame, min_similarity: float) -> DataFrame:
    """``refine`` of rows (entity, community, profile) by scores (a, b, amb) of profiles, a <= b.

    Members of one profile that is entirely like itself are one node, which stands for all of them; others are nodes of their own."""
    alike = scores.where(F.col("a") == F.col("b")).where(_clamped(F.col("amb")) <= 1e-12).select(F.col("a").alias("profile"), F.lit(True).alias("one"))
    node = F.when(F.col("one"), F.min("entity").over(Window.partitionBy("community", "profile"))).otherwise(F.col("entity"))
    noded = materialise(rows.join(alike, "profile", "left").select("entity", "community", "profile", node.alias("node")), "nodes")
    nodes = noded.select("node", "community", "profile").distinct()
    good = scores.where(_clamped(F.col("amb")) <= 1.0 - min_similarity).select("a", "b", "amb")
    both = good.unionByName(good.where("a <> b").select(F.col("b").alias("a"), F.col("a").alias("b"), "amb"))
    x = nodes.select("community", F.col("profile").alias("a"), F.col("node").alias("x"))
    y = nodes.select("community", F.col("profile").alias("b"), F.col("node").alias("y"))
    pairs = x.join(both, "a").join(y, ["community", "b"]).where("x < y").select(F.col("x").alias("a"), F.col("y").alias("b"), "amb")
    made = refine(nodes.select(F.col("node").alias("entity"), "community"), pairs, min_similarity)
    return noded.select("entity", "node").join(made.select(F.col("entity").alias("node"), F.col("community")), "node").select("entity", "community")


def profile_similarity(rows: DataFrame, scores: DataFrame, group: str = "cluster_id") -> DataFrame:
    """``cluster_similarity`` without member pairs: rows (entity, group, profile), scores (a, b, amb) of profiles, a <= b.

    A pair of profiles counts as often as members have them: n m, or n (n - 1) / 2 for one profile."""
    sized = rows.groupBy(group, "profile").agg(F.count("*").alias("n"))
    a = sized.select(group, F.col("profile").alias("a"), F.col("n").alias("na"))
    b = sized.select(group, F.col("profile").alias("b"), F.col("n").alias("nb"))
    times = F.when(F.col("a") == F.col("b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb")).cast("double")
    pairs = a.join(b, group).where("a <= b").select(group, "a", "b", times.alias("times")).where("times > 0")
    v = F.coalesce("amb", F.lit(0.0))
    sums = pairs.join(scores.select("a", "b", "amb"), ["a", "b"], "left").groupBy(group).agg((F.sum(F.col("times") * v) / F.sum("times")).alias("sim_ave"), F.min(v).alias("sim_min"), F.max(v).alias("sim_max"))
    return sized.groupBy(group).agg(F.sum("n").alias("size")).join(sums, group, "left").select(group, "size", "sim_ave", "sim_min", "sim_max")


def refine_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row: communities and clusters made of them, communities that were split, clusters of one member, pairs to score, the
    same members before and after.

    before, after: (entity, community)."""
    a = before.select("entity", F.col("community").alias("old"))
    j = a.join(after.select("entity", F.col("community").alias("new")), "entity", "full")
    parts = j.where("old is not null").groupBy("old").agg(F.countDistinct("new").alias("parts"), F.count("*").alias("n"))
    pairs = (F.col("n") * (F.col("n") - 1) / 2).cast("bigint")
    one = parts.agg(F.count("*").alias("communities"), F.coalesce(F.sum((F.col("parts") > 1).cast("bigint")), F.lit(0)).alias("split"), F.coalesce(F.sum(pairs), F.lit(0)).alias("pairs"))
    sizes = j.where("new is not null").groupBy("new").agg(F.count("*").alias("n"))
    two = sizes.agg(F.count("*").alias("clusters"), F.coalesce(F.sum((F.col("n") == 1).cast("bigint")), F.lit(0)).alias("singletons"))
    same = j.agg((F.count("old") == F.count("new")).alias("same_members"))
    return one.crossJoin(two).crossJoin(same)  # one row each


def member_pairs(members: DataFrame) -> DataFrame:
    """(a, b), a < b, of one community: what complete linkage is defined on."""
    a, b = members.select("community", F.col("entity").alias("a")), members.select("community", F.col("entity").alias("b"))
    return a.join(b, "community").where("a < b").select("community", "a", "b")


def cluster_similarity(members: DataFrame, pair_scores: DataFrame) -> DataFrame:
    """cluster_id, size, sim_ave, sim_min, sim_max over member pairs, null scores as 0; one member: nulls.

    members: (entity, cluster_id); pair_scores: (a, b, amb), a < b."""
    size = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    s = pair_scores.join(members.select(F.col("entity").alias("a"), "cluster_id"), "a").join(members.select(F.col("entity").alias("b"), F.col("cluster_id").alias("other")), "b").where("cluster_id = other")
    v = F.coalesce("amb", F.lit(0.0))
    s = s.groupBy("cluster_id").agg(F.sum(v).alias("total"), F.min(v).alias("low"), F.max(v).alias("sim_max"), F.count("*").alias("scored"))
    pairs = F.col("size") * (F.col("size") - 1) / 2
    j = size.join(s, "cluster_id", "left")
    some = F.col("size") > 1
    return j.select("cluster_id", "size", F.when(some, F.coalesce("total", F.lit(0.0)) / pairs).alias("sim_ave"), F.when(some, F.when(F.col("scored") == pairs, F.col("low")).otherwise(F.least(F.lit(0.0), F.coalesce("low", F.lit(0.0))))).alias("sim_min"), F.when(some, F.coalesce("sim_max", F.lit(0.0))).alias("sim_max"))


def size_stats(members: DataFrame) -> DataFrame:
    """One row: clusters, singletons, least, mean, median and greatest size (zeros without clusters)."""
    s = members.groupBy("cluster_id").agg(F.count("*").alias("n"))
    return s.agg(F.count("*").alias("clusters"), F.coalesce(F.sum((F.col("n") == 1).cast("bigint")), F.lit(0)).alias("singletons"), F.coalesce(F.min("n"), F.lit(0)).alias("least"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"), F.coalesce(F.median("n"), F.lit(0.0)).alias("median"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
