import random
from itertools import combinations

import numpy as np
import pytest
from conftest import G1, G2, G3
from pyspark.sql import functions as F

from seqgrove.operators import community, linkage, neighbors, signature, similarity
from seqgrove.operators.components import components


def profiles(spark, rows):
    return spark.createDataFrame([(e, t) for e, ts in rows.items() for t in ts], "entity string, term_id string")


def test_candidate_index_with_fallback(spark, graph):
    terms, edges, up, own, ics = graph
    members, sets = neighbors.grouped(profiles(spark, {"P1": [G2], "P2": [G3], "P3": [G1]}))
    rows = {(r.profile, r.term_id, r.fallback) for r in neighbors.candidate_index(members, sets, own, ics, neighbors.GraphConfig(max_posting_fraction=0.34)).collect()}
    assert rows == {(G2, G2, False), (G3, G3, False), (G1, G1, True)}
    assert neighbors.GraphConfig(max_posting_fraction=0.34).cap(3) == 2


def scores(graph):
    terms, edges, up, own, ics = graph
    return similarity.term_matrix(similarity.lin(similarity.all_term_pairs(terms), own, ics))


def test_knn_ties(spark, graph):
    p = profiles(spark, {f"P{i}": [G2] for i in range(1, 6)})
    e = neighbors.knn_edges(p, graph[3], graph[4], scores(graph), neighbors.GraphConfig(neighbors=2, max_posting_fraction=1.0))
    rows = {(r.src, r.dst): r.weight for r in e.collect()}
    assert set(rows.values()) == {1.0} and ("P1", "P5") in rows and ("P2", "P5") in rows and ("P3", "P5") not in rows


@pytest.mark.parametrize("floor, n", [(0.4, 1), (0.400001, 0)])
def test_knn_threshold(spark, graph, floor, n):
    p = profiles(spark, {"P1": [G2], "P2": [G3]})
    e = neighbors.knn_edges(p, graph[3], graph[4], scores(graph), neighbors.GraphConfig(neighbors=1, min_similarity=floor, max_posting_fraction=1.0))
    assert e.count() == n


def test_config_refuses():
    for bad in ({"neighbors": 0}, {"min_similarity": 1.5}, {"max_posting_fraction": 0}, {"resolution": 0}):
        with pytest.raises(ValueError):
            neighbors.GraphConfig(**bad)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)]
    label = {x: x for e in edges for x in e}
    while True:
        new = {x: min([label[x]] + [label[b] for a, b in edges if a == x] + [label[a] for a, b in edges if b == x]) for x in label}
        if new == label:
            break
        label = new
    got = {r.u: r.v for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert got == {x: r for x, r in label.items() if x != r}
    assert components(spark.createDataFrame([(1, 1), (None, 2)], "u int, v int")).count() == 0


def quality(label, edges, gamma):
    m = sum(w for *_, w in edges)
    k = {}
    for a, b, w in edges:
        k[a] = k.get(a, 0) + w
        k[b] = k.get(b, 0) + w
    inside = sum(w for a, b, w in edges if label[a] == label[b])
    return inside - gamma * sum(sum(k.get(v, 0) for v in range(len(label)) if label[v] == c) ** 2 for c in set(label)) / (4 * m)


def test_leiden_finds_cliques():
    edges = [(a, b, 1.0) for g in (range(0, 5), range(5, 10), range(10, 15)) for a, b in combinations(g, 2)] + [(4, 5, 0.1), (9, 10, 0.1)]
    label = community.leiden(15, edges, 1.0).tolist()
    assert [len(set(label[i : i + 5])) for i in (0, 5, 10)] == [1, 1, 1] and len(set(label)) == 3
    rng = random.Random(2)
    noisy = [(a, b, rng.random()) for a, b in combinations(range(14), 2) if rng.random() < 0.3]
    got = community.leiden(14, noisy, 1.0).tolist()
    assert quality(got, noisy, 1.0) >= quality(list(range(14)), noisy, 1.0)


def test_communities_and_ids(spark):
    rows = [("a", "b", 1.0), ("b", "c", 1.0), ("a", "c", 1.0), ("x", "y", 0.5)]
    c = community.communities(spark.createDataFrame(rows, "src string, dst string, weight double"), 1.0)
    assert {r.entity: r.community for r in c.collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x"}
    assert {r.entity: r.cluster_id for r in community.stable_ids(c).collect()} == {"a": "cluster_0001", "b": "cluster_0001", "c": "cluster_0001", "x": "cluster_0002", "y": "cluster_0002"}


def naive_linkage(dist, cut):
    groups = [{i} for i in range(len(dist))]
    while True:
        best = min(((max(dist[a, b] for a in x for b in y), i, j) for (i, x), (j, y) in combinations(enumerate(groups), 2)), default=(9,))
        if best[0] > cut:
            return {frozenset(g) for g in groups}
        groups[best[1]] |= groups[best[2]]
        del groups[best[2]]


def test_complete_linkage_equals_brute_force():
    rng = np.random.default_rng(4)
    for n in (2, 3, 7, 12):
        x = rng.random((n, n))
        d = (x + x.T) / 2
        np.fill_diagonal(d, 0)
        for cut in (0.2, 0.5, 0.8):
            label = linkage.complete_linkage(d, cut)
            assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist())} == naive_linkage(d, cut)


def test_sparse_linkage_equals_the_full_one():
    rng = np.random.default_rng(14)
    for n in (1, 2, 5, 9, 16, 30):
        for cut in (0.15, 0.4, 0.6, 0.95):
            x = rng.random((n, n))
            d = (x + x.T) / 2
            near = [{j: d[i, j] for j in range(n) if j != i and d[i, j] <= cut} for i in range(n)]
            np.fill_diagonal(d, 0)
            label = linkage.sparse_linkage(n, near)
            assert {frozenset(np.flatnonzero(label == c).tolist()) for c in set(label.tolist())} == naive_linkage(d, cut)
            assert all(min(np.flatnonzero(label == c)) == c for c in set(label.tolist()))


def test_profiles_stand_for_their_members(spark):
    """Distinct profiles with multiplicities give what all pairs of members give."""
    rng = random.Random(6)
    names = "abcdef"
    score = {(x, y): rng.random() if x != y else rng.choice([1.0, 1.0, 0.7, None]) for i, x in enumerate(names) for y in names[i:]}
    rows = [(f"e{i:02}", f"g{i % 2}", rng.choice(names)) for i in range(26)]
    placed = spark.createDataFrame(rows, "entity string, community string, profile string")
    scores = spark.createDataFrame([(a, b, s) for (a, b), s in score.items()], "a string, b string, amb double")
    of = lambda p, q: score[min(p, q), max(p, q)] or 0.0
    pairs = [(a, b, of(p, q)) for a, g, p in rows for b, h, q in rows if a < b and g == h]
    assert {tuple(r) for r in linkage.profile_pairs(placed).collect()} <= set(score)
    full = linkage.cluster_similarity(placed.select("entity", F.col("community").alias("cluster_id")), spark.createDataFrame(pairs, "a string, b string, amb double"))
    short = linkage.profile_similarity(placed.withColumnRenamed("community", "cluster_id"), scores)
    for x, y in zip(full.orderBy("cluster_id").collect(), short.orderBy("cluster_id").collect()):
        assert tuple(x)[:2] == tuple(y)[:2] and tuple(y)[2:] == pytest.approx(tuple(x)[2:])
    got = {}
    for r in linkage.refine_profiles(placed, scores, 0.5).collect():
        got.setdefault(r.community, set()).add(r.entity)
    kind = {e: (g, p) for e, g, p in rows}
    assert sorted(x for g in got.values() for x in g) == sorted(kind) and all(min(g) == c for c, g in got.items())
    assert all(kind[a][0] == kind[b][0] and of(kind[a][1], kind[b][1]) >= 0.5 for g in got.values() for a, b in combinations(g, 2))
    for g, h in combinations(got.values(), 2):  # no two of one community could be one
        assert kind[min(g)][0] != kind[min(h)][0] or any(of(kind[a][1], kind[b][1]) < 0.5 for a in g for b in h)


def test_large_components_are_solved_in_rounds(spark):
    rng = random.Random(15)
    n, found = 120, {}
    for i in range(n):
        for _ in range(5):
            j = rng.randrange(n) if rng.random() < 0.15 else i // 12 * 12 + rng.randrange(12)
            if i != j:
                found[min(i, j), max(i, j)] = rng.random()
    rows = [(f"v{a:03}", f"v{b:03}", w) for (a, b), w in found.items()] + [("x", "y", 0.5)]
    edges = spark.createDataFrame(rows, "src string, dst string, weight double")
    kernel, rounds = community.communities(edges, 2.0), community.communities(edges, 2.0, task_edges=250).cache()
    assert len(rows) > 300 and rounds.count() == rounds.select("entity").distinct().count() == kernel.count()
    score = lambda g: community.quality(edges, g, 2.0).first().quality
    assert score(rounds) >= 0.97 * score(kernel) > 0
    assert rounds.groupBy("community").agg(F.min("entity").alias("least")).where("least <> community").count() == 0
    label = {r.entity: r.community for r in rounds.collect()}
    inner = spark.createDataFrame([(a, b) for a, b, _ in rows if label[a] == label[b]], "u string, v string")
    root = {r.u: r.v for r in components(inner).collect()}
    assert all(root.get(e, e) == c for e, c in label.items())


def test_rounds_of_moves_never_lower_the_quality(spark):
    from seqgrove.operators import community_rounds as rounds

    rng = random.Random(16)
    found = {(a, b): rng.random() for a, b in combinations(range(40), 2) if rng.random() < 0.2}
    names = [f"v{i:02}" for i in range(40)]
    edges = spark.createDataFrame([(names[a], names[b], w) for (a, b), w in found.items()], "src string, dst string, weight double")
    both = spark.createDataFrame([(names[x], names[y], w) for (a, b), w in found.items() for x, y in ((a, b), (b, a))], "v string, u string, w double")
    m2 = 2 * sum(found.values())
    now = both.groupBy("v").agg(F.sum("w").alias("k")).select("v", "k", F.col("v").alias("own"))
    score = lambda v: community.quality(edges, v.select(F.col("v").alias("entity"), F.col("own").alias("community")), 1.0).first().quality
    last = score(now)
    for _ in range(4):
        now = rounds.local_moves(both, now, 1.0, m2, rounds=1)
        assert score(now) >= last - 1e-12
        last = score(now)
    assert last > score(both.groupBy("v").agg(F.sum("w").alias("k")).select("v", "k", F.col("v").alias("own")))


def test_refine(spark):
    members = spark.createDataFrame([("P1", "P1"), ("P2", "P1"), ("P3", "P1"), ("P4", "P4")], "entity string, community string")
    s = spark.createDataFrame([("P1", "P2", 0.4), ("P1", "P3", 0.6), ("P2", "P3", None)], "a string, b string, amb double")
    got = {r.entity: r.community for r in linkage.refine(members, s, 0.5).collect()}
    assert got == {"P1": "P1", "P3": "P1", "P2": "P2", "P4": "P4"}
    c = linkage.cluster_similarity(members.withColumnRenamed("community", "cluster_id"), s)
    rows = {r.cluster_id: (r["size"], r.sim_ave, r.sim_min, r.sim_max) for r in c.collect()}
    assert rows == {"P1": (3, pytest.approx(1 / 3), 0.0, 0.6), "P4": (1, None, None, None)}
    assert tuple(linkage.size_stats(members.withColumnRenamed("community", "cluster_id")).first()) == (2, 1, 1, 2.0, 2.0, 3)


def test_signature_fold():
    cfg = signature.SignatureConfig()
    chain = [(f"g{i:02}", 1.0, float(i)) for i in range(11, 0, -1)]
    assert [x[0] for x in signature.fold(chain, {}, cfg)] == [f"g{i:02}" for i in range(11, 1, -1)]
    assert [x[0] for x in signature.fold([("child", 0.25, 1.25), ("parent", 1.0, 1.0)], {"child": {"parent"}}, cfg)] == ["parent"]
    assert [x[0] for x in signature.fold([("child", 0.9, 2.0), ("parent", 1.0, 1.0)], {"child": {"parent"}}, cfg)] == ["child"]
    assert [x[0] for x in signature.fold([("a", 1.0, 4.0), ("b", 1.0, 1.9)], {}, cfg)] == ["a"]


def test_signatures(spark, graph):
    terms, edges, up, own, ics = graph
    members = spark.createDataFrame([("P1", "c1"), ("P2", "c1"), ("P3", "c1")], "entity string, cluster_id string")
    p = profiles(spark, {"P1": [G2], "P2": [G2], "P3": [G2, G3]})
    v = {r.term_id: (round(r.support, 3), round(r.score, 3)) for r in signature.votes(members, p, own, ics).collect()}
    assert v == {G1: (1.0, 1.0), G2: (1.0, 2.0), G3: (0.333, 1.0)}
    s = signature.signatures(signature.votes(members, p, own, ics), up)
    assert signature.composed(s).first().composed_go == [G2, G3]


def test_neighbours_of_one_profile_are_dealt_by_entity(spark, monkeypatch):
    from seqgrove import storage
    from seqgrove.operators import neighbors

    profiles = spark.range(100).selectExpr("format_string('E%03d', id) as entity", "'t' as term_id")
    ics = spark.createDataFrame([("t", 1.0)], "term_id string, ic double")
    own = spark.createDataFrame([("t", "t")], "term_id string, ancestor string")
    scores = spark.createDataFrame([("t", "t", 1.0)], "t1 string, t2 string, lin double")
    monkeypatch.setattr(storage, "TASK_ROWS", 100)
    e = neighbors.knn_edges(profiles, own, ics, scores)
    assert e.rdd.getNumPartitions() >= 10  # 100 entities, ten neighbours each
    assert {(r.src, r.dst) for r in e.collect()} == {tuple(sorted((f"E{a:03}", f"E{b:03}"))) for a in range(100) for b in [x for x in range(11) if x != a][:10]}
