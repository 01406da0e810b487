import random
from itertools import combinations
import math

import pytest

from seqgrove.operators import panel, predict, roles, scoreboard
from conftest import G1, G2, G3, R


def members(spark, sizes):
    return spark.createDataFrame([(f"{p}{i}", c) for p, c, n in sizes for i in range(1, n + 1)], "entity string, cluster_id string")


def board(spark, sizes, hits, cfg=scoreboard.BoardConfig()):
    m = members(spark, sizes)
    raw = spark.createDataFrame(hits, "accession string, motif_id string")
    h = scoreboard.clean_hits(raw, m)
    return m, raw, h, scoreboard.weighted(scoreboard.contingency(h, m, cfg), cfg)


def test_contingency_and_counters(spark):
    hits = [(f"A{i}", "strong") for i in range(1, 7)] + [("B1", "strong"), ("B2", "strong"), ("Z1", "strong"), ("A1", "strong")]
    hits += [(f"A{i}", "low") for i in range(1, 5)] + [(f"A{i}", "flat") for i in range(1, 6)] + [(f"B{i}", "flat") for i in range(1, 11)]
    m, raw, h, rated = board(spark, [("A", "0001", 10), ("B", "0002", 15), ("C", "0003", 5)], hits)
    rows = {(r.motif_id, r.cluster_id): r for r in rated.collect()}
    s = rows["strong", "0001"]
    assert (s.tp, s.fp, s.fn, s.tn) == (6, 2, 4, 18) and s.weight == pytest.approx(math.log2((6.5 / 11) / (2.5 / 21)))
    c = scoreboard.counters(h, m, rated, raw).first().asDict()
    assert (c["accessions"], c["clusters"], c["clusters_below_min_size"], c["eligible_clusters"], c["motifs"]) == (30, 3, 1, 2, 3)
    assert (c["ignored_cluster_size"], c["ignored_low_support"], c["ignored_non_positive_weight"], c["stored_weights"]) == (3, 3, 1, 2)
    assert (c["motif_hits_outside_clusters"], c["duplicate_motif_hits"]) == (1, 1)
    assert c["eligible_clusters"] * c["motifs"] == sum(c[k] for k in ("ignored_low_support", "ignored_background_unavailable", "ignored_non_positive_weight", "stored_weights"))


def test_no_false_positives(spark):
    *_, rated = board(spark, [("A", "0001", 10), ("B", "0002", 10)], [("A1", "m")], scoreboard.BoardConfig(10, 1))
    assert rated.first().weight == pytest.approx(math.log2(3))


def test_one_cluster_has_no_background(spark):
    *_, rated = board(spark, [("A", "0001", 10)], [(f"A{i}", "m") for i in range(1, 7)])
    assert rated.first().status == "background_unavailable"


def test_calibration(spark):
    m, raw, h, rated = board(spark, [("A", "0001", 10), ("B", "0002", 10), ("S", "0003", 4)], [(f"A{i}", "m") for i in range(1, 6)])
    rows = {r.threshold: r for r in scoreboard.calibration(h, m, scoreboard.weights(rated)).collect()}
    assert len(rows) == 13
    for t in (2.0, 3.0):
        r = rows[t]
        assert (r.eligible, r.covered, r.coverage, r.top1_accuracy, r.top3_accuracy, r.set_accuracy, r.avg_predictions) == (20, 5, 0.25, 1.0, 1.0, 1.0, 1.0)
    r = rows[4.0]
    assert (r.covered, r.coverage, r.top1_accuracy, r.set_accuracy, r.avg_predictions) == (0, 0.0, None, None, 0.0)


def test_calibration_equals_a_naive_count(spark):
    import random

    rng = random.Random(9)
    sizes = [("A", "c1", 12), ("B", "c2", 14), ("C", "c3", 11)]
    names = [f"{p}{i}" for p, _, n in sizes for i in range(1, n + 1)]
    hits = sorted({(rng.choice(names), f"m{rng.randrange(6)}") for _ in range(200)} | {(x, f"m{'ABC'.index(x[0])}") for x in names if rng.random() < 0.8})
    m, raw, h, rated = board(spark, sizes, hits, scoreboard.BoardConfig(10, 2))
    weights = {(r.motif_id, r.cluster_id): r.weight for r in scoreboard.weights(rated).collect()}
    home = {r.entity: r.cluster_id for r in m.collect()}
    for r in scoreboard.calibration(h, m, scoreboard.weights(rated), scoreboard.BoardConfig(10, 2), (0.1, 0.5, 1.0, 2.0)).collect():
        covered = top1 = top3 = inside = preds = 0
        for x in names:
            best = {}
            for a, mo in hits:
                for (mm, c), w in weights.items():
                    if a == x and mm == mo and w >= r.threshold:
                        best[c] = max(best.get(c, -9), w)
            order = sorted(best, key=lambda c: (-best[c], c))
            if order:
                covered += 1
                preds += len(order)
                top1 += order[0] == home[x]
                top3 += home[x] in order[:3]
                inside += home[x] in order
        assert r.covered == covered
        if covered:
            assert (r.top1_accuracy, r.top3_accuracy, r.set_accuracy, r.avg_predictions) == (top1 / covered, top3 / covered, inside / covered, preds / covered)


def test_predictions(spark):
    b = spark.createDataFrame([("A", f"cluster_000{i}", 6.6 - i / 10) for i in range(1, 7)] + [("B", "cluster_0001", 6.0)], "motif_id string, cluster_id string, weight double")
    meta = spark.createDataFrame([("cluster_0001", ["GO:0004672", "GO:0005524"], "a kinase")] + [(f"cluster_000{i}", [f"GO:000000{i}"], "x") for i in range(2, 6)], "cluster_id string, composed_go array<string>, description string")
    hits = spark.createDataFrame([("q1", "A", 0), ("q2", "B", 1)], "accession string, motif_id string, ordinal int")
    p = predict.cluster_predictions(hits, b)
    cal = spark.createDataFrame([(5.0, 0.91, 0.8, 0.9, 0.4)], "threshold double, set_accuracy double, top1_accuracy double, top3_accuracy double, coverage double")
    rows = predict.confidence(predict.function_sets(p, meta), cal).orderBy("query", "rank").collect()
    q1 = [r for r in rows if r["query"] == "q1"]
    assert len(q1) == 5 and q1[0].terms == ["GO:0004672", "GO:0005524"] and q1[0].weight == 6.5 and q1[0].confidence.set_accuracy == 0.91
    assert [r.weight for r in rows if r["query"] == "q2"] == [6.0]
    everything = predict.function_sets(p, meta, 0).where("query = 'q1'").collect()
    assert len(everything) == 6 and [r.description for r in everything if r.terms == ["cluster_0006"]] == ["NA"]
    low = predict.confidence(p.selectExpr("query", "1.0D as weight"), cal).first()
    assert low.confidence is None
    with pytest.raises(ValueError):
        predict.function_sets(p, meta, -1)


def test_roles(spark, graph):
    from pyspark.sql import functions as F

    terms = spark.createDataFrame([(R, "molecular_function"), (G1, "catalytic activity"), (G2, "child activity"), (G3, "protein binding"), ("GO:0000009", "odd")], "term_id string, name string")
    own = spark.createDataFrame([(G1, G1), (G1, R), (G2, G2), (G2, G1), (G2, R), (G3, G3), (G3, R), ("GO:0000009", "GO:0000009")], "term_id string, ancestor string")
    anchors = spark.createDataFrame([("catalytic", 100, G1, 0), ("late", 100, G1, 1)], "role string, priority int, term_id string, ord int")
    words = spark.createDataFrame([("binding_generic", 20, "Binding", 0), ("weak", 10, "activity", 1)], "role string, priority int, keyword string, ord int")
    rows = {r.term_id: (r.role, r.priority, r.source, r.matched) for r in roles.semantic_roles(terms, own, graph[4], anchors, words, R).collect()}
    assert rows == {G1: ("catalytic", 100, "anchor", G1), G2: ("catalytic", 100, "anchor", G1), G3: ("binding_generic", 20, "keyword", "Binding"), "GO:0000009": ("unknown", 0, "unknown", None)}
    equal = words.withColumn("priority", F.lit(100))
    assert {r.term_id: r.source for r in roles.semantic_roles(terms, own, graph[4], anchors, equal, R).collect()}[G1] == "keyword"
    assert roles.unknown_terms(roles.semantic_roles(terms, own, graph[4], anchors, words, R), terms).first().name == "odd"


def test_identity_of_large_clusters_goes_by_blocks(spark, monkeypatch):
    """A cluster of several blocks against every pair; rows of one entity are no pair, equal rows count each, however often they stand."""
    rng = random.Random(3)
    rows = [(str(i % 2), f"e{i % 37}", "".join(rng.choice("ACé") for _ in range(rng.randint(0, 300 if i % 9 == 0 else 9)))) for i in range(120)]
    rows += rows[:30] + [("2", "a", "A"), ("2", "a", "C"), ("3", "a", ""), ("3", "b", ""), ("4", "a", None), ("4", "b", "A")]
    monkeypatch.setattr(panel, "BLOCK_ROWS", 16)
    got = {r.cluster_id: r for r in panel.identity_of(spark.createDataFrame(rows, "cluster_id string, entity string, sequence string")).collect()}
    for c in "01":
        own = [(e, s) for k, e, s in rows if k == c]
        want = [panel.same_positions(s, t) for i, (e, s) in enumerate(own) for f, t in own[i + 1 :] if e != f]
        assert got[c].pairs == len(want) and (got[c].mean, got[c].most, got[c].least) == pytest.approx((sum(want) / len(want), max(want), min(want)))
    assert "2" not in got and tuple(got["3"])[1:] == (1, 0.0, 0.0, 0.0) and tuple(got["4"])[1:] == (1, None, None, None)


def test_panel(spark):
    s = spark.createDataFrame([("a", "ACDE"), ("b", "ACDF"), ("c", "AC")], "accession string, sequence string")
    m = spark.createDataFrame([(x, "k") for x in "abc"], "entity string, cluster_id string")
    r = panel.identity_stats(m, s).first()
    assert (r.pairs, r.most, r.least) == (3, 0.75, 0.5) and panel.same_positions("ACDE", "AC") == 0.5 and panel.same_positions("", "") == 0
    assert panel.diverse({"a": "AAAA", "b": "AAAA", "c": "CCCC"}, 2) == ["a", "c"]
    assert panel.diverse({"a": "AAAA", "b": "AAAA"}, 2) is None
    sim = {("x", "y"): 0.6, ("x", "z"): 0.7, ("y", "z"): 0.1}
    got = panel.panel(["x", "y", "z"], sim, 2)
    assert len(got) == 2 and set(got) != {"y", "z"} and panel.panel(["x", "y", "z"], sim, 3) is None
    assert panel.matrix(["x", "y"], sim) == [[1.0, 0.6], [0.6, 1.0]]
    sizes = spark.createDataFrame([("a", 9), ("b", 8), ("c", 1), ("d", 7), ("e", 6)], "cluster_id string, size long")
    some = [r.cluster_id for r in panel.prefilter(sizes, sizes.where("cluster_id <> 'e'"), 2, 3).collect()]
    assert some[0] == "a" and set(some) == {"a", "b", "d"} and panel.prefilter(sizes, sizes, 7, 9).count() == 3


def test_exact_panel_equals_brute_force(spark):
    rng = random.Random(7)
    names = [f"c{i:02}" for i in range(20)]
    sim = {(a, b): rng.random() for a, b in combinations(names, 2)}
    for n, low in ((2, 0.5), (4, 0.35), (5, 0.3), (6, 0.45)):
        ok = lambda g: all(low <= sim[p] <= 0.8 for p in combinations(g, 2))
        assert panel.exact_panel(spark, names, sim, n, low, 0.8) == next((list(g) for g in combinations(names, n) if ok(g)), None)


def test_pools_and_diverse_members(spark):
    rng = random.Random(3)
    rows = [(f"e{i:03}", "abc"[i % 3]) for i in range(90)] + [("lone", "d")]
    seqs = {e: "".join(rng.choice("AC") for _ in range(12)) for e, _ in rows}
    members = spark.createDataFrame(rows, "entity string, cluster_id string")
    pool = panel.pools(members, spark.createDataFrame(list(seqs.items()), "accession string, sequence string"), 10, 1)
    drawn = {}
    for r in pool.orderBy("turn").collect():
        drawn.setdefault(r.cluster_id, {})[r.entity] = r.sequence
    assert {c: len(x) for c, x in drawn.items()} == {"a": 10, "b": 10, "c": 10, "d": 1}
    got = {}
    for r in panel.diverse_members(pool, 3, 0.75).orderBy("place").collect():
        got.setdefault(r.cluster_id, []).append(r.entity)
    assert got == {c: some for c, x in drawn.items() if (some := panel.diverse(x, 3, 0.75))} and "d" not in got
