import math

import pytest
from conftest import G1, G2, G3, G4, R
from pyspark.sql import functions as F

from seqgrove.operators import ontology, similarity


def test_closure_and_depth(graph):
    terms, edges, up, own, ics = graph
    assert {tuple(r) for r in up.where(F.col("term_id") == G2).collect()} == {(G2, G1, 1), (G2, R, 2)}
    assert {r.term_id: r.depth for r in ontology.reachable(edges, R).collect()} == {R: 0, G1: 1, G2: 2, G3: 2, G4: 2}


def test_closure_keeps_the_shortest_distance(spark):
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("c", "a")], "child string, parent string")
    assert {(r.term_id, r.ancestor): r.dist for r in ontology.closure(edges).collect()} == {("c", "b"): 1, ("b", "a"): 1, ("c", "a"): 1}


def test_a_cycle_ends(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a")], "child string, parent string")
    assert ontology.closure(edges).count() == 4  # each above the other and itself


def test_information_content_leaves_profiles_with_their_entities(spark, graph):
    import re

    terms, _, _, own, _ = graph
    profiles = spark.createDataFrame([("P1", G2), ("P2", G3), ("P4", "GO:9999999")], "entity string, term_id string").repartition(7, "entity")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = ontology.information_content(terms, profiles, own, R)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert not re.search(r"(SortMergeJoin|ShuffledHashJoin).*LeftSemi", plan)
        assert {r.term_id: r["count"] for r in found.collect()} == {R: 2, G1: 2, G2: 1, G3: 1, G4: 0}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_information_content(spark, graph):
    terms, edges, up, own, _ = graph
    profiles = spark.createDataFrame([("P1", G2), ("P2", G3), ("P3", G3), ("P4", "GO:9999999")], "entity string, term_id string")
    rows = {r.term_id: (r["count"], r.freq, r.ic) for r in ontology.information_content(terms, profiles, own, R).collect()}
    assert rows[R] == (3, 1.0, 0.0) and rows[G2] == (1, 1 / 3, pytest.approx(-math.log(1 / 3))) and rows[G4] == (0, 0.0, None)
    assert math.copysign(1, rows[G1][2]) == 1 and rows[G1][0] == 3
    assert ontology.checked_total(profiles, terms) == 3
    with pytest.raises(ValueError):
        ontology.checked_total(profiles.where("entity = 'P4'"), terms)
    f = ontology.direct_frequency(profiles).first()
    assert (f.least, f.median, f.mean, f.most) == (1, 1.0, pytest.approx(4 / 3), 2)
    empty = ontology.direct_frequency(profiles.limit(0)).first()
    assert tuple(empty) == (0, 0.0, 0.0, 0)


def test_namespaces_and_top_terms(spark, graph):
    a = spark.createDataFrame([("P1", "F", "EXP"), ("P1", "F", "ND"), ("P2", "F", "NAS"), ("P2", "C", "IEA")], "entity string, namespace string, evidence string")
    assert {tuple(r) for r in ontology.namespace_stats(a).collect()} == {("F", 2, 1), ("C", 1, 1)}
    assert [r.term_id for r in ontology.top_terms(graph[4], "ic", 3).collect()] == [G3, G2, G1]


def test_lin_and_reasons(spark, graph):
    terms, edges, up, own, ics = graph
    asked = [(G2, G2), (G2, G3), (G4, G3), (G3, G4), (R, R), ("x", G2), (G2, "x"), ("x", "y")]
    rows = {(r.t1, r.t2): (r.mica, r.lin, r.reason) for r in similarity.lin(spark.createDataFrame(asked, "t1 string, t2 string"), own, ics).collect()}
    assert rows[G2, G2] == (G2, 1.0, None) and rows[G2, G3] == (G1, pytest.approx(0.4), None)
    assert rows[G4, G3][1:] == (None, "missing_ic_go1") and rows[G3, G4][2] == "missing_ic_go2"
    assert rows[R, R] == (R, None, "zero_ic_denominator")
    assert [rows[k][2] for k in (("x", G2), (G2, "x"), ("x", "y"))] == ["missing_go1", "missing_go2", "missing_go1_go2"]


def test_mica_takes_the_larger_id_among_equals(spark):
    own = spark.createDataFrame([(t, a, 0) for t in ("c", "d") for a in ("a", "b", t)], "term_id string, ancestor string, dist int")
    ics = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 2.0), ("d", 2.0)], "term_id string, ic double")
    assert similarity.mica(spark.createDataFrame([("c", "d")], "t1 string, t2 string"), own, ics).first().mica == "b"


def test_set_similarity(spark, graph):
    terms, edges, up, own, ics = graph
    lin = similarity.lin(similarity.all_term_pairs(terms), own, ics)
    sets = spark.createDataFrame([("A", G2), ("A", G3), ("B", G2), ("C", R)], "entity string, term_id string")
    pairs = spark.createDataFrame([("A", "B"), ("A", "C"), ("A", "D")], "a string, b string")
    got = {r.b: (r.m12, r.m21, r.amb) for r in similarity.set_similarity(pairs, sets, lin).collect()}
    assert got["B"] == (pytest.approx(0.7), 1.0, pytest.approx(0.85)) and got["D"] == (None, None, None)
    details = {(r.side, r.source): (r.target, round(r.score, 4)) for r in similarity.best_match_details(pairs.where("b = 'B'"), sets, lin).collect()}
    assert details == {(1, G2): (G2, 1.0), (1, G3): (G2, 0.4), (2, G2): (G2, 1.0)}
    m = {(r.t1, r.t2): r.lin for r in similarity.term_matrix(lin).collect()}
    assert m[G2, G3] != 0.4 and m[G2, G3] == pytest.approx(0.4) and (R, R) not in m
