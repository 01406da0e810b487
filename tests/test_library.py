import json
import os
import re
import time
from pathlib import Path

import pytest
from conftest import G1, G2, G3, R
from pyspark.sql import functions as F
from test_sources import KB, OBO

from seqgrove import cli
from seqgrove.operators import motif_scan
from seqgrove.operators.neighbors import GraphConfig
from seqgrove.operators.scoreboard import BoardConfig
from seqgrove.plans import build, inspect, library, scan
from seqgrove.streaming.scan import scan_stream


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("lib")
    kb = "".join(f"AC   A{i:04};\nDR   GO; {G2}; F:x; EXP:Y.\nSQ   S\n     MKAAL{'AG' * (i % 3 + 1)}\n//\n" for i in range(14))
    kb += "".join(f"AC   B{i:04};\nDR   GO; {G3}; F:x; EXP:Y.\nSQ   S\n     MKCCL{'CG' * (i % 3 + 1)}\n//\n" for i in range(12))
    (d / "go.obo").write_text(OBO)
    (d / "kb.dat").write_text(kb)
    (d / "p.dat").write_text("ID   AA; PATTERN.\nAC   PS1;\nDE   Two A.\nPA   A-A.\n//\nID   CC; PATTERN.\nAC   PS2;\nDE   Two C.\nPA   C(2).\n//\nID   BAD; PATTERN.\nPA   A-{X}.\n//\n")
    cfg = build.BuildConfig(str(d / "go.obo"), str(d / "kb.dat"), str(d / "p.dat"), str(d / "out"), graph=GraphConfig(resolution=0.5), board=BoardConfig(10, 5))
    made = build.build(spark, cfg)
    assert all(made.values())
    return d, cfg


def test_build(spark, built):
    d, cfg = built
    clusters = library.load(spark, cfg.out, "clusters")
    assert sorted(r["count"] for r in clusters.groupBy("cluster_id").count().collect()) == [12, 14]
    rows = {(r.motif_id, r.tp, r.fp) for r in library.load(spark, cfg.out, "scoreboard").collect()}
    assert rows == {("AA", 14, 0), ("CC", 12, 0)}
    assert library.load(spark, cfg.out, "motifs").count() == 2
    assert json.load(open(os.path.join(cfg.out, "scoreboard_meta.json")))["totals"]["stored_weights"] == 2
    again = build.build(spark, cfg)
    assert [k for k, v in again.items() if v] == ["scoreboard"]
    build.export_tsv(spark, cfg.out, "clusters_meta", str(d / "meta"))
    assert any(p.endswith(".csv") for p in os.listdir(d / "meta"))


def test_scan(spark, built):
    d, cfg = built
    result = scan.payload(spark, scan.queries(spark, seq="xx aaxx"), cfg.out, "explicit", 1.0)
    top = result["queries"][0]["inferred_go_sets"][0]
    assert result["queries"][0]["matched_motifs"] == 1 and top["signature"] == "AA" and top["go_terms"] == [G2]
    assert top["calibrated_confidence"]["set_accuracy"] == 1.0
    text = scan.as_text(result)
    assert "Query:          sequence" in text and "Matched motifs: 1" in text and "Inferred GO sets (top 5, weight >= 1):" in text and f"1. {G2}" in text
    (d / "q.fa").write_text(">one\nXCCX\n>two\nWWW\n")
    r = scan.payload(spark, scan.queries(spark, fasta=str(d / "q.fa")), cfg.out, "explicit", 1.0, 0)
    assert [(q["query"], q["matched_motifs"]) for q in r["queries"]] == [("one", 1), ("two", 0)] and "- none" in scan.as_text(r)
    for bad in ({}, {"seq": "A", "fasta": "x"}):
        with pytest.raises(ValueError):
            scan.queries(spark, **bad)


def test_inspect(spark, built):
    d, cfg = built
    terms = library.load(spark, cfg.out, "terms")
    assert "terms: 5" in inspect.summary(terms)
    assert f"parents: {G1}" in inspect.term(terms, G2, True)
    with pytest.raises(KeyError):
        inspect.term(terms, "GO:1")
    s = inspect.similarity_of(spark, terms, G2, G3)
    said = inspect.similarity_text(terms, s)
    assert s["mica"] in (G1, R) and "Common ancestors:" in said and "[A]" in said and "Formula: Lin(A, B)" in said
    profiles, meta = library.load(spark, cfg.out, "profiles"), library.load(spark, cfg.out, "clusters_meta")
    t = inspect.set_similarity_of(spark, terms, profiles, f"({G2})", "A0001", meta)
    assert t["similarity"] == 1.0 and f"B query: A0001 ({G2})" in inspect.set_similarity_text(t)
    assert inspect.set_similarity_of(spark, terms, profiles, "GO:9999999", G2)["reason"] == "empty_cleaned_set"
    assert inspect.function_of(terms, "A0001", inspect.resolve_terms("A0001", profiles)).summary == "A0001 is annotated as a child."
    c = inspect.cluster_of(spark, cfg.out, "cluster_0001")
    text = inspect.cluster_text(c)
    assert "Cluster ID:      cluster_0001" in text and "1. AA" in text and "Odds ratio:  inf" in text
    with pytest.raises(KeyError):
        inspect.cluster_of(spark, cfg.out, "cluster_9999")


def test_cli(spark, built, tmp_path, monkeypatch):
    d, cfg = built
    assert cli.run(["version"]) and "Matched motifs: 1" in cli.run(["scan", "--seq", "XXAAXX", "--library-dir", cfg.out])
    assert cli.run(["scan", "--seq", "XXAAXX", "--library-dir", cfg.out, "--json-out", str(tmp_path / "o.json")]) == ""
    assert json.load(open(tmp_path / "o.json"))["top_n"] == 5
    assert cli.run(["inspect", "go-set-sim", G2, "A0001", "--library-dir", cfg.out]) == "1"
    assert json.loads(cli.run(["inspect", "cluster", "cluster_0001", "--library-dir", cfg.out, "--json"]))["size"] == 14
    monkeypatch.chdir(cfg.out)
    assert "Library:       current-directory" in cli.run(["scan", "--seq", "W"])


def test_exports_panel_and_tolerant_scan(spark, built, tmp_path):
    import shutil

    d, cfg = built
    names = [n for n in build.EXPORTS]
    args = ["build-library", "--obo", cfg.obo, "--knowledge-base", cfg.knowledge_base, "--prosite", cfg.prosite, "--out", str(tmp_path / "lib"), "--motif-scan-processes", "2"]
    (tmp_path / "graph.yaml").write_text("graph:\n  resolution: 0.5\n")
    cli.run([*args, "--cluster-config", str(tmp_path / "graph.yaml"), *(x for n in names for x in (f"--{n.replace('_', '-')}-out", str(tmp_path / n)))])
    said = {n: (tmp_path / n).read_text() for n in names}
    assert said["motif_hits"].startswith("accession\tmotif_id\nA0000\tAA\n") and said["motif_hits"].endswith("# completed\ttrue\n")
    assert said["clusters"].splitlines()[:2] == ["member_id\tcluster_id", "A0000\tcluster_0001"] and "Top terms by ic" in said["report"]
    assert said["profiles"].splitlines()[0] == f"A0000\t{G2}" and said["fasta"].startswith(">A0000\nMKAAL") and json.loads(said["go_json"].splitlines()[0])["term_id"]
    stats = json.loads(said["stats"])
    assert stats["motifs"] == {"total": 3, "patterns": 3, "skipped": 0, "failed": 1} and stats["clustering"]["clustered"] == 26 and stats["clustering"]["same_members"] and stats["sequences"]["sequences"] == 26
    assert library.load(spark, str(tmp_path / "lib"), "motif_failures").first().name == "BAD"
    assert library.sequence_of(spark, str(tmp_path / "lib"), "A0000", cfg.knowledge_base).startswith("MKAAL") and library.sequence_of(spark, str(tmp_path / "lib"), "none") is None
    with pytest.raises(ValueError):
        library.sequence_of(spark, str(tmp_path / "lib"), "A0000", cfg.obo)
    with pytest.raises(ValueError):
        build.BuildConfig("a", "b", "c", "d", exports={"x": "y"})
    # clusters of the same parent are alike enough for a panel
    line = cli.run(["panel", "--library-dir", str(tmp_path / "lib"), "--out", str(tmp_path / "panel"), "--clusters", "2", "--members", "2", "--low", "0", "--high", "1", "--most-identity", "0.99"])
    assert line.startswith("2 clusters, 4 members") and json.load(open(tmp_path / "panel" / "summary.json"))["clusters"] == ["cluster_0001", "cluster_0002"]
    with pytest.raises(ValueError):
        cli.run(["panel", "--library-dir", str(tmp_path / "lib"), "--out", str(tmp_path / "panel"), "--clusters", "1"])
    assert json.loads(cli.run(["inspect", "go-term", G2, "--json", "--ancestors", "--library-dir", cfg.out]))["ancestor_terms"] and json.loads(cli.run(["inspect", "go-summary", "--json", "--library-dir", cfg.out]))["terms"] == 5
    for t in ("calibration", "terms", "profiles"):
        shutil.rmtree(tmp_path / "lib" / t)
    assert "Confidence:     NA" in cli.run(["scan", "--seq", "XXAAXX", "--library-dir", str(tmp_path / "lib")])


def test_library_folders(tmp_path, built):
    d, cfg = built
    with pytest.raises(FileNotFoundError):
        library.resolve(str(tmp_path))
    library.package(cfg.out, str(tmp_path / "p"))
    assert library.resolve(str(tmp_path / "p"))[1] == "explicit" and library.resolve(None, str(tmp_path), str(tmp_path / "p"))[1] == "packaged"
    with pytest.raises(FileNotFoundError):
        library.package(str(tmp_path), str(tmp_path / "q"))


def test_freshness(tmp_path):
    need, out = tmp_path / "need", tmp_path / "out"
    with pytest.raises(FileNotFoundError):
        library.is_stale(str(out), [str(need)])
    need.write_text("x")
    assert library.is_stale(str(out), [str(need)])
    out.write_text("y")
    os.utime(need, (1, 1))
    assert not library.is_stale(str(out), [str(need)]) and library.is_stale(str(out), [str(need)], True)
    assert library.is_stale(str(out), [str(need)], params={"a": 1})
    library.write_params(str(out), {"a": 1})
    assert not library.is_stale(str(out), [str(need)], params={"a": 1})
    later = time.time() + 100
    os.utime(need, (later, later))
    assert library.is_stale(str(out), [str(need)])


def test_stream(spark, tmp_path):
    spark.createDataFrame([("P1", "XXAA"), ("P2", "B")], "accession string, sequence string").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("accession string, sequence string").parquet(str(tmp_path / "in"))
    q = scan_stream(stream, [("A", "AA")]).writeStream.format("memory").queryName("stream_hits").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.table("stream_hits").collect()] == [("P1", "A")]
    assert motif_scan.scan(spark.table("stream_hits").selectExpr("accession", "'AA' as sequence"), [("A", "AA")]).count() == 1


def test_incremental_rebuild_equals_a_full_one(spark, tmp_path):
    """A changed entry rewrites only its part, and counts by signed deltas are those of a full build."""
    import random

    from seqgrove.operators import scoreboard
    from seqgrove.plans import incremental

    rng = random.Random(17)
    members = {f"e{i:03}": rng.choice(["c1", "c2", "c3"]) for i in range(200)}
    hits = {(e, m) for e in members for m in ("m1", "m2", "m3") if rng.random() < 0.4}
    frame = lambda rows, names: spark.createDataFrame(sorted(rows), names)
    tables = lambda: (frame(hits, "entity string, motif_id string"), frame(members.items(), "entity string, cluster_id string"))
    folders = [str(tmp_path / n) for n in ("hits", "members")]
    first = [incremental.update(t, f, "entity", 16) for t, f in zip(tables(), folders)]
    assert all(v.parts == list(range(16)) and v.before.count() == 0 for v in first)
    files = lambda: {p: p.stat().st_mtime_ns for f in folders for p in (Path(f) / "rows").rglob("*.parquet")}
    tp, sizes = (t.cache() for t in incremental.counts(*tables()))
    tp.count(), sizes.count()
    there = files()
    assert [incremental.update(t, f, "entity", 16).parts for t, f in zip(tables(), folders)] == [[], []] and files() == there
    # one moves, one goes, one comes, one loses a hit
    changed = {"e000", "e001", "new", "e002"}
    members["e000"] = "c9"
    del members["e001"]
    members["new"] = "c1"
    hits = {h for h in hits if h[0] != "e001"} - {("e002", m) for m in ("m1", "m2", "m3")} | {("new", "m1"), ("e002", "m4")}
    new = [incremental.update(t, f, "entity", 16) for t, f in zip(tables(), folders)]
    assert all(0 < len(v.parts) <= len(changed) for v in new)
    kept = {p for p in there if int(re.search(r"part=(\d+)", str(p)).group(1)) not in {*new[0].parts, *new[1].parts}}
    assert kept and all(files()[p] == there[p] for p in kept)
    for t, f in zip(tables(), folders):
        assert sorted(map(tuple, incremental.load(spark, f, t.schema).collect())) == sorted(map(tuple, t.collect()))
    # the changed entities, of whom both tables are whole
    parts = sorted({*new[0].parts, *new[1].parts})
    of = lambda t, these: incremental.parted(t, "entity", 16).where(F.col("part").isin(these)).drop("part")
    old_tables = [v.before.unionByName(of(t, [p for p in parts if p not in v.parts])) for v, t in zip(new, tables())]
    tp, sizes = incremental.updated_counts(tp, sizes, tuple(old_tables), tuple(of(t, parts) for t in tables()))
    full = incremental.counts(*tables())
    assert sorted(map(tuple, tp.collect())) == sorted(map(tuple, full[0].collect())) and sorted(map(tuple, sizes.collect())) == sorted(map(tuple, full[1].collect()))
    cfg = scoreboard.BoardConfig(min_cluster_size=5, min_support=2)
    assert sorted(map(str, incremental.board(tp, sizes, cfg).collect())) == sorted(map(str, scoreboard.weighted(scoreboard.contingency(*tables(), cfg), cfg).collect()))
