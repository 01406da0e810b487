"""Panels for simulations: clusters of moderate likeness, and members of each that are not too alike."""

from __future__ import annotations

import json
import os
import random
from dataclasses import asdict, dataclass

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from seqgrove.operators import linkage, panel, similarity
from seqgrove.plans import library as lib
from seqgrove.plans.build import export_file, reflexive_of


@dataclass(frozen=True)
class PanelConfig:
    clusters: int = 4
    members: int = 5
    candidates: int = 200
    low: float = 0.5
    high: float = 0.8
    most_identity: float = 0.9
    attempts: int = 1000
    pool: int = 20
    seed: int = 1

    def __post_init__(self):
        if self.pool < self.members:
            raise ValueError("pool is at least members")
        if self.clusters < 2 or self.members < 2 or self.attempts < 1 or self.candidates < self.clusters:
            raise ValueError("clusters and members are at least 2, attempts at least 1, candidates at least as many as clusters")
        if not 0 <= self.low <= self.high <= 1 or not 0 <= self.most_identity <= 1:
            raise ValueError("low, high and most_identity lie in [0, 1], low not above high")


def run(spark: SparkSession, folder: str, out: str, cfg: PanelConfig = PanelConfig()) -> str:
    """Writes clusters.tsv, members.tsv, similarity.tsv and summary.json to ``out``; returns a line about them."""
    clusters, meta, terms = (lib.load(spark, folder, t) for t in ("clusters", "clusters_meta", "terms"))
    sequences = lib.load(spark, folder, "sequences")
    known = clusters.join(sequences.select(F.col("accession").alias("entity")), "entity", "left_semi")
    sizes = known.groupBy("cluster_id").agg(F.count("*").alias("size"))
    chosen_from = panel.prefilter(sizes, meta.where(F.size("composed_go") > 0), cfg.members, cfg.candidates, cfg.seed)
    names = sorted(r["cluster_id"] for r in chosen_from.collect())  # at most cfg.candidates
    sets = meta.where(F.col("cluster_id").isin(names)).select(F.col("cluster_id").alias("entity"), F.explode("composed_go").alias("term_id"))
    pairs = linkage.member_pairs(sets.select("entity").distinct().withColumn("community", F.lit(1))).select("a", "b")
    used = sets.select("term_id").distinct()
    ics = terms.select("term_id", "ic")
    lin = similarity.lin(similarity.all_term_pairs(used), reflexive_of(terms), ics)
    scored = similarity.set_similarity(pairs, sets, lin).collect()  # pairs of the candidates
    alike = {(r["a"], r["b"]): r["amb"] for r in scored}
    draw = random.Random(cfg.seed)
    pool = panel.pools(known.where(F.col("cluster_id").isin(names)), sequences, cfg.pool, cfg.seed)
    diverse: dict[str, list[str]] = {}
    for r in panel.diverse_members(pool, cfg.members, cfg.most_identity).orderBy("cluster_id", "place").collect():  # candidates times members
        diverse.setdefault(r["cluster_id"], []).append(r["entity"])
    got = panel.panel(sorted(diverse), alike, cfg.clusters, cfg.low, cfg.high, cfg.attempts, draw)
    if got is None:  # chance has found none: look at all
        got = panel.exact_panel(spark, sorted(diverse), alike, cfg.clusters, cfg.low, cfg.high)
    if got is None:
        raise ValueError("no panel fits: widen the bounds, or take fewer clusters or members")
    got = sorted(got)
    os.makedirs(out, exist_ok=True)
    export_file(meta.where(F.col("cluster_id").isin(got)).orderBy("cluster_id").select("cluster_id", "size", "composed_go", "description"), os.path.join(out, "clusters.tsv"))
    rows = [(c, m) for c in got for m in diverse[c]]
    export_file(spark.createDataFrame(rows, "cluster_id string, member_id string").coalesce(1), os.path.join(out, "members.tsv"))
    table = panel.matrix(got, alike)
    export_file(spark.createDataFrame([(c, *row) for c, row in zip(got, table)], ["cluster_id", *got]).coalesce(1), os.path.join(out, "similarity.tsv"))
    inside = panel.identity_stats(spark.createDataFrame([(m, c) for c, m in rows], "entity string, cluster_id string"), sequences)
    told = {"parameters": asdict(cfg), "candidates": len(names), "with_diverse_members": len(diverse), "clusters": got, "identity": {r["cluster_id"]: {"mean": r["mean"], "most": r["most"], "least": r["least"]} for r in inside.collect()}}
    with open(os.path.join(out, "summary.json"), "w", encoding="utf-8") as f:
        json.dump(told, f, indent=2, sort_keys=True)
    return f"{len(got)} clusters, {len(rows)} members: {out}"
