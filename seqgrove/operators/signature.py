"""Representative terms of clusters: equal votes, support times information content, ancestor suppression."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqgrove.session import ship


@dataclass(frozen=True)
class SignatureConfig:
    max_terms: int = 10
    min_support: float = 0.1
    relative_drop: float = 0.5
    coverage: float = 0.8

    def __post_init__(self):
        if self.max_terms < 1 or self.relative_drop < 0 or not 0 <= self.min_support <= 1 or not 0 <= self.coverage <= 1:
            raise ValueError("max_terms >= 1, relative_drop >= 0, min_support and coverage in [0, 1]")


def votes(members: DataFrame, profiles: DataFrame, reflexive_rows: DataFrame, ics: DataFrame, min_support: float = 0.1) -> DataFrame:
    """cluster_id, term_id, support, score: a vote a member for each term it or a descendant is annotated with.

    Support is the share of members with a profile; terms without a positive ic don't vote."""
    own = members.join(profiles, "entity").select("cluster_id", "entity", "term_id").distinct()
    n = own.select("cluster_id", "entity").distinct().groupBy("cluster_id").agg(F.count("*").alias("n"))
    up = own.join(reflexive_rows.select("term_id", "ancestor"), "term_id").select("cluster_id", "entity", F.col("ancestor").alias("term_id")).distinct()
    v = up.groupBy("cluster_id", "term_id").agg(F.count("*").alias("votes")).join(n, "cluster_id").join(ics.where("ic > 0").select("term_id", "ic"), "term_id")
    support = F.col("votes") / F.col("n")
    return v.select("cluster_id", "term_id", support.alias("support"), (support * F.col("ic")).alias("score")).where(F.col("support") >= min_support)


def fold(ranked: list[tuple[str, float, float]], above: dict[str, set[str]], cfg: SignatureConfig) -> list[tuple[str, float, float]]:
    """ranked: (term, support, score), best first. Between a term and its ancestor the term wins if it covers
    enough of the ancestor's support, else the ancestor does."""
    chosen: list[tuple[str, float, float]] = []

    def wins(new, old) -> bool | None:
        """None: unrelated."""
        if old[0] in above.get(new[0], ()):
            return new[1] / old[1] >= cfg.coverage
        if new[0] in above.get(old[0], ()):
            return old[1] / new[1] < cfg.coverage
        return None

    for new in ranked:
        verdicts = [wins(new, old) for old in chosen]
        if False in verdicts:
            continue
        chosen = [old for old, v in zip(chosen, verdicts) if not v] + [new]
    out = chosen[:1]
    for x in chosen[1:]:
        if out[-1][2] > 0 and x[2] / out[-1][2] < cfg.relative_drop:
            break
        out.append(x)
    return out[: cfg.max_terms]


def signatures(voted: DataFrame, closure_rows: DataFrame, cfg: SignatureConfig = SignatureConfig()) -> DataFrame:
    """cluster_id, rank, term_id, support, score. The fold depends on its order, so a cluster's candidate
    terms (at most 1 / min_support times a profile's size) are one group."""
    ship(voted.sparkSession)
    up = closure_rows.groupBy("term_id").agg(F.collect_set("ancestor").alias("above"))
    rows = voted.join(up, "term_id", "left").select("cluster_id", "term_id", "support", "score", "above")

    def run(pdf):
        above = {t: set(a) if a is not None else set() for t, a in zip(pdf["term_id"], pdf["above"])}
        ranked = sorted(zip(pdf["term_id"], pdf["support"], pdf["score"]), key=lambda x: (-x[2], -x[1], x[0]))
        kept = fold(ranked, above, cfg)
        return pd.DataFrame({"cluster_id": [pdf["cluster_id"].iloc[0]] * len(kept), "rank": pd.Series(range(1, len(kept) + 1), dtype="int32"), "term_id": [x[0] for x in kept], "support": [x[1] for x in kept], "score": [x[2] for x in kept]})

    return rows.groupBy("cluster_id").applyInPandas(run, "cluster_id string, rank int, term_id string, support double, score double")


def composed(signature_rows: DataFrame) -> DataFrame:
    """cluster_id, composed_go: the terms in order of rank."""
    s = signature_rows.groupBy("cluster_id").agg(F.sort_array(F.collect_list(F.struct("rank", "term_id"))).alias("s"))
    return s.select("cluster_id", F.transform("s", lambda x: x["term_id"]).alias("composed_go"))
