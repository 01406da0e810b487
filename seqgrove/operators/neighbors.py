"""Sparse similarity graph: capped inverted index, candidate profiles, k nearest neighbours.

Everything quadratic happens between distinct *profiles* (term sets), not entities: entities with equal
profiles share postings, candidates and scores, and an entity's neighbours are among the first k + 1
entities of its profile's ranking. Only k rows an entity are fanned out at the end.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqgrove.operators.numbering import numbered
from seqgrove.operators.similarity import set_similarity
from seqgrove.storage import materialise, spread

#: Rows of the profiles' nearest entities that are broadcast.
SMALL_ROWS = 200_000


@dataclass(frozen=True)
class GraphConfig:
    neighbors: int = 10
    resolution: float = 2.0
    min_informative_ic: float = 0.5
    min_similarity: float = 0.5
    max_posting_fraction: float = 0.05
    max_posting_size: int = 0

    def __post_init__(self):
        if self.neighbors < 1 or self.resolution <= 0 or self.min_informative_ic < 0 or self.max_posting_size < 0:
            raise ValueError("neighbors and resolution must be positive, thresholds not negative")
        if not 0 <= self.min_similarity <= 1 or not 0 < self.max_posting_fraction <= 1:
            raise ValueError("min_similarity lies in [0, 1], max_posting_fraction in (0, 1]")

    def cap(self, entities: int) -> int:
        return self.max_posting_size or max(1, math.ceil(entities * self.max_posting_fraction))


def valid_profiles(profiles: DataFrame, ics: DataFrame) -> DataFrame:
    """Distinct (entity, term_id) with a numeric ic; entities without any drop out."""
    return profiles.select("entity", "term_id").join(ics.where("ic is not null").select("term_id"), "term_id", "left_semi").distinct().select("entity", "term_id")


def grouped(profiles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, profile) and (profile, term_id); profile is the sorted terms joined by ';'."""
    per = profiles.groupBy("entity").agg(F.array_join(F.sort_array(F.collect_set("term_id")), ";").alias("profile"))
    terms = per.select("profile").distinct().select("profile", F.explode(F.split("profile", ";")).alias("term_id"))
    return per, terms


def candidate_index(members: DataFrame, profile_terms: DataFrame, reflexive_rows: DataFrame, ics: DataFrame, cfg: GraphConfig) -> DataFrame:
    """(profile, term_id, fallback): retained postings. A profile whose terms are all too broad keeps its rarest."""
    n = members.count()
    cap = cfg.cap(n)
    sizes = members.groupBy("profile").agg(F.count("*").alias("members"))
    good = ics.where(F.col("ic") >= cfg.min_informative_ic).select(F.col("term_id").alias("ancestor"), "ic")
    up = profile_terms.join(reflexive_rows.select("term_id", "ancestor"), "term_id").join(good, "ancestor").select("profile", F.col("ancestor").alias("term_id"), "ic").distinct()
    posting = up.join(sizes, "profile").groupBy("term_id").agg(F.sum("members").alias("posting"))
    up = up.join(posting, "term_id")
    kept = up.where(F.col("posting") <= cap).select("profile", "term_id", F.lit(False).alias("fallback"))
    rest = up.join(kept.select("profile").distinct(), "profile", "left_anti")
    rare = rest.groupBy("profile").agg(F.min(F.struct("posting", (-F.col("ic")).alias("low"), "term_id")).alias("m"))
    return kept.unionByName(rare.select("profile", F.col("m.term_id").alias("term_id"), F.lit(True).alias("fallback")))


def candidate_pairs(index: DataFrame) -> DataFrame:
    """(a, b), a < b: distinct profiles that share a retained term."""
    a, b = index.select("term_id", F.col("profile").alias("a")), index.select("term_id", F.col("profile").alias("b"))
    return a.join(b, "term_id").where("a < b").select("a", "b").distinct()


def knn_edges(profiles: DataFrame, reflexive_rows: DataFrame, ics: DataFrame, term_scores: DataFrame, cfg: GraphConfig = GraphConfig()) -> DataFrame:
    """src < dst, weight: each entity's k most similar others (similarity down, id up), undirected.

    Entities that share their profile with k others take the first k of them at 1.0; profiles whose terms
    all have ic 0 aren't comparable with themselves. term_scores: (t1, t2, lin)."""
    k = cfg.neighbors
    valid = valid_profiles(profiles, ics)
    members, terms = grouped(valid)
    members = materialise(members, "members")
    terms = members.select("profile").distinct().select("profile", F.explode(F.split("profile", ";")).alias("term_id"))
    pairs = materialise(candidate_pairs(candidate_index(members, terms, reflexive_rows, ics, cfg)), "profile-pairs")
    as_sets = terms.withColumnRenamed("profile", "entity")
    scores = set_similarity(pairs, as_sets, term_scores).where(F.col("amb") >= cfg.min_similarity).select("a", "b", "amb")
    both = scores.unionByName(scores.select(F.col("b").alias("a"), F.col("a").alias("b"), "amb"))
    comparable = terms.join(ics.where("ic > 0"), "term_id", "left_semi").select("profile").distinct()

    # the first k + 1 entities of every profile stand for it
    first = members.withColumn("r", F.row_number().over(Window.partitionBy("profile").orderBy("entity"))).where(F.col("r") <= k + 1)
    sizes = members.groupBy("profile").agg(F.count("*").alias("members"))
    own = comparable.join(sizes, "profile")
    crowded = own.where(F.col("members") > k).select("profile")
    ranked = both.join(crowded, both["a"] == crowded["profile"], "left_anti").select("a", "b", "amb")
    ranked = ranked.unionByName(own.select(F.col("profile").alias("a"), F.col("profile").alias("b"), F.lit(1.0).alias("amb")))
    options = ranked.join(first, ranked["b"] == first["profile"]).select("a", F.col("entity").alias("other"), "amb")
    best = options.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy(F.desc("amb"), "other"))).where(F.col("r") <= k + 1)
    best = materialise(best, "nearest-of-profiles")
    # few profiles would give few tasks all entities: these are dealt by name, and the profiles' k + 1 rows go to them
    rows = members.count() * k
    dealt = spread(members, rows, "entity")
    near = dealt.join(F.broadcast(best) if best.count() <= SMALL_ROWS else best, F.col("profile") == F.col("a")).where("entity <> other").select("entity", "other", "amb", "r")
    near = near.withColumn("turn", F.row_number().over(Window.partitionBy("entity").orderBy("r"))).where(F.col("turn") <= k)
    near = near.select(F.least("entity", "other").alias("src"), F.greatest("entity", "other").alias("dst"), "amb")
    return spread(near, rows, "src", "dst").groupBy("src", "dst").agg(F.max("amb").alias("weight"))


def connected_vertices(edges: DataFrame) -> DataFrame:
    """Vertices with at least one edge, numbered from 0 in order of name."""
    v = edges.select(F.col("src").alias("entity")).union(edges.select("dst")).distinct()
    return numbered(v, "vertex", "entity")
