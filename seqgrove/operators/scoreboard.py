"""Motif-by-cluster enrichment: contingency counts, smoothed log2 weights, counters, calibration."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Weights of the calibration grid. Fixed values.
THRESHOLDS = tuple(2.0 + 0.5 * i for i in range(13))


@dataclass(frozen=True)
class BoardConfig:
    min_cluster_size: int = 10
    min_support: int = 5

    def __post_init__(self):
        if self.min_cluster_size < 1 or self.min_support < 1:
            raise ValueError("min_cluster_size and min_support must be at least 1")


def clean_hits(hits: DataFrame, members: DataFrame) -> DataFrame:
    """Distinct (entity, motif_id) of cluster members."""
    return hits.select(F.col("accession").alias("entity"), "motif_id").join(members.select("entity"), "entity", "left_semi").distinct()


def contingency(hits: DataFrame, members: DataFrame, cfg: BoardConfig = BoardConfig()) -> DataFrame:
    """motif_id, cluster_id, size and tp, fp, fn, tn of every combination with a hit in an eligible cluster.

    hits: distinct (entity, motif_id) of members; members: (entity, cluster_id)."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    tp = hits.join(members, "entity").groupBy("motif_id", "cluster_id").agg(F.count("*").alias("tp"))
    return contingency_of(tp, sizes, cfg)


def contingency_of(tp: DataFrame, sizes: DataFrame, cfg: BoardConfig = BoardConfig()) -> DataFrame:
    """``contingency`` of counts: tp (motif_id, cluster_id, tp), sizes (cluster_id, size)."""
    n = sizes.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"))
    # all of a motif's hits: a sum of what is counted already
    total = tp.groupBy("motif_id").agg(F.sum("tp").alias("hits"))
    c = tp.join(sizes.where(F.col("size") >= cfg.min_cluster_size), "cluster_id").join(total, "motif_id").crossJoin(F.broadcast(n))  # one row
    fp, fn = F.col("hits") - F.col("tp"), F.col("size") - F.col("tp")
    return c.select("motif_id", "cluster_id", "size", "tp", fp.alias("fp"), fn.alias("fn"), (F.col("n") - F.col("size") - fp).alias("tn"))


def weighted(table: DataFrame, cfg: BoardConfig = BoardConfig()) -> DataFrame:
    """Adds support, cluster_frequency, background_frequency (+0.5 each) and weight; status says what is stored."""
    outside = F.col("fp") + F.col("tn")
    cf, bf = (F.col("tp") + 0.5) / (F.col("size") + 1), (F.col("fp") + 0.5) / (outside + 1)
    w = F.log2(cf / bf)
    status = F.when(F.col("tp") < cfg.min_support, "low_support").when(outside == 0, "background_unavailable").when(w <= 0, "non_positive").otherwise("stored")
    return table.select("*", F.col("tp").alias("support"), cf.alias("cluster_frequency"), bf.alias("background_frequency"), w.alias("weight"), status.alias("status"))


def weights(table: DataFrame) -> DataFrame:
    return table.where("status = 'stored'").drop("status")


def counters(hits: DataFrame, members: DataFrame, rated: DataFrame, raw_hits: DataFrame | None = None, cfg: BoardConfig = BoardConfig()) -> DataFrame:
    """One row of totals. Combinations without a hit are counted by arithmetic, not made.

    rated: ``weighted``; raw_hits: (accession, motif_id) before cleaning, for outside and duplicate counts."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size"))
    small = F.col("size") < cfg.min_cluster_size
    a = sizes.agg(F.sum("size").alias("accessions"), F.count("*").alias("clusters"), F.coalesce(F.sum(small.cast("bigint")), F.lit(0)).alias("clusters_below_min_size"))
    b = hits.agg(F.countDistinct("motif_id").alias("motifs"), F.count("*").alias("motif_hit_rows"))
    is_ = lambda s: F.coalesce(F.sum((F.col("status") == s).cast("bigint")), F.lit(0)).alias(s)
    c = rated.agg(is_("background_unavailable"), is_("non_positive"), is_("stored"))
    t = a.crossJoin(b).crossJoin(c)  # one row each
    eligible = F.col("clusters") - F.col("clusters_below_min_size")
    supported = F.col("background_unavailable") + F.col("non_positive") + F.col("stored")
    t = t.select(
        "accessions", "clusters", "clusters_below_min_size", eligible.alias("eligible_clusters"), "motifs", "motif_hit_rows",
        (F.col("clusters") * F.col("motifs")).alias("potential"), (F.col("clusters_below_min_size") * F.col("motifs")).alias("ignored_cluster_size"),
        (eligible * F.col("motifs") - supported).alias("ignored_low_support"), F.col("background_unavailable").alias("ignored_background_unavailable"),
        F.col("non_positive").alias("ignored_non_positive_weight"), F.col("stored").alias("stored_weights"),
    )
    if raw_hits is not None:
        inside = raw_hits.join(members.select(F.col("entity").alias("accession")), "accession", "left_semi")
        d = raw_hits.agg(F.count("*").alias("all_hits")).crossJoin(inside.agg(F.count("*").alias("in_hits")))
        t = t.crossJoin(d).withColumn("motif_hits_outside_clusters", F.col("all_hits") - F.col("in_hits")).withColumn("duplicate_motif_hits", F.col("in_hits") - F.col("motif_hit_rows")).drop("all_hits", "in_hits")
    return t


def scores(hits: DataFrame, board: DataFrame) -> DataFrame:
    """entity, cluster_id, score: the greatest weight of an entity's motifs for each cluster."""
    return hits.join(board.select("motif_id", "cluster_id", "weight"), "motif_id").groupBy("entity", "cluster_id").agg(F.max("weight").alias("score"))


def calibration(hits: DataFrame, members: DataFrame, board: DataFrame, cfg: BoardConfig = BoardConfig(), thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """A row a threshold: eligible, covered, coverage, top1, top3, set accuracy, avg_predictions.

    Scores below a threshold only shorten the ranking, so ranks are taken once, and each score is counted once, in the bin of the
    highest threshold that it reaches."""
    sizes = members.groupBy("cluster_id").agg(F.count("*").alias("size")).where(F.col("size") >= cfg.min_cluster_size)
    eligible = members.join(sizes.select("cluster_id"), "cluster_id", "left_semi")
    s = scores(hits.join(eligible.select("entity"), "entity", "left_semi"), board)
    rank = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc("score"), "cluster_id"))
    s = s.withColumn("rank", rank).join(eligible.withColumnRenamed("cluster_id", "own"), "entity")
    hit = F.col("cluster_id") == F.col("own")
    one = lambda c: F.sum(c.cast("bigint"))
    # a score counts at the thresholds up to it: a histogram by their number, and sums over its upper bins
    steps = sorted(thresholds)
    level = F.size(F.filter(F.array(*[F.lit(float(t)) for t in steps]), lambda t: t <= F.col("score")))
    bins = s.withColumn("level", level).where(F.col("level") > 0).groupBy("level").agg(one(F.col("rank") == 1).alias("covered"), one(hit & (F.col("rank") == 1)).alias("top1"), one(hit & (F.col("rank") <= 3)).alias("top3"), one(hit).alias("in_set"), F.count("*").alias("predictions"))
    n = eligible.agg(F.count("*").alias("eligible"))
    grid = F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(i + 1).alias("step")) for i, t in enumerate(steps)]))
    base = members.sparkSession.range(1).select(grid.alias("g")).select("g.*").crossJoin(n)  # the grid
    kinds = ("covered", "top1", "top3", "in_set", "predictions")
    t = base.join(F.broadcast(bins), F.col("level") >= F.col("step"), "left").groupBy("threshold", "eligible").agg(*[F.sum(c).alias(c) for c in kinds])  # a row a threshold on both sides
    covered = F.coalesce("covered", F.lit(0))
    share = lambda c: F.when(covered > 0, F.col(c) / covered)
    return t.select("threshold", "eligible", covered.alias("covered"), F.when(F.col("eligible") > 0, covered / F.col("eligible")).otherwise(0.0).alias("coverage"), share("top1").alias("top1_accuracy"), share("top3").alias("top3_accuracy"), share("in_set").alias("set_accuracy"), F.when(covered > 0, F.col("predictions") / covered).otherwise(0.0).alias("avg_predictions"))


def odds_ratio(tp, fp, fn, tn):
    """tp tn / (fp fn) as a column; infinite or null where it has no value."""
    top, bottom = tp * tn, fp * fn
    return F.when(bottom != 0, top / bottom).when(top > 0, F.lit(float("inf")))
