"""Predictions for query sequences: weights of hit motifs, function sets, calibrated confidence, top n."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def cluster_predictions(hits: DataFrame, board: DataFrame, min_weight: float = 2.0) -> DataFrame:
    """query, cluster_id, weight, motif_id: the best motif of each cluster at ``min_weight`` or more.

    hits: (accession, motif_id, ordinal) with the motif's place in its library; the first wins ties. first is the place of
    the first motif that points to the cluster, whatever its weight: clusters are known in that order."""
    b = board.where(F.col("weight") >= min_weight).select("motif_id", "cluster_id", "weight")
    j = hits.join(b, "motif_id")
    best = F.min(F.struct((-F.col("weight")).alias("low"), "ordinal", "motif_id")).alias("m")
    return j.groupBy(F.col("accession").alias("query"), "cluster_id").agg(best, F.min("ordinal").alias("first")).select("query", "cluster_id", (-F.col("m.low")).alias("weight"), F.col("m.motif_id").alias("motif_id"), F.col("m.ordinal").alias("ordinal"), "first")


def confidence(predictions: DataFrame, calibration: DataFrame) -> DataFrame:
    """Adds confidence: the calibration point of the greatest threshold that the weight reaches, or null.

    The grid becomes one sorted array, so the as-of lookup is a projection."""
    points = calibration.agg(F.sort_array(F.collect_list(F.struct("threshold", "set_accuracy", "top1_accuracy", "top3_accuracy", "coverage"))).alias("points"))  # the grid
    j = predictions.crossJoin(F.broadcast(points))
    reached = F.filter("points", lambda p: p["threshold"] <= F.col("weight"))
    return j.withColumn("confidence", F.when(F.size(reached) > 0, F.element_at(reached, -1))).drop("points")


def function_sets(predictions: DataFrame, meta: DataFrame, top_n: int = 5) -> DataFrame:
    """query, rank, terms, cluster_ids, weight, motif_id, description: clusters merged by their function set.

    A cluster without terms, or without meta row, stands for itself. Clusters come in the order in which their motifs
    made them known (``first``, then the id). The greatest weight leads, the first cluster among equals. Sets rank by weight, then
    by their joined terms, where those without terms come first, then by their first cluster. top_n 0: all. meta: (cluster_id, composed_go array, description)."""
    if top_n < 0:
        raise ValueError("top_n must not be negative")
    m = meta.select("cluster_id", "composed_go", "description")
    j = predictions.join(m, "cluster_id", "left")
    named = F.size(F.coalesce("composed_go", F.array().cast("array<string>"))) > 0
    terms = F.when(named, F.col("composed_go")).otherwise(F.array("cluster_id"))
    j = j.withColumn("terms", terms).withColumn("description", F.coalesce("description", F.lit("NA")))
    ordered = F.sort_array(F.collect_list(F.struct("first", "cluster_id", "weight", "motif_id", "description")))
    g = j.groupBy("query", "terms", named.alias("named")).agg(ordered.alias("all"), F.max("weight").alias("weight"))
    lead = F.filter("all", lambda x: x["weight"] == F.col("weight"))[0]
    g = g.select("query", "terms", F.transform("all", lambda x: x["cluster_id"]).alias("cluster_ids"), "weight", lead["motif_id"].alias("motif_id"), lead["description"].alias("description"), F.when(F.col("named"), F.array_join("terms", ";")).otherwise("").alias("said"), F.struct(F.col("all")[0]["first"], F.col("all")[0]["cluster_id"]).alias("place"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("weight"), "said", "place"))
    g = g.withColumn("rank", rank).drop("said", "place")
    return g.where(F.col("rank") <= top_n) if top_n else g
