"""Connected components by alternating large-star and small-star steps on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqgrove.storage import discard, materialise, sweep


def _large_star(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def _settled(e: DataFrame) -> bool:
    """Whether the links are stars already: every node has one link down, and none has links both up and down."""
    ends = e.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(e.select(F.col("v").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return not ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where("down > 1 or (down > 0 and up > 0)").take(1)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(u, v) links -> (u, v): every linked node but the smallest of its component, and that smallest.

    Only sums over nodes are grouped (with partial aggregation), so a node with very many links is not
    gathered anywhere. Each round is written to the shared folder, and the driver lets go of its plans. Rows with u = v or nulls are ignored."""
    e = materialise(edges.where("u is not null and v is not null and u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    for _ in range(most_rounds):
        if _settled(e):
            return e
        new = materialise(_small_star(_large_star(e)), "links")
        discard(e)
        e = new
        sweep(e.sparkSession, 1)
    if _settled(e):
        return e
    raise RuntimeError("components did not settle")
