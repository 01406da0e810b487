"""Semantic similarity: most informative common ancestor, Lin scores, best-match averages of term sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def mica(pairs: DataFrame, reflexive_rows: DataFrame, ics: DataFrame) -> DataFrame:
    """(t1, t2) -> mica, mica_ic: the common ancestor (terms included) of greatest ic, larger id among equals.

    Ancestors without ic don't count; pairs without a common ancestor have nulls. A pair meets two sets, not its common ancestors one by one."""
    above = ancestor_sets(reflexive_rows, ics)
    j = pairs.select("t1", "t2").distinct()
    for t in ("t1", "t2"):
        j = j.join(above.select(F.col("term_id").alias(t), F.col("ancestors").alias(f"{t}_up"), F.col("ics").alias(f"{t}_ics")), t, "left")
    # the intersection keeps the order of its first side, so its first element has the greatest ic
    first = F.get(F.array_intersect("t1_up", "t2_up"), F.lit(0))
    best = j.select("t1", "t2", first.alias("mica"), "t1_up", "t1_ics").select("t1", "t2", "mica", F.get("t1_ics", F.array_position("t1_up", F.col("mica")) - 1).alias("mica_ic"))
    return pairs.join(best, ["t1", "t2"], "left").select(*pairs.columns, "mica", "mica_ic")


def ancestor_sets(reflexive_rows: DataFrame, ics: DataFrame) -> DataFrame:
    """term_id, ancestors, ics: each term's ancestors with an ic (itself included), those of greatest ic first, larger ids among equals."""
    up = reflexive_rows.select("term_id", "ancestor").join(ics.where("ic is not null").select(F.col("term_id").alias("ancestor"), "ic"), "ancestor")
    sets = up.groupBy("term_id").agg(F.sort_array(F.collect_set(F.struct("ic", "ancestor")), False).alias("up"))
    return sets.select("term_id", F.col("up.ancestor").alias("ancestors"), F.col("up.ic").alias("ics"))


def lin_expr(ic1: Column, ic2: Column, mica_ic: Column) -> Column:
    """2 ic(mica) / (ic1 + ic2); null if it is not defined."""
    return F.when((ic1 + ic2) != 0, 2 * mica_ic / (ic1 + ic2))


def lin(pairs: DataFrame, reflexive_rows: DataFrame, ics: DataFrame) -> DataFrame:
    """(t1, t2) -> mica, lin, reason (null when there is a score)."""
    m = mica(pairs.select("t1", "t2"), reflexive_rows, ics)
    i1 = ics.select(F.col("term_id").alias("t1"), F.col("ic").alias("ic1"), F.lit(True).alias("has1"))
    i2 = ics.select(F.col("term_id").alias("t2"), F.col("ic").alias("ic2"), F.lit(True).alias("has2"))
    j = m.join(i1, "t1", "left").join(i2, "t2", "left")
    gone1, gone2 = F.col("has1").isNull(), F.col("has2").isNull()
    reason = (
        F.when(gone1 & gone2, "missing_go1_go2").when(gone1, "missing_go1").when(gone2, "missing_go2")
        .when(F.col("ic1").isNull(), "missing_ic_go1").when(F.col("ic2").isNull(), "missing_ic_go2")
        .when(F.col("mica").isNull(), "no_common_ancestor").when(F.col("ic1") + F.col("ic2") == 0, "zero_ic_denominator")
    )
    score = F.when(reason.isNull(), lin_expr(F.col("ic1"), F.col("ic2"), F.col("mica_ic")))
    return j.select("t1", "t2", "mica", score.alias("lin"), reason.alias("reason"))


def all_term_pairs(terms: DataFrame) -> DataFrame:
    """Every ordered pair: the ontology's terms are the query set, and the result has a row a pair."""
    return terms.select(F.col("term_id").alias("t1")).crossJoin(terms.select(F.col("term_id").alias("t2")))


def both_orders(lin_rows: DataFrame) -> DataFrame:
    """Scores of (t1 <= t2) for both orders: the score and its reasons' absence are symmetric."""
    return lin_rows.unionByName(lin_rows.where("t1 <> t2").select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "lin"))


def term_matrix(lin_rows: DataFrame) -> DataFrame:
    """Scores as the clustering reads them: rounded to single precision."""
    return lin_rows.where("lin is not null").select("t1", "t2", F.col("lin").cast("float").cast("double").alias("lin"))


def best_matches(pairs: DataFrame, profiles: DataFrame, lin_rows: DataFrame) -> DataFrame:
    """a, b, side, term, score: the best score of each term of one set over the other set.

    pairs: (a, b); profiles: (entity, term_id) distinct; lin_rows: (t1, t2, lin) of every needed pair."""
    l = lin_rows.where("lin is not null").select("t1", "t2", "lin")
    x = profiles.select(F.col("entity").alias("a"), F.col("term_id").alias("t1"))
    y = profiles.select(F.col("entity").alias("b"), F.col("term_id").alias("t2"))
    s = pairs.select("a", "b").join(x, "a").join(y, "b").join(F.broadcast(l) if _small(l) else l, ["t1", "t2"])
    one = s.groupBy("a", "b", F.lit(1).alias("side"), F.col("t1").alias("term")).agg(F.max("lin").alias("score"))
    two = s.groupBy("a", "b", F.lit(2).alias("side"), F.col("t2").alias("term")).agg(F.max("lin").alias("score"))
    return one.unionByName(two)


SMALL_ROWS = 2_000_000


def _small(rows: DataFrame) -> bool:
    """Row counts decide on a broadcast; more rows are joined by a shuffle."""
    return rows.count() <= SMALL_ROWS


def set_similarity(pairs: DataFrame, profiles: DataFrame, lin_rows: DataFrame) -> DataFrame:
    """a, b, m12, m21, amb: means of the best matches of each direction and their mean; null where undefined."""
    m = best_matches(pairs, profiles, lin_rows).groupBy("a", "b").agg(F.avg(F.when(F.col("side") == 1, F.col("score"))).alias("m12"), F.avg(F.when(F.col("side") == 2, F.col("score"))).alias("m21"))
    return pairs.select("a", "b").join(m, ["a", "b"], "left").select("a", "b", "m12", "m21", ((F.col("m12") + F.col("m21")) / 2).alias("amb"))


def best_match_details(pairs: DataFrame, profiles: DataFrame, lin_rows: DataFrame) -> DataFrame:
    """As ``best_matches`` with the target term; the smaller id among equal scores."""
    l = lin_rows.where("lin is not null").select("t1", "t2", "lin")
    x = profiles.select(F.col("entity").alias("a"), F.col("term_id").alias("t1"))
    y = profiles.select(F.col("entity").alias("b"), F.col("term_id").alias("t2"))
    s = pairs.select("a", "b").join(x, "a").join(y, "b").join(l, ["t1", "t2"])
    pick = lambda side, source, target: (
        s.withColumn("r", F.row_number().over(Window.partitionBy("a", "b", source).orderBy(F.desc("lin"), target))).where("r = 1")
        .select("a", "b", F.lit(side).alias("side"), F.col(source).alias("source"), F.col(target).alias("target"), F.col("lin").alias("score"))
    )
    return pick(1, "t1", "t2").unionByName(pick(2, "t2", "t1"))
