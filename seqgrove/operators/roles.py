"""Semantic roles of terms, from anchor terms above them and keywords in their names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def anchor_roles(terms: DataFrame, reflexive_rows: DataFrame, ics: DataFrame, anchors: DataFrame) -> DataFrame:
    """term_id, role, priority, matched: the most specific anchor among a term and its ancestors.

    anchors: (role, priority, term_id, ord); of several roles of one anchor the higher priority counts, then
    the first. Terms without ic rank last, larger ids first."""
    w = Window.partitionBy("anchor").orderBy(F.desc("priority"), "ord")
    a = anchors.withColumnRenamed("term_id", "anchor").withColumn("r", F.row_number().over(w)).where("r = 1").select("anchor", "role", "priority")
    j = reflexive_rows.select("term_id", F.col("ancestor").alias("anchor")).join(a, "anchor").join(ics.select(F.col("term_id").alias("anchor"), "ic"), "anchor", "left")
    best = F.max(F.struct(F.col("ic").isNotNull().alias("known"), F.coalesce("ic", F.lit(0.0)).alias("ic"), "anchor", "role", "priority")).alias("b")
    return j.groupBy("term_id").agg(best).select("term_id", "b.role", "b.priority", F.col("b.anchor").alias("matched"))


def keyword_roles(terms: DataFrame, keywords: DataFrame) -> DataFrame:
    """term_id, role, priority, matched: the first keyword, by priority and then order, in the lower-case name."""
    k = keywords.select("role", "priority", "keyword", "ord")
    j = terms.select("term_id", F.lower("name").alias("name")).join(F.broadcast(k), F.col("name").contains(F.lower("keyword")))  # a configuration list
    best = F.min(F.struct((-F.col("priority")).alias("low"), "ord", "role", "keyword")).alias("b")
    return j.groupBy("term_id").agg(best).select("term_id", "b.role", (-F.col("b.low")).alias("priority"), F.col("b.keyword").alias("matched"))


def semantic_roles(terms: DataFrame, reflexive_rows: DataFrame, ics: DataFrame, anchors: DataFrame, keywords: DataFrame, root: str) -> DataFrame:
    """term_id, role, priority, source, matched of every term but the root.

    A keyword beats an anchor of lower priority, or of equal priority and another role."""
    a = anchor_roles(terms, reflexive_rows, ics, anchors).select("term_id", F.struct("role", "priority", F.lit("anchor").alias("source"), "matched").alias("a"))
    k = keyword_roles(terms, keywords).select("term_id", F.struct("role", "priority", F.lit("keyword").alias("source"), "matched").alias("k"))
    none = F.struct(F.lit("unknown").alias("role"), F.lit(0).alias("priority"), F.lit("unknown").alias("source"), F.lit(None).cast("string").alias("matched"))
    j = terms.where(F.col("term_id") != root).select("term_id").join(a, "term_id", "left").join(k, "term_id", "left")
    better = (F.col("k.priority") > F.col("a.priority")) | ((F.col("k.priority") == F.col("a.priority")) & (F.col("k.role") != F.col("a.role")))
    chosen = F.when(F.col("a").isNull(), F.coalesce("k", none)).when(F.col("k").isNull() | ~better, F.col("a")).otherwise(F.col("k"))
    return j.select("term_id", chosen.alias("s")).select("term_id", "s.role", "s.priority", "s.source", "s.matched")


def role_counts(roles: DataFrame) -> DataFrame:
    return roles.groupBy("source", "role").agg(F.count("*").alias("terms"))


def unknown_terms(roles: DataFrame, terms: DataFrame) -> DataFrame:
    return roles.where("source = 'unknown'").join(terms, "term_id").select("term_id", "name").orderBy("term_id")
