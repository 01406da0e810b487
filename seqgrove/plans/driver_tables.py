"""Ontologies, profiles, clusters and sequences read from the star schema and the documents.

Ontology P: ROOT <- T:<type>, B:<brand> <- TB:<type>|<brand>, a DAG with two parents a leaf; an order carries
the leaves of its lineitems' parts. Ontology C: ROOT <- R:<region> <- N:<nation>, and ROOT <- S:<segment> <-
SR:<segment>|<region>, which R:<region> is over as well; a customer carries its nation and its segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrove.storage import spread

ROOT = "ROOT"
#: Motifs of the documents' letters. Fixed values.
MOTIFS = (
    ("nglyc", "N!P[ST]!P"), ("the", "TH?(0,2)[ST]"), ("eaux", "EAUX"), ("ing_end", "ING>"), ("start", "<?(0,3)TH"), ("kd", "[KD]E{-}"),
    ("cion", "CIO{p}"), ("keit", "KEIT"), ("hyd", "{h}{h}{h}{+}"), ("zz", "!AZ[AEIO]"), ("ent", "ENT?(2)E"), ("idiot", "IDIOT"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ontology_p(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(terms: term_id, name; edges: child, parent)."""
    part = table(spark, sf_dir, "part").select("p_type", "p_brand").distinct()
    t, b = F.concat(F.lit("T:"), "p_type"), F.concat(F.lit("B:"), "p_brand")
    tb = F.concat(F.lit("TB:"), "p_type", F.lit("|"), "p_brand")
    pairs = F.explode(F.array(F.struct(tb.alias("child"), t.alias("parent")), F.struct(tb.alias("child"), b.alias("parent")), F.struct(t.alias("child"), F.lit(ROOT).alias("parent")), F.struct(b.alias("child"), F.lit(ROOT).alias("parent"))))
    edges = part.select(pairs.alias("e")).select("e.child", "e.parent").distinct()
    return _named(edges), edges


def _named(edges: DataFrame) -> DataFrame:
    ids = edges.select(F.col("child").alias("term_id")).union(edges.select("parent")).distinct()
    return ids.select("term_id", F.lower(F.regexp_replace("term_id", "^[A-Z]+:", "")).alias("name"))


def order_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, term_id: distinct leaves of ontology P of each order."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat(F.lit("TB:"), "p_type", F.lit("|"), "p_brand").alias("term_id"))
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    n = items.count()
    leaves = spread(items, n, "l_partkey").join(spread(part, n, "l_partkey"), "l_partkey").select(F.col("l_orderkey").cast("string").alias("entity"), "term_id")
    return spread(leaves, n, "entity").distinct()


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, nation, region, segment."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    j = c.join(F.broadcast(n), c["c_nationkey"] == n["n_nationkey"]).join(F.broadcast(r), n["n_regionkey"] == r["r_regionkey"])  # 25 and 5 rows
    return j.select(F.format_string("C%09d", "c_custkey").alias("entity"), F.col("n_name").alias("nation"), F.col("r_name").alias("region"), F.col("c_mktsegment").alias("segment"))


def ontology_c(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = customers(spark, sf_dir).select("nation", "region", "segment").distinct()
    r, n, s = (F.concat(F.lit(p), x) for p, x in (("R:", "region"), ("N:", "nation"), ("S:", "segment")))
    sr = F.concat(F.lit("SR:"), "segment", F.lit("|"), "region")
    up = lambda a, b: F.struct(a.alias("child"), b.alias("parent"))
    edges = c.select(F.explode(F.array(up(r, F.lit(ROOT)), up(s, F.lit(ROOT)), up(n, r), up(sr, s), up(sr, r))).alias("e")).select("e.child", "e.parent").distinct()
    return _named(edges), edges


def customer_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = customers(spark, sf_dir)
    sr = F.concat(F.lit("SR:"), "segment", F.lit("|"), "region")
    return c.select("entity", F.explode(F.array(F.concat(F.lit("N:"), "nation"), sr)).alias("term_id"))


def letter_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """accession, sequence: the letters of every document's whole text, in capitals."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), "[^A-Za-z]", "")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.upper(text).alias("sequence"))


def document_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entity, cluster_id: documents by language and by whether their source's number is even."""
    odd = F.expr("try_cast(regexp_extract(source, '[0-9]+$', 0) as int)") % 2
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("entity"), F.concat("lang", F.lit("_"), F.coalesce(odd, F.lit(0)).cast("string")).alias("cluster_id"))
