"""Tables that are rebuilt where their rows changed: digests by part, and score-board counts by signed deltas.

A table is a folder ``rows/part=N`` (parts by a hash of its key) and ``digests`` (part, rows, digest), where a digest is a sum of the
rows' hashes and so doesn't depend on their order. A new version is compared part by part; only parts whose digest
differs are written, each replaced as a whole. What changed since is read from these parts alone. Counts are sums over entities,
so an update takes the changed entities' old contributions away and adds their new ones.

Defined cases: repeated rows count as often as they come; null keys are a part's like any other key; a first version writes all parts; an empty
version empties the parts that had rows; columns must be those of the earlier version.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrove.operators import scoreboard

PARTS = 64


@dataclass(frozen=True)
class Versions:
    """A table's parts that changed, as they were and as they are."""

    parts: list[int]
    before: DataFrame
    after: DataFrame


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _replace(spark: SparkSession, source: str, target: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path
    store = path(target).getFileSystem(spark._jsc.hadoopConfiguration())
    store.delete(path(target), True)
    if store.exists(path(source)):
        store.mkdirs(path(target).getParent())
        store.rename(path(source), path(target))


def parted(rows: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    return rows.withColumn("part", F.pmod(F.xxhash64(F.col(key)), F.lit(parts)).cast("int"))


def digests(rows: DataFrame) -> DataFrame:
    """(part, rows, digest) of rows with ``part``."""
    columns = sorted(c for c in rows.columns if c != "part")
    # nulls leave a hash as it is, so they are told apart by what is null
    told = F.xxhash64(*columns, F.array(*[F.col(c).isNull() for c in columns])).cast("decimal(38,0)")
    return rows.groupBy("part").agg(F.count("*").alias("rows"), F.sum(told).alias("digest"))


def update(rows: DataFrame, folder: str, key: str, parts: int = PARTS) -> Versions:
    """Bring the table in ``folder`` to ``rows``: changed parts are written aside first, then take the old ones' places."""
    spark = rows.sparkSession
    kept, told = f"{folder}/rows", f"{folder}/digests"
    new = parted(rows, key, parts)
    now = digests(new)
    if _exists(spark, told):
        old = spark.read.parquet(told)
        same = F.expr("a.digest <=> b.digest and a.rows <=> b.rows")
        changed = [r[0] for r in old.alias("a").join(now.alias("b"), F.expr("a.part = b.part"), "full").where(~same).select(F.coalesce("a.part", "b.part")).collect()]  # ``parts`` at most
    else:
        changed = list(range(parts))
    aside = f"{folder}/aside-{uuid.uuid4().hex[:8]}"
    new.where(F.col("part").isin(changed)).repartition(F.col("part")).write.partitionBy("part").parquet(f"{aside}/rows")
    now.coalesce(1).write.parquet(f"{aside}/digests")
    schema = rows.schema
    for p in changed:  # the old part stays beside the new one until the caller has seen both
        _replace(spark, f"{kept}/part={p}", f"{aside}/old/part={p}")
        _replace(spark, f"{aside}/rows/part={p}", f"{kept}/part={p}")
    _replace(spark, f"{aside}/digests", told)

    def read(base: str) -> DataFrame:
        there = [f"{base}/part={p}" for p in changed if _exists(spark, f"{base}/part={p}")]
        return spark.read.schema(schema).parquet(*there) if there else spark.createDataFrame([], schema)

    return Versions(sorted(changed), read(f"{aside}/old"), read(kept))


def load(spark: SparkSession, folder: str, schema) -> DataFrame:
    return spark.read.schema(schema).parquet(f"{folder}/rows/part=*")


def counts(hits: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(motif_id, cluster_id, tp) and (cluster_id, size). hits: distinct (entity, motif_id); members: (entity, cluster_id)."""
    tp = hits.join(members, "entity").groupBy("motif_id", "cluster_id").agg(F.count("*").alias("tp"))
    return tp, members.groupBy("cluster_id").agg(F.count("*").alias("size"))


def updated_counts(tp: DataFrame, sizes: DataFrame, before: tuple[DataFrame, DataFrame], after: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """``counts`` after a change. before, after: (hits, members) of all entities that changed, of whom both tables must be whole."""
    signed = lambda d, sign, c: d.withColumn(c, sign * F.col(c))
    (old_tp, old_size), (new_tp, new_size) = counts(*before), counts(*after)
    tp = tp.unionByName(signed(old_tp, -1, "tp")).unionByName(new_tp).groupBy("motif_id", "cluster_id").agg(F.sum("tp").alias("tp"))
    sizes = sizes.unionByName(signed(old_size, -1, "size")).unionByName(new_size).groupBy("cluster_id").agg(F.sum("size").alias("size"))
    return tp.where("tp <> 0"), sizes.where("size <> 0")


def board(tp: DataFrame, sizes: DataFrame, cfg: scoreboard.BoardConfig = scoreboard.BoardConfig()) -> DataFrame:
    """The weighted score board of counts."""
    return scoreboard.weighted(scoreboard.contingency_of(tp, sizes, cfg), cfg)
