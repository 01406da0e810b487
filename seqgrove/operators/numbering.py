"""Numbers in an order, without gathering the rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqgrove.storage import materialise


def numbered(rows: DataFrame, name: str, *keys: str) -> DataFrame:
    """``rows`` with ``name`` from 0 in the order of ``keys``: range partitions, and the rows before each (one number a partition)."""
    spread = rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id())
    spread = materialise(spread, "numbers")
    before, total = [], 0
    for r in spread.groupBy("_part").count().orderBy("_part").collect():
        before.append((r["_part"], total))
        total += r["count"]
    offsets = rows.sparkSession.createDataFrame(before, "_part int, _before bigint")
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return spread.join(offsets, "_part").withColumn(name, (F.col("_before") + inside - 1).cast("int")).drop("_part", "_before")
