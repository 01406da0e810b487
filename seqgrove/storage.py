"""The folder that all executors see, and tables written there to cut lineage."""

from __future__ import annotations

import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where none is, a local one is made in local mode (tests); on a
    cluster, whose machines don't share it, that is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not d:
        jvm = spark.sparkContext._jsc.sc().getCheckpointDir()
        d = jvm.get() if jvm.isDefined() else None
    if not d:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        d = "file://" + tempfile.mkdtemp(prefix="seqgrove-")
        spark.sparkContext.setCheckpointDir(d)
        spark.conf.set("spark.checkpoint.dir", d)
    return d.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._seqgrove_path = path
    return out


#: Rows that a task sorts or aggregates, about, where ``spread`` deals them.
TASK_ROWS = 300_000


def parts_for(spark: SparkSession, rows: int) -> int:
    """Partitions for so many rows: the session's number or more, so that a task's memory doesn't grow with the input."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def spread(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` to partitions for ``rows`` rows; sums and joins by these keys keep them."""
    return df.repartition(parts_for(df.sparkSession, rows), *keys)


def discard(df: DataFrame) -> None:
    """Delete a materialised table that nothing reads any more."""
    path = getattr(df, "_seqgrove_path", None)
    if path:
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def sweep(spark: SparkSession, turns: int = 2) -> None:
    """Let go of shuffle files of plans that nothing refers to any more, which Spark removes when its driver collects
    garbage: what plans refer to is only free in a second turn. The driver's heap, which grows with the plans, stages and
    tasks since the last turn, shrinks to a few times what is in use."""
    for _ in range(turns):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.2)
