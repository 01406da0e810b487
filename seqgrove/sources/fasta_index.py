"""FASTA files with an index of byte ranges: written in parallel, and read by the ranges of the accessions that are asked for.

A data set is a folder of files ``file=N/part-...`` and a table ``_index`` (accession, file, start, at, bytes): the record's
first byte, its sequence's first byte and the bytes of the sequence. What the index says of the files' sizes is checked
before it is used, so files that were changed since are refused. Offsets are running sums inside each file, which
holds about ``FILE_BYTES``. Ranges are read through ``pyarrow.fs``, those that are near each other at once.

Defined cases: repeated accessions are written as often as they come, and the first in order is found; accessions that aren't there, and null
ones, have no sequence; records without a sequence are not written; an empty table gives an empty data set.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqgrove.session import ship
from seqgrove.storage import discard, materialise

FILE_BYTES = 128 << 20
#: Bytes between two ranges that are read over, and of one read at most (a longer sequence is a read of its own).
GAP, READ = 1 << 16, 8 << 20
INDEX = "accession string, file int, start bigint, at bigint, bytes bigint"


def write_fasta(sequences: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> None:
    """sequences: (accession, sequence)."""
    head = F.concat(F.lit(">"), "accession", F.lit("\n"))
    rows = sequences.where("accession is not null and sequence <> ''").select("accession", "sequence", F.octet_length(head).cast("bigint").alias("head"), F.octet_length("sequence").cast("bigint").alias("bytes"))
    total = rows.agg(F.sum(F.col("head") + F.col("bytes") + 1)).first()[0] or 0
    files = max(1, -(-total // file_bytes))
    rows = rows.withColumn("file", F.pmod(F.xxhash64("accession"), F.lit(files)).cast("int"))
    before = Window.partitionBy("file").orderBy("accession", "sequence").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("head") + F.col("bytes") + 1).over(before), F.lit(0))
    placed = materialise(rows.withColumn("start", start), "fasta-rows")
    out = placed.repartition(files, "file").sortWithinPartitions("file", "accession", "sequence")
    out.select(F.concat(head, "sequence").alias("value"), "file").write.partitionBy("file").text(path)
    placed.select("accession", "file", "start", (F.col("start") + F.col("head")).alias("at"), "bytes").write.parquet(f"{path}/_index")
    discard(placed)


def _files(spark: SparkSession, path: str) -> DataFrame:
    """(file, path, length), of the files' names and sizes alone."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*.txt").load(path)
    return found.select(F.regexp_extract("path", r"/file=(\d+)/", 1).cast("int").alias("file"), "path", "length")


def checked_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(index, files) of a data set; ValueError where the files are not those of the index."""
    index = spark.read.schema(INDEX).parquet(f"{path}/_index")
    said = index.groupBy("file").agg(F.max(F.col("at") + F.col("bytes") + 1).alias("said"))
    files = _files(spark, path).where("length > 0")
    odd = said.join(files, "file", "full").where("not (said <=> length)").limit(5).collect()
    if odd:
        raise ValueError(f"{path}: the index is not that of " + ", ".join(f"file {r['file']}" for r in odd))
    return index, files


def _read(batches):
    from pyarrow import fs

    for b in batches:
        rows = sorted(zip(b.column("path").to_pylist(), b.column("at").to_pylist(), b.column("bytes").to_pylist(), b.column("accession").to_pylist()))
        names, seqs, i = [], [], 0
        while i < len(rows):
            path, at = rows[i][:2]
            store, name = (fs.LocalFileSystem(), path[5:]) if path.startswith("file:/") and not path.startswith("file://") else fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                while i < len(rows) and rows[i][0] == path:
                    j, start, end = i, rows[i][1], rows[i][1] + rows[i][2]
                    while j < len(rows) and rows[j][0] == path and rows[j][1] - end <= GAP and (j == i or rows[j][1] + rows[j][2] - start <= READ):
                        end = max(end, rows[j][1] + rows[j][2])
                        j += 1
                    raw = f.read_at(end - start, start)
                    for _, at, n, accession in rows[i:j]:
                        names.append(accession)
                        seqs.append(raw[at - start : at - start + n].decode())
                    i = j
        yield pa.RecordBatch.from_pydict({"accession": pa.array(names, pa.string()), "sequence": pa.array(seqs, pa.string())})


def indexed_sequences(spark: SparkSession, path: str, accessions: DataFrame) -> DataFrame:
    """accession, sequence (null where there is none) of each of ``accessions`` (accession)."""
    ship(spark)
    index, files = checked_index(spark, path)
    wanted = accessions.select("accession").distinct()
    first = index.join(wanted, "accession", "left_semi").groupBy("accession").agg(F.min_by(F.struct("file", "at", "bytes"), "start").alias("r")).select("accession", "r.*")
    ranges = first.join(files.select("file", "path"), "file").select("path", "at", "bytes", "accession")
    ranges = ranges.repartition(F.col("path"), F.floor(F.col("at") / (4 * READ))).sortWithinPartitions("path", "at")
    found = ranges.mapInArrow(_read, "accession string, sequence string")
    return accessions.select("accession").join(found, "accession", "left")


def indexed_sequence(spark: SparkSession, path: str, accession: str) -> str | None:
    """One sequence by its accession, None if it isn't there."""
    return indexed_sequences(spark, path, spark.range(1).select(F.lit(accession).alias("accession"))).first()["sequence"]
