"""WARC archives, index first.

The index (archive, offset, length, url, digest of every record) is computed from the record heads and
written before any archive. Archives are raw WARC/1.1 files: Spark's text writer puts each record's
bytes, then the four bytes that end a record, so its commit protocol also covers these files. Readers
select index rows, sort them by archive and offset, coalesce near ranges and read only those bytes.

Of records with equal payloads of at least ``least`` bytes the one with the largest page_id is a
response and the others are revisit records without the payload.

Defined cases: null html is an empty payload; a null url gives no target header; line ends in a url are
percent-encoded; of repeated rows with one page_id and payload, one is the response and the others
revisit it; a null page_id is smaller than any other; very long payloads make larger archives; an empty table gives an empty index and no
archive; further columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_path, lean, shuffle_parts, sweep

END = "\r\n\r\n"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: five hex digits are four base32 digits."""
    digits = F.sha1(data)
    bits = lambda i: F.conv(F.substr(digits, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
    four = lambda v: F.concat(*[F.substr(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)])
    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: four(bits(i))), "")


def _record_id(page: Column, url: Column) -> Column:
    h = F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("")), F.coalesce(url, F.lit(""))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _keyed(pages: DataFrame, archives: int, with_html: bool) -> DataFrame:
    body = F.coalesce(F.col("html"), F.lit(""))
    d = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), base32_sha1(body.cast("binary")).alias("digest"), F.octet_length(body).cast("bigint").alias("bytes"), *([body.alias("html")] if with_html else []))
    # rows of one id, or of none, spread by their url and payload
    return d.withColumn("archive", F.pmod(F.xxhash64("page_id", "url", "digest"), F.lit(archives)).cast("int"))


def _numbered(d: DataFrame) -> DataFrame:
    """Rows of a page_id in a fixed order; rows that tie are equal."""
    return d.withColumn("turn", F.row_number().over(Window.partitionBy("archive", "page_id").orderBy("digest", "url")))


def _heads(d: DataFrame, date: str) -> DataFrame:
    """Adds ``head``: all of a record before its payload. A revisit has the HTTP head only."""
    line = lambda name, v: F.concat(F.lit(f"\r\n{name}: "), v)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes"), F.lit(END))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    block = F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("bytes")).otherwise(F.lit(0))
    revisit = F.concat(line("WARC-Refers-To-Page", F.coalesce(F.col("refers_to").cast("string"), F.lit(""))), F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("url"))), line("WARC-Date", F.lit(date)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", url)).otherwise(F.lit("")), line("WARC-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), F.when(F.col("record_type") == "revisit", revisit).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response"), line("Content-Length", block.cast("string")), F.lit(END), http,
    )
    return d.withColumn("head", head)


def write_archives(pages: DataFrame, path: str, least: int = 0, archive_bytes: int = 1 << 27, date: str = "2000-01-01T00:00:00Z", turns: int = 2) -> DataFrame:
    """Write ``path``/index and ``path``/archives and return the index.

    One shuffle moves the pages (to their archive), some archives at a time, so that no more than their share lies on disk twice; deduplication and offsets use rows without html.
    An archive holds about ``archive_bytes`` at most, dealt by a hash of the row, so none is hot and a whole one
    fits in a task where a store can't be read by ranges.
    """
    spark = pages.sparkSession
    pages = pages.select("page_id", "url", "html")
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html").cast("bigint")), F.lit(0)).alias("n")).first()["n"]
    archives = max(shuffle_parts(spark), -(-total // archive_bytes))
    meta = _numbered(_keyed(pages, archives, False))
    # of rows with the greatest id (or of none, if all are null), the first is the response
    place = F.struct("page_id", (-F.col("archive")).alias("archive"), (-F.col("turn")).alias("turn"))
    dup = meta.where(F.col("bytes") >= least).groupBy("digest").agg(F.max(place).alias("last"), F.count("*").alias("copies")).where("copies > 1").select("digest", "last")
    m = meta.join(dup, "digest", "left")
    single = F.col("last").isNull()
    first = F.col("page_id").eqNullSafe(F.col("last.page_id")) & (F.col("archive") == -F.col("last.archive")) & (F.col("turn") == -F.col("last.turn"))
    m = m.withColumn("record_type", F.when(single | (F.col("bytes") < least) | first, F.lit("response")).otherwise(F.lit("revisit")))
    m = m.withColumn("refers_to", F.when(F.col("record_type") == "revisit", F.col("last.page_id")))
    m = _heads(m, date)
    length = F.octet_length("head") + F.when(F.col("record_type") == "response", F.col("bytes")).otherwise(F.lit(0)) + len(END)
    m = m.withColumn("length", length.cast("bigint")).drop("head")
    before = Window.partitionBy("archive").orderBy(F.col("page_id").asc_nulls_first(), "turn").rowsBetween(Window.unboundedPreceding, -1)
    m = m.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)))
    m.select("archive", "offset", "length", "url", "digest", "page_id", "turn", "bytes", "record_type", "refers_to").write.parquet(f"{path}/index")
    index = spark.read.parquet(f"{path}/index")
    sweep(spark)

    n = shuffle_parts(spark)
    # both sides are dealt by archive already: joining them needs no other exchange
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    old = spark.conf.get(name)
    for turn in range(turns):
        spark.conf.set(name, "false")
        try:
            _records(pages, index, archives, n, turn, turns, date).write.mode("append").option("lineSep", END).partitionBy("archive").text(f"{path}/archives")
        finally:
            spark.conf.set(name, old)
        sweep(spark)
    return index


def _records(pages: DataFrame, index: DataFrame, archives: int, n: int, turn: int, turns: int, date: str) -> DataFrame:
    """archive, value: the records of the archives of a turn, in order."""
    here = F.pmod("archive", F.lit(turns)) == turn
    body = _numbered(_keyed(pages, archives, True).where(here).repartition(n, "archive"))
    plan = index.where(here).select("archive", "page_id", "turn", "record_type", "refers_to", "offset").repartition(n, "archive")
    same = [F.col("b.archive") == F.col("p.archive"), F.col("b.page_id").eqNullSafe(F.col("p.page_id")), F.col("b.turn") == F.col("p.turn")]
    rows = body.alias("b").join(plan.alias("p").hint("merge"), same).select("b.*", "record_type", "refers_to", "offset")
    record = F.concat("head", F.when(F.col("record_type") == "response", F.col("html")).otherwise(F.lit("")))
    return _heads(rows, date).select("archive", "offset", record.alias("value")).sortWithinPartitions("archive", "offset").select("archive", "value")



def archive_files(spark: SparkSession, path: str) -> DataFrame:
    """archive -> file, one row an archive, by Spark's own listing."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/archives")
    return files.select(F.regexp_extract("path", r"archive=(\d+)/", 1).cast("int").alias("archive"), F.col("path").alias("file"))


def parse_record(raw: bytes) -> dict:
    """Head fields (lower case), and the payload of a response."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        k, _, v = line.partition(b": ")
        fields[k.decode().lower()] = v.decode()
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["payload"] = payload
    fields["payload_bytes"] = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    return fields


def coalesce_ranges(ranges: list[tuple[int, int]], gap: int, most: int):
    """Sorted (offset, length) -> (start, end, first index, last index + 1) of joint reads."""
    i = 0
    while i < len(ranges):
        start, end = ranges[i][0], sum(ranges[i])
        j = i + 1
        while j < len(ranges) and ranges[j][0] - end <= gap and max(end, sum(ranges[j])) - start <= most:
            end = max(end, sum(ranges[j]))
            j += 1
        yield start, end, i, j
        i = j


def _uri(file: str) -> str:
    return re.sub(r"^file:/+", "file:///", file)


def _reader(gap: int, most: int):
    def run(batches):
        from urllib.parse import unquote

        from pyarrow import fs

        for b in batches:
            rows = sorted(zip(b.column("file").to_pylist(), b.column("offset").to_pylist(), b.column("length").to_pylist()))
            out, at = [], 0
            while at < len(rows):
                file, stop = rows[at][0], at
                while stop < len(rows) and rows[stop][0] == file:
                    stop += 1
                ranges = [r[1:] for r in rows[at:stop]]
                store, where = fs.FileSystem.from_uri(_uri(file))
                with store.open_input_file(unquote(where)) as f:
                    for start, end, i, j in coalesce_ranges(ranges, gap, most):
                        chunk = f.read_at(end - start, start)
                        out += [chunk[o - start : o - start + n] for o, n in ranges[i:j]]
                at = stop
            yield from _read_rows(out)

    return run


def _read_rows(raws: list[bytes]):
    cols: dict[str, list] = {k: [] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload")}
    for raw in raws:
        r = parse_record(raw)
        whole = r["warc-type"] == "response"
        number = lambda x: int(x) if x else None
        cols["page_id"].append(number(r["warc-page-id"]))
        cols["payload_bytes"].append(len(r["payload"]) if whole else r["payload_bytes"])
        cols["payload_digest"].append(base64.b32encode(hashlib.sha1(r["payload"]).digest()).decode() if whole else r["warc-payload-digest"].partition(":")[2])
        cols["record_type"].append(r["warc-type"])
        cols["refers_to"].append(None if whole else number(r["warc-refers-to-page"]))
        cols["url"].append(r.get("warc-target-uri"))
        cols["payload"].append(r["payload"] if whole else None)
    yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "payload" else pa.string() if k in ("payload_digest", "record_type", "url") else pa.int64()) for k, v in cols.items()})


RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, payload binary"


def _whole_files(batches):
    """For stores that only Spark reads: each archive once, then the same ranges of it."""
    for b in batches:
        for content, ranges in zip(b.column("content").to_pylist(), b.column("ranges").to_pylist()):
            yield from _read_rows([content[r["offset"] : r["offset"] + r["length"]] for r in ranges])


def read_records(spark: SparkSession, path: str, selected: DataFrame, gap: int = 1 << 16, most: int = 1 << 23, ranged: bool | None = None) -> DataFrame:
    """Records of the index rows ``selected``, by coalesced byte ranges of at most ``most`` bytes.

    ranged: None tries whether byte ranges of the store can be read from Python, else reads whole files
    through Spark."""
    bounded_batches(spark)
    files = archive_files(spark, path)
    if ranged is None:
        first = files.select("file").first()
        ranged = first is None or _can_range(first["file"])
    want = selected.select("archive", "offset", "length")
    if not ranged:
        content = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(f"{path}/archives")
        content = content.select(F.regexp_extract("path", r"archive=(\d+)/", 1).cast("int").alias("archive"), "content")
        lists = want.groupBy("archive").agg(F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("ranges"))  # bounded by an archive's size
        return content.join(lists, "archive").select("content", "ranges").mapInArrow(lean(_whole_files), RECORD)
    stretch = (F.col("offset") / most).cast("bigint")
    rows = want.join(files, "archive").select("file", "offset", "length").repartition(shuffle_parts(spark), "file", stretch).sortWithinPartitions("file", "offset")
    return rows.mapInArrow(lean(_reader(gap, most)), RECORD)


def _can_range(file: str) -> bool:
    from urllib.parse import unquote

    from pyarrow import fs

    try:
        store, where = fs.FileSystem.from_uri(_uri(file))
        with store.open_input_file(unquote(where)) as f:
            f.read_at(1, 0)
        return True
    except (pa.ArrowException, OSError, ValueError):
        return False


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write all pages to archives in the shared folder and read every record back."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    index = write_archives(pages, path, least)
    return read_records(spark, path, index)
