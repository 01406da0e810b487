"""Text sources: ontology stanzas, knowledge-base records, pattern entries, FASTA.

Records come from Spark's text source with the format's own separator, so a record is a row, gzip included.
A gzip file is one split; callers repartition what they parse from it or write it as Parquet first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROOT = "GO:0003674"
NAMESPACES = {"F": "molecular_function", "P": "biological_process", "C": "cellular_component"}


def _records(spark: SparkSession, path: str, separator: str) -> DataFrame:
    return spark.read.option("lineSep", separator).text(path).withColumn("value", F.regexp_replace("value", "\r", ""))


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _field(lines: Column, key: str) -> Column:
    """The last value of ``key: value``, or null."""
    found = F.filter(lines, lambda x: F.startswith(x, F.lit(key + ": ")))
    return F.when(F.size(found) > 0, F.trim(F.substring(F.element_at(found, -1), len(key) + 3, (1 << 31) - 1)))


def read_obo(spark: SparkSession, path: str) -> DataFrame:
    """term_id, name, namespace, parents, obsolete: a row a [Term] stanza, the last of a repeated id.

    Stanzas begin at a line ``[...]``; the file is split there, whatever blank lines it has, so it is read in parallel."""
    lines = spark.read.option("lineSep", "\n[").text(path).select(F.regexp_replace("value", "\r", "").alias("stanza"), F.monotonically_increasing_id().alias("ord"))
    s = lines.where(F.startswith("stanza", F.lit("Term]")) | F.startswith("stanza", F.lit("[Term]")))
    ls = F.transform(_lines(F.col("stanza")), lambda x: F.trim(x))
    parents = F.array_distinct(F.transform(F.filter(ls, lambda x: F.startswith(x, F.lit("is_a: "))), lambda x: F.split(F.trim(F.substring(x, 7, (1 << 31) - 1)), r"\s+")[0]))
    t = s.select(_field(ls, "id").alias("term_id"), F.coalesce(_field(ls, "name"), F.lit("")).alias("name"), F.coalesce(_field(ls, "namespace"), F.lit("")).alias("namespace"), parents.alias("parents"), F.coalesce(_field(ls, "is_obsolete") == "true", F.lit(False)).alias("obsolete"), "ord")
    t = t.where("term_id is not null")
    return t.groupBy("term_id").agg(F.max_by(F.struct("name", "namespace", "parents", "obsolete"), "ord").alias("t")).select("term_id", "t.*")


def project(terms: DataFrame, namespace: str = "molecular_function", root: str = ROOT) -> tuple[DataFrame, DataFrame]:
    """(terms, edges) of one namespace, without obsolete terms and without what the root doesn't reach."""
    from seqgrove.operators.ontology import reachable

    kept = terms.where((F.col("namespace") == namespace) & ~F.col("obsolete"))
    if not kept.where(F.col("term_id") == root).take(1):
        raise ValueError(f"the ontology lacks its root {root}")
    edges = kept.select(F.col("term_id").alias("child"), F.explode("parents").alias("parent")).join(kept.select(F.col("term_id").alias("parent")), "parent", "left_semi").distinct()
    depth = reachable(edges, root)
    kept = kept.join(depth, "term_id").select("term_id", "name", "depth")
    inside = depth.select("term_id")
    edges = edges.join(inside.withColumnRenamed("term_id", "child"), "child", "left_semi").join(inside.withColumnRenamed("term_id", "parent"), "parent", "left_semi")
    return kept, edges.select("child", "parent")


def children(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("parent").alias("term_id")).agg(F.sort_array(F.collect_set("child")).alias("children"))


def read_knowledge_base(spark: SparkSession, path: str) -> DataFrame:
    """accession, record: the first token of the first AC line that has one. Ends at a line ``//``."""
    r = _records(spark, path, "\n//\n").select(F.regexp_replace("value", r"\n//\s*$", "").alias("record"))
    ac = F.filter(F.transform(F.filter(_lines(F.col("record")), lambda x: F.startswith(x, F.lit("AC "))), lambda x: F.trim(F.split(F.trim(F.substring(x, 3, (1 << 31) - 1)), ";")[0])), lambda x: x != "")
    return r.select(F.when(F.size(ac) > 0, ac[0]).alias("accession"), "record").where("accession is not null")


def annotations(records: DataFrame) -> DataFrame:
    """entity, ord, term_id, namespace (F, P or C), evidence from the ``DR   GO;`` lines, in order."""
    dr = F.filter(_lines(F.col("record")), lambda x: x.rlike(r"^DR\s+GO;"))
    a = records.select(F.col("accession").alias("entity"), F.posexplode(dr).alias("ord", "line"))
    parts = F.transform(F.split("line", ";"), lambda x: F.trim(x))
    a = a.withColumn("p", parts).where(F.size("p") >= 4)
    return a.select("entity", "ord", F.col("p")[1].alias("term_id"), F.substring_index(F.col("p")[2], ":", 1).alias("namespace"), F.substring_index(F.col("p")[3], ":", 1).alias("evidence")).where(F.startswith("term_id", F.lit("GO:")))


def sequences(records: DataFrame) -> DataFrame:
    """accession, sequence, length: the lines after SQ without white space; records without one drop out."""
    body = F.regexp_extract("record", r"(?s)(?:^|\n)SQ[^\n]*\n(.*)$", 1)
    s = F.regexp_replace(body, r"\s", "")
    return records.select("accession", s.alias("sequence")).where("sequence <> ''").withColumn("length", F.length("sequence"))


def entry_annotations(spark: SparkSession, lines: list[str]) -> DataFrame:
    """``annotations`` of one entry given as its lines."""
    return annotations(spark.createDataFrame([("", "\n".join(lines))], "accession string, record string"))


def sequence_counts(sequence_rows: DataFrame) -> DataFrame:
    """One row: sequences and residues."""
    return sequence_rows.agg(F.count("*").alias("sequences"), F.coalesce(F.sum(F.length("sequence").cast("bigint")), F.lit(0)).alias("residues"))


def lookup(sequence_rows: DataFrame, accession: str) -> str | None:
    """One sequence by its accession: a filter that Parquet statistics prune."""
    row = sequence_rows.where(F.col("accession") == accession).select("sequence").first()
    return row["sequence"] if row else None


def read_prosite(spark: SparkSession, path: str) -> DataFrame:
    """name, kind, ac, description, pattern of every entry (kind PATTERN or other)."""
    r = _records(spark, path, "\n//\n").withColumn("ord", F.monotonically_increasing_id())
    ls = F.filter(_lines(F.regexp_replace("value", r"\n//\s*$", "")), lambda x: F.length(x) >= 5)
    of = lambda key: F.transform(F.filter(ls, lambda x: F.startswith(x, F.lit(key + " "))), lambda x: F.trim(F.substring(x, 6, (1 << 31) - 1)))
    last = lambda a: F.when(F.size(a) > 0, F.element_at(a, -1))
    ident = F.transform(F.split(last(of("ID")), ";"), lambda x: F.regexp_replace(F.trim(x), r"\.+$", ""))
    e = r.select(ident.alias("i"), F.regexp_replace(F.coalesce(last(of("AC")), F.lit("")), ";$", "").alias("ac"), F.regexp_replace(F.coalesce(last(of("DE")), F.lit("")), r"\.$", "").alias("description"), F.regexp_replace(F.array_join(of("PA"), ""), r"\.$", "").alias("pattern"), "ord").where("i is not null")
    return e.select(F.col("i")[0].alias("name"), F.when(F.size("i") > 1, F.col("i")[1]).otherwise("").alias("kind"), "ac", "description", "pattern", "ord")


def prosite_counts(entries: DataFrame) -> DataFrame:
    """One row: all entries, PATTERN entries, and those without a pattern line."""
    p = F.col("kind") == "PATTERN"
    return entries.agg(F.count("*").alias("total"), F.sum(p.cast("bigint")).alias("patterns"), F.sum((p & (F.col("pattern") == "")).cast("bigint")).alias("skipped"))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """query, sequence, ord: what stands before the first ``>`` of a file is dropped; the id is the first word. Read in parallel."""
    r = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace("value", "\r", "").alias("r"), F.monotonically_increasing_id().alias("ord"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    # a file's first record has its own ``>``, or is no record: a row a file
    first = r.where("block = 0").groupBy("file").agg(F.min("ord").alias("lead"))
    r = r.join(first, "file").where((F.col("ord") != F.col("lead")) | F.startswith("r", F.lit(">"))).select("ord", F.regexp_replace("r", "^>", "").alias("r"))
    head, body = F.substring_index("r", "\n", 1), F.regexp_replace("r", r"^[^\n]*", "")
    q = r.select(F.split(F.trim(head), r"\s+")[0].alias("query"), normalise(body).alias("sequence"), "ord")
    return q


def normalise(sequence: Column) -> Column:
    return F.upper(F.regexp_replace(sequence, r"\s", ""))


def to_fasta(sequence_rows: DataFrame) -> DataFrame:
    """One text value a record, for the text sink."""
    return sequence_rows.select(F.concat(F.lit(">"), F.col("accession"), F.lit("\n"), F.col("sequence")).alias("value"))


def ordered(rows: DataFrame, *keys: str) -> DataFrame:
    """rows with ``ord`` from 0 in the order of ``keys``."""
    from seqgrove.operators.numbering import numbered

    return numbered(rows, "ord", *keys)
