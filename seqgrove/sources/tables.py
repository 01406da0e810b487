"""Tab-separated sources with their validations: profiles, motif libraries, clusters, hits, cluster meta."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TERM = r"(GO:\d{7})"
#: Values of motif_present that mean yes and no. Fixed values.
YES, NO = ("1", "true", "yes", "y", "t"), ("0", "false", "no", "n", "f", "")


def _need(df: DataFrame, path: str, columns: tuple[str, ...]) -> DataFrame:
    if gone := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{path} lacks the column(s) {', '.join(gone)}")
    return df


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...] = (), comment: str | None = None) -> DataFrame:
    r = spark.read.option("sep", "\t").option("header", "true").option("quote", "")
    return _need((r.option("comment", comment) if comment else r).csv(path), path, columns)


def _refuse(bad: DataFrame, what: str, column: str, row: str | None = None) -> None:
    """An error that names the first five, with their row (from 1) where there is one."""
    if row is not None:
        bad = bad.orderBy(row)
    if rows := bad.select(column, *([row] if row else [])).limit(5).collect():
        raise ValueError(f"{what}: " + ", ".join(f"{r[0]} (row {r[1] + 1})" if row else str(r[0]) for r in rows))


def read_profiles(spark: SparkSession, path: str, parts: int | None = None) -> DataFrame:
    """entity, term_ids (distinct, in order): headerless; the last line of an entity counts. parts: partitions for the entities."""
    raw = spark.read.text(path).withColumn("ord", F.monotonically_increasing_id()).where("trim(value) <> ''")
    p = raw.select(F.split("value", "\t").alias("p"), "value", "ord")
    _refuse(p.where((F.size("p") < 2) | (F.trim(F.col("p")[0]) == "")), "profile lines without an entity or terms", "value")
    ids = F.array_distinct(F.regexp_extract_all(F.col("p")[1], F.lit(TERM), F.lit(1)))
    p = p.select(F.trim(F.col("p")[0]).alias("entity"), ids.alias("term_ids"), "ord")
    p = p if parts is None else p.repartition(parts, "entity")
    return p.groupBy("entity").agg(F.max_by("term_ids", "ord").alias("term_ids"))


def profile_rows(profiles: DataFrame) -> DataFrame:
    return profiles.select("entity", F.posexplode("term_ids").alias("ord", "term_id"))


def profiles_of(annotations: DataFrame, namespace: str = "F", low: tuple[str, ...] = ("ND", "NAS")) -> DataFrame:
    """entity, term_ids (sorted): entities with good evidence, unknown and obsolete terms included."""
    good = annotations.where((F.col("namespace") == namespace) & ~F.col("evidence").isin(*low))
    return good.groupBy("entity").agg(F.sort_array(F.collect_set("term_id")).alias("term_ids"))


def excluded(annotations: DataFrame, namespace: str = "F", low: tuple[str, ...] = ("ND", "NAS")) -> DataFrame:
    return annotations.where((F.col("namespace") == namespace) & F.col("evidence").isin(*low)).select("entity", "term_id", "evidence")


def read_motifs(spark: SparkSession, path: str) -> DataFrame:
    """ord, name, description, pattern, status: blank or repeated names are errors.

    The motif stands in ``pattern``, or in the one column ``..._pattern`` that isn't the PROSITE source."""
    m = read_tsv(spark, path, ("name", "description", "status"), comment="#")
    found = [c for c in m.columns if c == "pattern" or c.endswith("_pattern") and c != "prosite_pattern"]
    if len(found) != 1:
        raise ValueError(f"{path} must have one column of motif patterns")
    m = m.withColumnRenamed(found[0], "pattern").withColumn("ord", F.monotonically_increasing_id())
    blank = lambda c: F.trim(F.coalesce(F.col(c), F.lit(""))) == ""
    _refuse(m.where(blank("name") | blank("pattern") | blank("status")), "motif rows with blank fields", "name", "ord")
    _refuse(m.groupBy("name").agg(F.count("*").alias("n"), F.max("ord").alias("ord")).where("n > 1"), "repeated motif names", "name", "ord")
    return m.select("ord", "name", F.coalesce("description", F.lit("")).alias("description"), "pattern", "status")


def read_members(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """entity, cluster_id; an entity in two clusters is an error. strict: exactly these two columns, none blank."""
    m = read_tsv(spark, path, ("member_id", "cluster_id"))
    if strict and m.columns != ["member_id", "cluster_id"]:
        raise ValueError(f"{path} must have the header member_id, cluster_id")
    rows = m.select(F.trim("member_id").alias("entity"), F.trim("cluster_id").alias("cluster_id"))
    full = (F.coalesce("entity", F.lit("")) != "") & (F.coalesce("cluster_id", F.lit("")) != "")
    if strict:
        _refuse(rows.where(~full), "membership rows with blank fields", "entity")
    rows = rows.where(full)
    _refuse(rows.groupBy("entity").count().where("count > 1"), "entities in several rows", "entity")
    return rows


def read_hits(spark: SparkSession, path: str) -> DataFrame:
    """accession, motif_id of the rows that say present; a comment line and blank lines are skipped.

    ``motif_present`` decides where the column exists, else ``count`` above 0, else the row itself."""
    h = read_tsv(spark, path, ("accession", "motif_id"))
    h = h.where(F.col("accession").isNotNull() & ~F.startswith(F.trim("accession"), F.lit("#")) & F.col("motif_id").isNotNull())
    if "motif_present" in h.columns:
        v = F.lower(F.trim(F.coalesce("motif_present", F.lit(""))))
        _refuse(h.where(~v.isin(*YES, *NO)), "unreadable motif_present", "motif_present")
        h = h.where(v.isin(*YES))
    elif "count" in h.columns:
        _refuse(h.where(F.expr("try_cast(count as double)").isNull()), "unreadable count", "count")
        h = h.where(F.expr("try_cast(count as double) > 0"))
    return h.select(F.trim("accession").alias("accession"), F.trim("motif_id").alias("motif_id"))


def read_cluster_meta(spark: SparkSession, path: str) -> DataFrame:
    """cluster_id, size, composed_go (array, distinct), description, sim_ave, sim_min, sim_max (null for NA)."""
    m = read_tsv(spark, path, ("cluster_id", "composed_go"))
    raw = F.transform(F.split(F.translate(F.coalesce("composed_go", F.lit("")), ",", ";"), ";"), lambda x: F.trim(x))
    opt = lambda c, kind: F.expr(f"try_cast({c} as {kind})").alias(c) if c in m.columns else F.lit(None).cast(kind).alias(c)
    text = F.coalesce("composed_description", F.lit("")) if "composed_description" in m.columns else F.lit("")
    return m.select("cluster_id", opt("size", "int"), F.array_distinct(F.filter(raw, lambda x: x != "")).alias("composed_go"), text.alias("description"), *[opt(c, "double") for c in ("sim_ave", "sim_min", "sim_max")])


def without_profile(members: DataFrame, profiles: DataFrame) -> DataFrame:
    return members.select("entity").join(profiles.select("entity"), "entity", "left_anti")


def missing_profiles(members: DataFrame, profiles: DataFrame) -> None:
    """Members without a profile are an error that names the first five."""
    _refuse(without_profile(members, profiles).orderBy("entity"), "members without a profile", "entity")
