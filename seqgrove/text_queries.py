"""Queries that write text formats from the driver's tables and read them back, and properties of clusterings, with their SQL."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrove.functions import text
from seqgrove.functions.describe import Term, describe_column
from seqgrove.operators import community, linkage, ontology, panel, scoreboard
from seqgrove.operators.components import components
from seqgrove.plans import build
from seqgrove.plans import driver_tables as T
from seqgrove.session import ship
from seqgrove.sources import fasta_index, flatfiles, tables
from seqgrove.storage import fresh_path, materialise, parts_for, spread


#: Records of a file, which a task sorts, about.
FILE_ROWS = 200_000


def written(spark: SparkSession, records: DataFrame, separator: str = "\n", head: str | None = None, gz: bool = False, rows: int = 0) -> str:
    """Text files of ``value`` rows, written and later read in parallel, each after the line(s) of ``head``.

    rows: how many records there are, about; more than ``FILE_ROWS`` a file are dealt to more files. Rows go to files by a hash: of ``key`` where there is one, those of one key in the order of ``ord``.
    A file is one partition, so no task takes several; only heads and ``ord`` need an order, and other records are streamed."""
    path, files = fresh_path(spark, "text"), max(spark.sparkContext.defaultParallelism, -(-rows // FILE_ROWS))
    has = lambda c, other: F.col(c) if c in records.columns else other
    rows = records.select("value", F.pmod(F.xxhash64(has("key", F.col("value"))), F.lit(files)).cast("int").alias("file"), has("ord", F.lit(1)).cast("int").alias("ord"))
    if head is not None:
        rows = rows.unionByName(spark.range(files).select(F.lit(head).alias("value"), F.col("id").cast("int").alias("file"), F.lit(-1).alias("ord")))
    dealt = rows.repartitionById(files, "file")
    w = (dealt.sortWithinPartitions("ord") if head is not None or "ord" in records.columns else dealt).select("value").write.option("lineSep", separator)
    (w.option("compression", "gzip") if gz else w).text(path)
    return path


def _id(c: Column) -> Column:
    return F.regexp_replace(c, " ", "_")


def q34_ontology_file(spark: SparkSession, sf: str) -> DataFrame:
    """Ontology P as stanzas, among others that don't belong to it, read and projected."""
    terms, edges = T.ontology_p(spark, sf)
    up = edges.groupBy(F.col("child").alias("term_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_set("parent")), lambda p: F.concat(F.lit("is_a: "), _id(p), F.lit(" ! said\n"))), "").alias("is_a"))
    stanza = F.concat(F.lit("[Term]\nid: "), _id(F.col("term_id")), F.lit("\nname: "), "name", F.lit("\nnamespace: molecular_function\n"), F.coalesce("is_a", F.lit("")), F.lit("is_a: X:gone\n"))
    odd = [f"[Term]\nid: X:{n}\nname: {n}\nnamespace: {space}\n{more}" for n, space, more in (("obsolete", "molecular_function", "is_a: ROOT\nis_obsolete: true\n"), ("process", "biological_process", "is_a: ROOT\n"), ("alone", "molecular_function", ""), ("above", "molecular_function", "is_a: X:alone\n"))]
    rows = terms.join(up, "term_id", "left").select(stanza.alias("value")).union(spark.createDataFrame([(x,) for x in [*odd, "[Typedef]\nid: part_of\nname: part of\n"]], "value string"))
    kept, links = flatfiles.project(flatfiles.read_obo(spark, written(spark, rows, "\n", "format-version: 1.2\n")), root=T.ROOT)
    parents = links.groupBy(F.col("child").alias("term_id")).agg(F.array_join(F.sort_array(F.collect_set("parent")), ";").alias("parents"))
    return kept.join(parents, "term_id", "left").select("term_id", "name", "depth", F.coalesce("parents", F.lit("")).alias("parents"))


def _knowledge_base(spark, sf) -> DataFrame:
    """An entry an order: its parts as annotations, its priority's letters as sequence, none for open orders."""
    items, o = T.table(spark, sf, "lineitem").select("l_orderkey", "l_partkey"), T.table(spark, sf, "orders")
    n, entries = items.count(), o.count()
    most = max(n, entries)
    parts = spread(items, most, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set("l_partkey")).alias("parts"))
    o = spread(o, most, "o_orderkey").join(parts, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    line = lambda p: F.concat(F.lit("DR   GO; GO:"), F.lpad(p.cast("string"), 7, "0"), F.lit("; "), F.element_at(F.array(F.lit("F"), F.lit("P"), F.lit("C")), (p % 3 + 1).cast("int")), F.lit(":said; "), F.when(p % 7 == 0, "ND").otherwise("EXP"), F.lit(":source.\n"))
    notes = F.coalesce(F.array_join(F.transform("parts", line), ""), F.lit(""))
    letters = F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", ""))
    body = F.when(F.col("o_orderstatus") == "O", "").otherwise(F.concat(F.lit("SQ   SEQUENCE\n     "), F.substring(letters, 1, 2), F.lit(" "), F.substring(letters, 3, 2), F.lit("\n     "), F.substring(letters, 5, 99), F.lit("\n")))
    key = F.col("o_orderkey").cast("string")
    value = F.concat(F.lit("ID   ENTRY\nAC   O"), key, F.lit("; Z"), key, F.lit(";\nAC   Q1;\nDR   PDB; 1ABC; X; Y.\nDR   GO; GO:0000001.\n"), notes, body, F.lit("//"))
    return flatfiles.read_knowledge_base(spark, written(spark, o.select(value.alias("value")), gz=True, rows=entries))


def q35_annotations(spark: SparkSession, sf: str) -> DataFrame:
    return flatfiles.annotations(_knowledge_base(spark, sf))


def q36_sequences(spark: SparkSession, sf: str) -> DataFrame:
    return flatfiles.sequences(_knowledge_base(spark, sf))


def q37_profile_file(spark: SparkSession, sf: str) -> DataFrame:
    """Profiles of good evidence, written, and read with repeated and later lines."""
    n, entries = (T.table(spark, sf, x).count() for x in ("lineitem", "orders"))
    p = tables.profiles_of(spread(q35_annotations(spark, sf), n, "entity"))
    line = F.concat("entity", F.lit("\t"), F.array_join("term_ids", "; "), F.lit(" "), F.col("term_ids")[0])
    earlier = spark.range(1).select(F.lit("O1\tGO:9999999\n").alias("value"), F.lit("O1").alias("key"), F.lit(0).alias("ord"))
    back = tables.read_profiles(spark, written(spark, p.select(line.alias("value"), F.col("entity").alias("key"), F.lit(1).alias("ord")).unionByName(earlier), rows=entries), parts_for(spark, entries))
    return back.select("entity", F.array_join("term_ids", ";").alias("terms"))


def q38_excluded(spark: SparkSession, sf: str) -> DataFrame:
    return tables.excluded(q35_annotations(spark, sf))


def _prosite(spark, sf) -> DataFrame:
    """Pattern entries by brand and size: every tenth is no pattern, every seventh has none, size 1 has a bad range."""
    p = T.table(spark, sf, "part").select(F.regexp_extract("p_brand", "[0-9]+", 0).alias("b"), F.col("p_size").cast("string").alias("n"), "p_size").distinct()
    kind = F.when(F.col("p_size") % 10 == 0, "MATRIX").otherwise("PATTERN")
    pattern = F.when(F.col("p_size") % 7 == 0, "").otherwise(F.concat(F.lit("PA   <x(2,"), "n", F.lit(")-[AC]-{P}\nPA   -A(3)-B-x(2).\n")))
    value = F.concat(F.lit("ID   B"), "b", F.lit("_"), "n", F.lit("; "), kind, F.lit(".\nAC   PS"), "b", F.lit(";\nDE   Brand "), "b", F.lit(".\n"), pattern, F.lit("//"))
    return flatfiles.read_prosite(spark, written(spark, p.select(value.alias("value"))))


def q39_motif_library(spark: SparkSession, sf: str) -> DataFrame:
    """PROSITE entries translated to the motif language, written as a library and read back."""
    good, _ = build.translated(_prosite(spark, sf))
    rows = good.select(F.concat_ws("\t", "name", "ac", "description", "prosite_pattern", "pattern", "status").alias("value"))
    path = written(spark, rows, head="# a library\nname\tprosite_ac\tdescription\tprosite_pattern\tmotif_pattern\tstatus")
    return tables.read_motifs(spark, path).select("name", "description", "pattern", "status")


def q40_prosite_counts(spark: SparkSession, sf: str) -> DataFrame:
    entries = _prosite(spark, sf)
    _, failed = build.translated(entries)
    return flatfiles.prosite_counts(entries).crossJoin(failed.agg(F.count("*").alias("failed")))


def q41_member_file(spark: SparkSession, sf: str) -> DataFrame:
    m = T.document_clusters(spark, sf)
    path = written(spark, m.select(F.concat_ws("\t", "entity", "cluster_id").alias("value")), head="member_id\tcluster_id")
    return tables.read_members(spark, path, strict=True).groupBy("cluster_id").agg(F.count("*").alias("members"), F.min("entity").alias("first"))


def q42_hit_file(spark: SparkSession, sf: str) -> DataFrame:
    """Hits as written by many hands: presence as words, counts that presence overrules."""
    said = F.element_at(F.array(*[F.lit(x) for x in ("1", "Yes", "0", "", "true", "n")]), (F.col("p_partkey") % 6 + 1).cast("int"))
    rows = T.table(spark, sf, "part").select(F.concat_ws("\t", F.concat(F.lit("A"), F.col("p_partkey").cast("string")), F.col("p_brand"), F.lit("0"), said).alias("value"))
    return tables.read_hits(spark, written(spark, rows, head="accession\tmotif_id\tcount\tmotif_present\n#x\ty\t1\t1"))


def q43_meta_file(spark: SparkSession, sf: str) -> DataFrame:
    """Cluster rows with mixed separators, repeated terms and scores that are not available."""
    n = T.table(spark, sf, "nation")
    go = F.concat(F.lit("GO:"), F.lpad(F.col("n_regionkey").cast("string"), 7, "0"))
    value = F.concat_ws("\t", F.concat(F.lit("cluster_"), F.lpad(F.col("n_nationkey").cast("string"), 4, "0")), F.when(F.col("n_nationkey") % 2 == 0, "NA").otherwise("0.50000"), F.length("n_name").cast("string"), F.when(F.col("n_nationkey") % 5 == 0, "").otherwise(F.concat(go, F.lit("; GO:0000009,"), go)))
    m = tables.read_cluster_meta(spark, written(spark, n.select(value.alias("value")), head="cluster_id\tsim_ave\tsize\tcomposed_go"))
    return m.select("cluster_id", "size", F.array_join("composed_go", ";").alias("terms"), "sim_ave")


def q44_fasta(spark: SparkSession, sf: str) -> DataFrame:
    p = T.table(spark, sf, "supplier").select(F.concat(F.lit(">S"), F.col("s_suppkey").cast("string"), F.lit(" a supplier\r\n"), F.substring(F.lower("s_name"), 1, 4), F.lit(" \n\n"), F.substring("s_name", 5, 99)).alias("value"))
    return flatfiles.read_fasta(spark, written(spark, p, head="; junk")).select("query", "sequence")


def q45_role_counts(spark: SparkSession, sf: str) -> DataFrame:
    from seqgrove.operators import roles
    from seqgrove.queries import q27_roles

    return roles.role_counts(q27_roles(spark, sf))


def q46_propagation_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' leaves against an ontology without one type, some of whose terms count as obsolete."""
    terms, _ = T.ontology_p(spark, sf)
    name = F.regexp_extract("term_id", r"\|Brand#(\d)", 1)
    return ontology.propagation_counters(T.order_profiles(spark, sf), terms.where(~name.isin("1", "2")), terms.where(name == "2"))


def q47_motif_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Weights of all clusters with their motifs' descriptions, which some motifs lack, and odds as they are written."""
    from seqgrove.queries import _board

    rated = _board(spark, sf)[3]
    names = spark.createDataFrame([(n, f"matches {p}") for n, p in T.MOTIFS[::2]], "motif_id string, said string")
    r = scoreboard.weights(rated).join(names, "motif_id", "left")
    return r.select("cluster_id", "motif_id", F.coalesce("said", F.lit("")).alias("description"), F.round("weight", 9).alias("weight"))


def q48_missing_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """Customers none of whose orders is urgent: an urgent order is what gives a profile."""
    members = T.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("entity"))
    urgent = T.table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return tables.without_profile(members, urgent.select(F.col("o_custkey").cast("string").alias("entity")))


def q49_panel_candidates(spark: SparkSession, sf: str) -> DataFrame:
    """Nations with enough customers as clusters: the largest and seeded others."""
    c = T.customers(spark, sf)
    sizes = c.groupBy(F.col("nation").alias("cluster_id")).agg(F.count("*").alias("size"))
    return panel.prefilter(sizes, c.where("region <> 'ASIA'").select(F.col("nation").alias("cluster_id")), 3, 9, seed=4)


def q50_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences about a kinase of each type, an ion binding of each brand and a transporter."""
    p = T.table(spark, sf, "part").select(F.lower("p_type").alias("t"), F.regexp_extract("p_brand", "[0-9]+", 0).alias("n")).distinct()
    ion = F.concat(F.when(F.col("n").cast("int") % 2 == 1, "a").otherwise("b"), "n", F.lit(" ion binding"))
    named = lambda k, name: F.struct(F.concat(F.lit(k), name).alias("id"), name.alias("name"))
    sets = p.select(F.concat_ws("_", "t", "n").alias("query"), F.array(named("I:", ion), named("K:", F.concat("t", F.lit(" kinase activity"))), named("X:", F.concat("t", F.lit(" sugar transporter"))), named("A:", F.lit("transferase activity"))).alias("terms"))
    every = sets.select(F.explode("terms").alias("x")).select("x.id", "x.name").distinct().collect()  # the ontology's terms
    kinases = frozenset(("A:transferase activity",))
    graph = {r["id"]: Term(r["id"], r["name"], kinases if r["id"].startswith("K:") else frozenset()) for r in every}
    said = describe_column(spark.sparkContext.broadcast(graph))
    return sets.select("query", said("query", F.transform("terms", lambda x: x["id"])).alias("summary"))


def q51_linkage_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Complete linkage of all customers at 0.6: no pair inside a cluster is less alike, and no two clusters of a community could be one.

    Counted over pairs of profiles with their members' numbers, so pairs of members are never made."""
    from seqgrove.queries import _regions

    rows, scores = _regions(spark, sf, "community")
    made = materialise(linkage.refine_profiles(rows, scores, 0.6).withColumnRenamed("community", "cluster"), "clusters")
    held = rows.join(made, "entity").groupBy("community", "cluster", "profile").agg(F.count("*").alias("n"))
    side = lambda p, c, n: held.select("community", F.col("profile").alias(p), F.col("cluster").alias(c), F.col("n").alias(n))
    j = side("a", "x", "m").join(side("b", "y", "n"), "community").where("a < b or (a = b and (x < y or (x = y and n > 1)))").join(scores, ["a", "b"], "left").withColumn("v", F.coalesce("amb", F.lit(0.0)))
    times = F.when((F.col("a") == F.col("b")) & (F.col("x") == F.col("y")), F.col("n") * (F.col("n") - 1) / 2).otherwise(F.col("m") * F.col("n")).cast("bigint")
    inside = j.where("x = y").agg(F.coalesce(F.sum(F.when(F.col("v") < 0.6 - 1e-12, times)), F.lit(0)).alias("pairs_below"))
    between = j.where("x <> y").groupBy(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).agg(F.min("v").alias("v")).agg(F.coalesce(F.sum((F.col("v") >= 0.6 + 1e-12).cast("bigint")), F.lit(0)).alias("mergeable"))
    stats = linkage.refine_stats(rows.select("entity", "community"), made.select("entity", F.col("cluster").alias("community"))).select("communities", "pairs", "same_members")
    return stats.crossJoin(inside).crossJoin(between)  # one row each


def q52_community_properties(spark: SparkSession, sf: str) -> DataFrame:
    """Leiden: every vertex in one connected community, named by its smallest member, better than single vertices and than components."""
    from seqgrove.queries import q13_knn_edges

    e = materialise(q13_knn_edges(spark, sf), "edges")
    comp = components(e.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    c = materialise(community.communities(e, comp=comp), "communities")
    groups = c.join(comp.select(F.col("u").alias("entity"), "v"), "entity", "left").select("entity", "community", F.coalesce("v", "entity").alias("root"), F.col("entity").alias("alone"))
    groups = materialise(groups, "divisions")
    side = lambda v, at: groups.select(F.col("entity").alias(v), *[F.col(n).alias(f"{at}_{n}") for n in ("community", "root", "alone")])
    j = materialise(e.join(side("src", "x"), "src").join(side("dst", "y"), "dst"), "placed-edges")
    parts = components(j.where("x_community = y_community").select(F.col("src").alias("u"), F.col("dst").alias("v")))
    whole = c.join(parts.select(F.col("u").alias("entity"), "v"), "entity", "left").select("community", F.coalesce("v", "entity").alias("part"))
    split = whole.groupBy("community").agg(F.countDistinct("part").alias("n")).agg(F.sum((F.col("n") > 1).cast("bigint")).alias("unconnected"))
    names = c.groupBy("community").agg(F.min("entity").alias("least")).agg(F.sum((F.col("least") != F.col("community")).cast("bigint")).alias("misnamed"))
    found = community.qualities(j, groups, ["community", "root", "alone"])
    better = found.select(((F.col("community") >= F.col("alone") - 1e-9) & (F.col("community") >= F.col("root") - 1e-9)).alias("better"))
    return c.agg(F.countDistinct("entity").alias("vertices"), F.count("*").alias("rows")).crossJoin(split).crossJoin(names).crossJoin(better)  # one row each


def q53_stable_ids(spark: SparkSession, sf: str) -> DataFrame:
    m = T.document_clusters(spark, sf).withColumnRenamed("cluster_id", "community")
    return community.stable_ids(m).groupBy("cluster_id").agg(F.count("*").alias("size"), F.min("entity").alias("first"))


def q56_indexed_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences of orders that are not open, written as FASTA with an index, and those of all orders looked up by it."""
    o = T.table(spark, sf, "orders").select(F.concat(F.lit("O"), F.col("o_orderkey").cast("string")).alias("accession"), "o_orderstatus", F.lower(F.regexp_replace("o_orderpriority", "[^A-Za-z]", "")).alias("sequence"))
    path = fresh_path(spark, "fasta")
    fasta_index.write_fasta(o.where("o_orderstatus <> 'O'"), path)
    return fasta_index.indexed_sequences(spark, path, o)


def _arrow_text(f):
    """A function of a value as a column of strings, in Arrow batches."""

    @F.pandas_udf("string")
    def run(values: pd.Series) -> pd.Series:
        return values.map(f)

    return run


def q57_query_strings(spark: SparkSession, sf: str) -> DataFrame:
    """What parts' numbers ask for when written as sets (with one to three ids, some twice, some broken), clusters and accessions."""
    ship(spark)
    p = T.table(spark, sf, "part").select("p_partkey", "p_size")
    go = lambda c: F.concat(F.lit("GO:"), F.lpad(c.cast("string"), 7, "0"))
    k, n = F.col("p_partkey"), F.col("p_size")
    asked = F.element_at(F.array(F.concat(F.lit("("), go(k), F.lit("; "), go(n), F.lit(";"), go(k), F.lit(")")), F.concat(go(n), F.lit(",GO:1")), F.concat(F.lit("cluster_"), k.cast("string")), F.concat(F.lit("A"), k.cast("string")), F.concat(F.lit("("), go(k)), go(n)), (k % 6 + 1).cast("int"))

    def told(query: str) -> str:
        if (what := text.kind(query)) != "set":
            return what
        try:
            return ";".join(text.parse_term_set(query))
        except ValueError:
            return "refused"

    return p.select("p_partkey", _arrow_text(told)(asked).alias("told"))


def q58_number_formats(spark: SparkSession, sf: str) -> DataFrame:
    """Orders' prices a hundred thousandth, as reports write them: four digits and three, trimmed, and seven places with five digits."""
    ship(spark)
    o = T.table(spark, sf, "orders").select("o_orderkey", (F.col("o_totalprice") / 100000).alias("x"), "o_orderstatus")
    as_text = lambda f: _arrow_text(f)("x")
    return o.select("o_orderkey", as_text(lambda x: text.number(x)).alias("four"), as_text(lambda x: text.number(x, 3)).alias("three"), as_text(text.similarity).alias("five"))


def q59_lenient_members(spark: SparkSession, sf: str) -> DataFrame:
    """A membership table with its columns in another order, one more column and rows without a cluster."""
    m = T.document_clusters(spark, sf)
    cluster = F.when(F.endswith("entity", F.lit("7")), " ").otherwise(F.col("cluster_id"))
    path = written(spark, m.select(F.concat_ws("\t", cluster, F.lit("said"), F.concat(F.lit(" "), "entity")).alias("value")), head="cluster_id\tnote\tmember_id")
    return tables.read_members(spark, path).groupBy("cluster_id").agg(F.count("*").alias("members"), F.min("entity").alias("first"))


QUERIES = {f.__name__: f for f in (
    q34_ontology_file, q35_annotations, q36_sequences, q37_profile_file, q38_excluded, q39_motif_library, q40_prosite_counts, q41_member_file, q42_hit_file, q43_meta_file,
    q44_fasta, q45_role_counts, q46_propagation_counters, q47_motif_rows, q48_missing_profiles, q49_panel_candidates, q50_sentences, q51_linkage_properties, q52_community_properties, q53_stable_ids, q56_indexed_sequences, q57_query_strings, q58_number_formats, q59_lenient_members,
)}

NOTES = """WITH n AS (
  SELECT 'O' || l_orderkey AS entity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) + 1 AS ord, l_partkey AS k FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
a AS (SELECT entity, ord::INTEGER AS ord, printf('GO:%07d', k) AS term_id, ['F', 'P', 'C'][(k % 3 + 1)::BIGINT] AS namespace, CASE WHEN k % 7 = 0 THEN 'ND' ELSE 'EXP' END AS evidence FROM n)
"""
PATTERNS = """WITH p AS (SELECT DISTINCT regexp_extract(p_brand, '[0-9]+') AS b, p_size AS n FROM part)
"""


def sql(parts: dict[str, str]) -> dict[str, str]:
    """parts: common table expressions of the other queries."""
    w = "WITH RECURSIVE "
    P, C, IC, AMB, KNN, REGION = (parts[k] for k in ("P", "C", "IC", "AMB", "KNN", "REGION"))
    clusters = "lang || '_' || coalesce(try_cast(regexp_extract(source, '[0-9]+$') AS INTEGER) % 2, 0)::VARCHAR"
    return {
        "q34_ontology_file": w + P + """above AS (SELECT child AS term_id, string_agg(replace(parent, ' ', '_'), ';' ORDER BY replace(parent, ' ', '_')) AS parents FROM edges GROUP BY 1),
deep AS (SELECT term_id, dist FROM up WHERE ancestor = 'ROOT' UNION ALL SELECT 'ROOT', 0)
SELECT replace(term_id, ' ', '_') AS term_id, lower(regexp_replace(term_id, '^[A-Z]+:', '')) AS name, dist AS depth, coalesce(parents, '') AS parents FROM terms JOIN deep USING (term_id) LEFT JOIN above USING (term_id)""",
        "q35_annotations": NOTES.replace("+ 1 AS ord", "+ 0 AS ord") + "SELECT * FROM a",
        "q36_sequences": "WITH s AS (SELECT 'O' || o_orderkey AS accession, lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) AS sequence FROM orders WHERE o_orderstatus <> 'O') SELECT accession, sequence, length(sequence)::INTEGER AS length FROM s",
        "q57_query_strings": """WITH g AS (SELECT p_partkey, p_partkey % 6 AS k, printf('GO:%07d', p_partkey) AS a, printf('GO:%07d', p_size) AS b FROM part)
SELECT p_partkey, CASE k WHEN 0 THEN CASE WHEN a = b THEN a ELSE a || ';' || b END WHEN 1 THEN 'refused' WHEN 2 THEN 'cluster' WHEN 3 THEN 'accession' WHEN 4 THEN 'refused' ELSE b END AS told FROM g""",
        "q58_number_formats": "SELECT o_orderkey, regexp_replace(regexp_replace(printf('%.4f', o_totalprice / 100000), '0+$', ''), '[.]$', '') AS four, regexp_replace(regexp_replace(printf('%.3f', o_totalprice / 100000), '0+$', ''), '[.]$', '') AS three, printf('%7.5f', o_totalprice / 100000) AS five FROM orders",
        "q59_lenient_members": f"SELECT {clusters} AS cluster_id, count(*) AS members, min(doc_id::VARCHAR) AS first FROM documents WHERE doc_id % 10 <> 7 GROUP BY 1",
        "q56_indexed_sequences": "SELECT 'O' || o_orderkey AS accession, CASE WHEN o_orderstatus <> 'O' THEN lower(regexp_replace(o_orderpriority, '[^A-Za-z]', '', 'g')) END AS sequence FROM orders",
        "q37_profile_file": NOTES + "SELECT entity, string_agg(term_id, ';' ORDER BY term_id) AS terms FROM (SELECT DISTINCT entity, term_id FROM a WHERE namespace = 'F' AND evidence = 'EXP') GROUP BY 1" + " UNION ALL SELECT 'O1', 'GO:9999999' WHERE NOT EXISTS (SELECT 1 FROM a WHERE entity = 'O1' AND namespace = 'F' AND evidence = 'EXP')",
        "q38_excluded": NOTES + "SELECT entity, term_id, evidence FROM a WHERE namespace = 'F' AND evidence = 'ND'",
        "q39_motif_library": PATTERNS + "SELECT 'B' || b || '_' || n AS name, 'Brand ' || b AS description, '<?(2,' || n || ')[AC]!PAAA[DN]?(2)' AS pattern, 'translated' AS status FROM p WHERE n % 10 <> 0 AND n % 7 <> 0 AND n >= 2",
        "q40_prosite_counts": PATTERNS + "SELECT count(*) AS total, sum((n % 10 <> 0)::INT)::BIGINT AS patterns, sum((n % 10 <> 0 AND n % 7 = 0)::INT)::BIGINT AS skipped, sum((n = 1)::INT)::BIGINT AS failed FROM p",
        "q41_member_file": f"SELECT {clusters} AS cluster_id, count(*) AS members, min(doc_id::VARCHAR) AS first FROM documents GROUP BY 1",
        "q42_hit_file": "SELECT 'A' || p_partkey AS accession, p_brand AS motif_id FROM part WHERE p_partkey % 6 IN (0, 1, 4)",
        "q43_meta_file": "SELECT printf('cluster_%04d', n_nationkey) AS cluster_id, length(n_name)::INTEGER AS size, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE printf('GO:%07d', n_regionkey) || ';GO:0000009' END AS terms, CASE WHEN n_nationkey % 2 = 0 THEN NULL ELSE 0.5::DOUBLE END AS sim_ave FROM nation",
        "q44_fasta": "SELECT 'S' || s_suppkey AS query, upper(replace(s_name, ' ', '')) AS sequence FROM supplier",
        "q45_role_counts": "WITH r AS (" + parts["q27"] + ") SELECT source, role, count(*) AS terms FROM r GROUP BY 1, 2",
        "q46_propagation_counters": w + P + "x AS (SELECT DISTINCT entity, term_id, regexp_extract(term_id, '\\|Brand#(\\d)', 1) AS b FROM prof), y AS (SELECT entity, count(*) AS n, sum((b IN ('1', '2'))::INT) AS s, sum((b = '2')::INT) AS o FROM x GROUP BY 1) SELECT sum(n)::BIGINT AS annotations, sum(s)::BIGINT AS skipped, sum(o)::BIGINT AS obsolete, sum((s = n)::INT)::BIGINT AS entities_without_terms FROM y",
        "q47_motif_rows": "WITH " + parts["BOARD"] + ", d AS (SELECT * FROM (VALUES " + ", ".join(f"('{n}', 'matches {p}')" for n, p in T.MOTIFS[::2]) + ") v(motif_id, said)) SELECT cluster_id, motif_id, coalesce(said, '') AS description, round(weight, 9) AS weight FROM board LEFT JOIN d USING (motif_id)",
        "q48_missing_profiles": "SELECT c_custkey::VARCHAR AS entity FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_orderpriority = '1-URGENT')",
        "q49_panel_candidates": w + C + """s AS (SELECT nation AS cluster_id, count(*) AS size FROM cust WHERE region <> 'ASIA' GROUP BY 1 HAVING count(*) >= 3),
big AS (SELECT * FROM s ORDER BY size DESC, cluster_id LIMIT 4),
more AS (SELECT * FROM s WHERE cluster_id NOT IN (SELECT cluster_id FROM big) ORDER BY md5('4:' || cluster_id), cluster_id LIMIT 5)
SELECT * FROM big UNION ALL SELECT * FROM more""",
        "q50_sentences": "WITH p AS (SELECT DISTINCT lower(p_type) AS t, regexp_extract(p_brand, '[0-9]+') AS n FROM part) SELECT t || '_' || n AS query, t || '_' || n || ' is annotated as ' || CASE WHEN n::INTEGER % 2 = 1 THEN 'an a' ELSE 'a b' END || n || '-binding ' || t || ' kinase with ' || t || ' sugar transporter activity.' AS summary FROM p",
        "q51_linkage_properties": w + C + IC + ", z AS (SELECT region AS cluster_id, count(*) AS n FROM cust GROUP BY 1) SELECT count(*) AS communities, sum(n * (n - 1) // 2)::BIGINT AS pairs, true AS same_members, 0::BIGINT AS pairs_below, 0::BIGINT AS mergeable FROM z",
        "q52_community_properties": w + C + IC + KNN + ", v AS (SELECT src AS e FROM knn UNION SELECT dst FROM knn) SELECT count(*) AS vertices, count(*) AS rows, 0::BIGINT AS unconnected, 0::BIGINT AS misnamed, true AS better FROM v",
        "q53_stable_ids": f"WITH g AS (SELECT {clusters} AS c, count(*) AS size, min(doc_id::VARCHAR) AS first FROM documents GROUP BY 1) SELECT printf('cluster_%04d', row_number() OVER (ORDER BY first, size)) AS cluster_id, size, first FROM g",
    }
