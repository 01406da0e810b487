"""Ontology DAG: closure, depth, information content, frequencies.

``edges`` is (child, parent). ``closure`` is (term_id, ancestor, dist) without the term itself; ``reflexive``
adds it at distance 0. Profiles are (entity, term_id) rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqgrove.storage import materialise

#: Levels of an ontology at most. No path of a graph without cycles has more steps than the graph has edges, so
#: a small graph with a cycle ends there; deeper recursion is an error.
MOST_LEVELS = 1000
#: Rows of a closure that are broadcast.
SMALL_ROWS = 500_000


def _recursive(edges: DataFrame, sql: str) -> DataFrame:
    """A recursive query over ``{edges}``. Each level's rows are distinct, so paths that meet are followed once."""
    spark = edges.sparkSession
    # Spark stops a recursion at a million rows by default; here its end is the graph's depth
    if spark.conf.get("spark.sql.cteRecursionRowLimit") == "1000000":
        spark.conf.set("spark.sql.cteRecursionRowLimit", "-1")
    links = materialise(edges.select(F.col("child").cast("string").alias("child"), F.col("parent").cast("string").alias("parent")).distinct(), "edges")
    return materialise(spark.sql(sql, edges=links, most=min(links.count(), MOST_LEVELS - 1)), "walk")


def reachable(edges: DataFrame, root: str) -> DataFrame:
    """term_id, depth: every term under ``root`` with its least distance from it, the root included; a level a step."""
    start = root.replace("\\", "\\\\").replace("'", "\\'")
    return _recursive(
        edges,
        f"""WITH RECURSIVE walk(term_id, depth) MAX RECURSION LEVEL {MOST_LEVELS} AS (
            SELECT '{start}', 0 UNION ALL
            SELECT DISTINCT e.child, w.depth + 1 FROM walk w JOIN {{edges}} e ON w.term_id = e.parent WHERE w.depth < {{most}})
            SELECT term_id, min(depth) AS depth FROM walk GROUP BY term_id""",
    )


def closure(edges: DataFrame) -> DataFrame:
    """term_id, ancestor, dist (least number of edges): all pairs; as many joins as the graph has levels."""
    return _recursive(
        edges,
        f"""WITH RECURSIVE walk(term_id, ancestor, dist) MAX RECURSION LEVEL {MOST_LEVELS} AS (
            SELECT child, parent, 1 FROM {{edges}} UNION ALL
            SELECT DISTINCT w.term_id, e.parent, w.dist + 1 FROM walk w JOIN {{edges}} e ON w.ancestor = e.child WHERE w.dist < {{most}})
            SELECT term_id, ancestor, min(dist) AS dist FROM walk GROUP BY term_id, ancestor""",
    )


def root_paths(edges: DataFrame, root: str) -> DataFrame:
    """term_id, path: the canonical path of every reachable term, from itself to the root: the shortest, and of these the
    one whose parents come first in order.

    Each term has one next step, its least parent a level nearer to the root, so a path is followed without branching."""
    depth = reachable(edges, root)
    up = edges.join(depth.select(F.col("term_id").alias("child"), F.col("depth").alias("d")), "child").join(depth.select(F.col("term_id").alias("parent"), F.col("depth").alias("e")), "parent")
    step = up.where("d = e + 1").groupBy("child").agg(F.min("parent").alias("parent"))
    paths = _recursive(
        step,
        f"""WITH RECURSIVE walk(term_id, at, path) MAX RECURSION LEVEL {MOST_LEVELS} AS (
            SELECT child, parent, array(child, parent) FROM {{edges}} UNION ALL
            SELECT w.term_id, e.parent, concat(w.path, array(e.parent)) FROM walk w JOIN {{edges}} e ON w.at = e.child)
            SELECT term_id, max_by(path, size(path)) AS path FROM walk GROUP BY term_id""",
    )
    return paths.unionByName(edges.sparkSession.range(1).select(F.lit(root).alias("term_id"), F.array(F.lit(root)).alias("path")))


def reflexive(terms: DataFrame, closure_rows: DataFrame) -> DataFrame:
    own = terms.select("term_id", F.col("term_id").alias("ancestor"), F.lit(0).alias("dist"))
    return closure_rows.select("term_id", "ancestor", "dist").unionByName(own)


def _small(rows: DataFrame) -> DataFrame:
    """Rows of the graph, broadcast unless they are too many."""
    return F.broadcast(rows) if rows.count() <= SMALL_ROWS else rows


def propagated(profiles: DataFrame, reflexive_rows: DataFrame) -> DataFrame:
    """entity, ancestor: each entity once for every term that it or a descendant is annotated with.

    Up to ``SMALL_ROWS`` pairs of the graph are broadcast, so that profiles stay where their entities are; a shuffle by
    term would give a frequent term's profiles to one task."""
    return profiles.join(_small(reflexive_rows), "term_id").select("entity", "ancestor").distinct()


def information_content(terms: DataFrame, profiles: DataFrame, reflexive_rows: DataFrame, root: str) -> DataFrame:
    """term_id, count, freq, ic. The denominator is the entities with a known term; unknown terms don't count.

    freq of the root is 1 and its ic 0; a term that nothing carries has freq 0 and no ic."""
    seen = propagated(profiles, reflexive_rows)
    total = profiles.join(_small(terms.select("term_id").distinct()), "term_id", "left_semi").select("entity").distinct().agg(F.count("*").alias("n"))
    counts = seen.groupBy(F.col("ancestor").alias("term_id")).agg(F.count("*").alias("count"))
    t = terms.select("term_id").join(counts, "term_id", "left").crossJoin(F.broadcast(total))  # one row
    count = F.coalesce("count", F.lit(0))
    is_root = F.col("term_id") == root
    freq = F.when(is_root, 1.0).otherwise(count / F.col("n"))
    ic = F.when(is_root, 0.0).when(count > 0, -F.log(count / F.col("n")) + 0.0)
    return t.select("term_id", count.cast("bigint").alias("count"), freq.alias("freq"), ic.alias("ic"))


def checked_total(profiles: DataFrame, terms: DataFrame) -> int:
    n = profiles.join(terms, "term_id", "left_semi").select("entity").distinct().count()
    if not n:
        raise ValueError("no entity carries a term of the ontology")
    return n


def propagation_counters(profiles: DataFrame, terms: DataFrame, obsolete: DataFrame | None = None) -> DataFrame:
    """One row: annotations, those of terms that are not in the graph (obsolete ones are counted apart as well), and entities without any term of it.

    profiles: (entity, term_id); obsolete: (term_id)."""
    known = terms.select("term_id", F.lit(True).alias("known"))
    p = profiles.select("entity", "term_id").distinct().join(known, "term_id", "left")
    gone = (obsolete.select("term_id").distinct() if obsolete is not None else terms.select("term_id").limit(0)).withColumn("gone", F.lit(True))
    per = p.join(gone, "term_id", "left").groupBy("entity").agg(F.count("*").alias("n"), F.count("known").alias("k"), F.count("gone").alias("g"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per.agg(total(F.col("n")).alias("annotations"), total(F.col("n") - F.col("k")).alias("skipped"), total("g").alias("obsolete"), total((F.col("k") == 0).cast("bigint")).alias("entities_without_terms"))


def top_terms(terms: DataFrame, by: str, limit: int) -> DataFrame:
    """The first terms by a value, larger ids first among equals, missing values as -1."""
    return terms.orderBy(F.coalesce(by, F.lit(-1)).desc(), F.desc("term_id")).limit(limit)


def direct_frequency(profiles: DataFrame) -> DataFrame:
    """min, median, mean, max of the number of entities that carry a term directly; zeros when empty."""
    f = profiles.distinct().groupBy("term_id").agg(F.count("*").alias("n"))
    zero = lambda c, v: F.coalesce(c, F.lit(v))
    return f.agg(zero(F.min("n"), 0).alias("least"), zero(F.median("n"), 0.0).alias("median"), zero(F.avg("n"), 0.0).alias("mean"), zero(F.max("n"), 0).alias("most"))


def namespace_stats(annotations: DataFrame, low: tuple[str, ...] = ("ND", "NAS")) -> DataFrame:
    """namespace -> entities with any annotation, and with one of good evidence."""
    good = ~F.col("evidence").isin(*low)
    per = annotations.groupBy("namespace", "entity").agg(F.max(good.cast("int")).alias("good"))
    return per.groupBy("namespace").agg(F.count("*").alias("any_entities"), F.sum("good").alias("good_entities"))


def report(terms: DataFrame, edges: DataFrame, depths: DataFrame, ics: DataFrame) -> DataFrame:
    """One row: terms, edges, roots, greatest depth, terms with and without ic."""
    roots = terms.join(edges, terms["term_id"] == edges["child"], "left_anti").agg(F.count("*").alias("roots"))
    a = terms.agg(F.count("*").alias("terms"))
    b = edges.agg(F.count("*").alias("edges"))
    c = depths.agg(F.max("depth").alias("max_depth"))
    d = ics.agg(F.count("ic").alias("with_ic"), F.sum(F.col("ic").isNull().cast("bigint")).alias("without_ic"))
    return a.crossJoin(b).crossJoin(roots).crossJoin(c).crossJoin(d)  # one row each
