"""Building a library: ontology and profiles, communities, clusters, motif hits, score board, calibration.

Each stage reads tables and writes one, and is skipped while its table is fresh."""

from __future__ import annotations

import datetime
import json
import logging
import os
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrove.functions import motif_lang
from seqgrove.functions.describe import Term, describe_column
from seqgrove.operators import community, linkage, motif_scan, neighbors, ontology, roles, scoreboard, signature, similarity
from seqgrove.operators.numbering import numbered
from seqgrove.plans import library as lib
from seqgrove.session import ship
from seqgrove.sources import config, flatfiles, tables
from seqgrove.storage import materialise


LOG = logging.getLogger("seqgrove")


@dataclass(frozen=True)
class BuildConfig:
    obo: str
    knowledge_base: str
    prosite: str
    out: str
    role_map: str | None = None
    min_cluster_similarity: float = 0.25
    graph: neighbors.GraphConfig = field(default_factory=neighbors.GraphConfig)
    board: scoreboard.BoardConfig = field(default_factory=scoreboard.BoardConfig)
    force: bool = False
    #: What is written besides the library: file names by what they hold (``EXPORTS``).
    exports: dict = field(default_factory=dict)
    scan_partitions: int = 0

    def __post_init__(self):
        if not 0 < self.min_cluster_similarity <= 1:
            raise ValueError("min_cluster_similarity lies in (0, 1]")
        if self.scan_partitions < 0:
            raise ValueError("scan_partitions must not be negative")
        if odd := set(self.exports) - set(EXPORTS):
            raise ValueError(f"unknown exports: {', '.join(sorted(odd))}")


#: Kinds of files that a build can write: tables as one text file each, terms as JSON, the report as text. Fixed values.
EXPORTS = ("report", "go_json", "profiles", "excluded", "fasta", "motifs", "communities", "clusters", "clusters_meta", "motif_hits", "scoreboard", "scoreboard_meta", "stats")


def translated(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(motifs, failures) of PROSITE pattern entries: what can't be translated is told, with the reason.

    A library has a few thousand entries, which a pandas function translates one by one."""
    import pandas as pd
    from pyspark.sql.functions import pandas_udf

    def told(patterns: pd.Series) -> pd.DataFrame:
        def one(p):
            try:
                return motif_lang.translate(p), None
            except ValueError as e:
                return None, str(e)

        return pd.DataFrame([one(p) for p in patterns], columns=["pattern", "error"])

    told.__annotations__ = {"patterns": pd.Series, "return": pd.DataFrame}
    ship(entries.sparkSession)
    e = entries.where("kind = 'PATTERN' and pattern <> ''").withColumnRenamed("pattern", "prosite_pattern").withColumn("t", pandas_udf(told, "pattern string, error string")("prosite_pattern"))
    good = e.where("t.error is null").select("ord", "name", "ac", "description", "prosite_pattern", "t.pattern", F.lit("translated").alias("status"))
    return good, e.where("t.error is not null").select("name", "prosite_pattern", "t.error")


def term_table(terms: DataFrame, edges: DataFrame, up: DataFrame, ics: DataFrame, semantic: DataFrame | None) -> DataFrame:
    """term_id, name, depth, count, freq, ic, parents, children, ancestors, role struct."""
    arrays = lambda d, key, value, name: d.groupBy(F.col(key).alias("term_id")).agg(F.sort_array(F.collect_set(value)).alias(name))
    t = terms.join(ics, "term_id").join(arrays(edges, "child", "parent", "parents"), "term_id", "left").join(arrays(edges, "parent", "child", "children"), "term_id", "left").join(arrays(up, "term_id", "ancestor", "ancestors"), "term_id", "left")
    none = F.array().cast("array<string>")
    t = t.select("term_id", "name", "depth", "count", "freq", "ic", *[F.coalesce(c, none).alias(c) for c in ("parents", "children", "ancestors")])
    kind = "struct<role:string,priority:int,source:string,matched:string>"
    if semantic is None:
        return t.withColumn("semantic_role", F.lit(None).cast(kind))
    s = semantic.select("term_id", F.struct("role", F.col("priority").cast("int").alias("priority"), "source", "matched").alias("semantic_role"))
    return t.join(s, "term_id", "left")


def graph_of(terms: DataFrame) -> dict[str, Term]:
    """The ontology for driver-side composition: tens of thousands of terms."""
    out = {}
    for r in terms.collect():
        s = r["semantic_role"]
        out[r["term_id"]] = Term(r["term_id"], r["name"], frozenset(r["ancestors"]), r["ic"], r["depth"], s["role"] if s else None, s["priority"] if s else None)
    return out


def edges_of(terms: DataFrame) -> DataFrame:
    return terms.select(F.col("term_id").alias("child"), F.explode("parents").alias("parent"))


def reflexive_of(terms: DataFrame) -> DataFrame:
    return terms.select("term_id", F.explode(F.concat("ancestors", F.array("term_id"))).alias("ancestor"), F.lit(0).alias("dist"))


def build(spark: SparkSession, cfg: BuildConfig) -> dict[str, bool]:
    """Runs the stages; returns which of them were rebuilt."""
    at = lambda name: os.path.join(cfg.out, name)
    made: dict[str, bool] = {}

    def stage(name: str, needs: list[str], params: dict, run) -> DataFrame:
        made[name] = lib.is_stale(at(name), needs, cfg.force, params)
        if made[name]:
            lib.save(run(), cfg.out, name)
            lib.write_params(at(name), params)
        return lib.load(spark, cfg.out, name)

    os.makedirs(cfg.out, exist_ok=True)
    records = stage("records", [cfg.knowledge_base], {"source": lib.fingerprint(cfg.knowledge_base)}, lambda: flatfiles.read_knowledge_base(spark, cfg.knowledge_base))
    notes = stage("annotations", [at("records")], {}, lambda: flatfiles.annotations(records))
    sequences = stage("sequences", [at("records")], {}, lambda: flatfiles.sequences(records))
    profiles = stage("profiles", [at("annotations")], {}, lambda: tables.profiles_of(notes))
    stage("excluded", [at("annotations")], {}, lambda: tables.excluded(notes))

    def make_terms():
        kept, edges = flatfiles.project(flatfiles.read_obo(spark, cfg.obo))
        up = ontology.closure(edges)
        own = ontology.reflexive(kept, up)
        rows = tables.profile_rows(profiles).select("entity", "term_id")
        ontology.checked_total(rows, kept)
        ics = ontology.information_content(kept, rows, own, flatfiles.ROOT)
        semantic = None
        if cfg.role_map:
            anchors, words = config.role_tables(spark, config.role_map(config.read(cfg.role_map)))
            semantic = roles.semantic_roles(kept, own, ics, anchors, words, flatfiles.ROOT)
        return term_table(kept, edges, up, ics, semantic)

    terms = stage("terms", [cfg.obo, at("profiles"), *([cfg.role_map] if cfg.role_map else [])], {}, make_terms)

    entries = flatfiles.read_prosite(spark, cfg.prosite)
    motifs = stage("motifs", [cfg.prosite], {}, lambda: numbered(translated(entries)[0].withColumnRenamed("ord", "place"), "ord", "place").drop("place"))
    failed = stage("motif_failures", [cfg.prosite], {}, lambda: translated(entries)[1])
    if made["motif_failures"]:
        for r in failed.limit(20).collect():
            LOG.warning("no translation of %s (%s): %s", r["name"], r["prosite_pattern"], r["error"])

    own, ics, rows = reflexive_of(terms), terms.select("term_id", "ic"), tables.profile_rows(profiles).select("entity", "term_id")
    lin = stage("term_scores", [at("terms")], {}, lambda: similarity.both_orders(similarity.term_matrix(similarity.lin(candidate_term_pairs(rows, ics), own, ics))))
    edges = stage("graph", [at("term_scores"), at("profiles")], asdict(cfg.graph), lambda: neighbors.knn_edges(rows, own, ics, lin, cfg.graph))
    leiden = stage("communities", [at("graph")], asdict(cfg.graph), lambda: community.communities(edges, cfg.graph.resolution))

    def inside(groups: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """Members with their profiles, and scores of the different pairs of profiles in a group."""
        of, sets = neighbors.grouped(neighbors.valid_profiles(rows, ics))
        placed = linkage.placed(groups, of, column)
        scored = similarity.set_similarity(linkage.profile_pairs(placed, column), sets.withColumnRenamed("profile", "entity"), lin)
        return placed, materialise(scored.select("a", "b", "amb"), "profile-scores")

    clusters = stage("clusters", [at("communities")], {"min_similarity": cfg.min_cluster_similarity}, lambda: community.stable_ids(linkage.refine_profiles(*inside(leiden, "community"), cfg.min_cluster_similarity)))

    def make_meta():
        voted = signature.votes(clusters, rows, own, ics)
        up = terms.select("term_id", F.explode("ancestors").alias("ancestor"))
        meta = linkage.profile_similarity(*inside(clusters, "cluster_id")).join(signature.composed(signature.signatures(voted, up)), "cluster_id", "left")
        meta = meta.withColumn("composed_go", F.coalesce("composed_go", F.array().cast("array<string>")))
        return meta.withColumn("description", describe_column(spark.sparkContext.broadcast(graph_of(terms)))("cluster_id", "composed_go"))

    stage("clusters_meta", [at("clusters"), at("terms")], {}, make_meta)
    listed = [(r["name"], r["pattern"]) for r in motifs.orderBy("ord").collect()]  # a few thousand
    seqs = motif_scan.member_sequences(clusters, sequences).select(F.col("entity").alias("accession"), "sequence")
    found = seqs.where("sequence is not null")
    if cfg.scan_partitions:
        found = found.repartition(cfg.scan_partitions)
    hits = stage("motif_hits", [at("clusters"), at("sequences"), at("motifs")], {}, lambda: motif_scan.scan(found, listed))

    # always rebuilt, as it is cheap
    good = scoreboard.clean_hits(hits, clusters)
    rated = scoreboard.weighted(scoreboard.contingency(good, clusters, cfg.board), cfg.board)
    lib.save(scoreboard.weights(rated), cfg.out, "scoreboard")
    board = lib.load(spark, cfg.out, "scoreboard")
    lib.save(scoreboard.calibration(good, clusters, board, cfg.board), cfg.out, "calibration")
    totals = scoreboard.counters(good, clusters, rated, hits, cfg.board).first().asDict()
    meta = {"created_at": datetime.datetime.now(datetime.timezone.utc).isoformat(), "parameters": asdict(cfg.board), "formula": "log2(((TP+0.5)/(size+1))/((FP+0.5)/(N-size+1)))", "totals": totals}
    with open(at("scoreboard_meta.json"), "w", encoding="utf-8") as f:
        json.dump(meta, f, indent=2, sort_keys=True, default=str)
    made["scoreboard"] = True

    def stats() -> dict:
        """What was read, left out, translated, clustered and scanned."""
        row = lambda d: d.first().asDict()
        graph_rows = neighbors.valid_profiles(rows, ics).select("entity").distinct()
        obsolete = flatfiles.read_obo(spark, cfg.obo).where("obsolete").select("term_id")
        clustered, given = clusters.count(), graph_rows.count()
        lone = graph_rows.join(clusters.select("entity"), "entity", "left_anti").count()
        if clustered + lone != given:
            raise RuntimeError(f"{given} entities are not {clustered} clustered and {lone} without neighbours")
        gone, some = motif_scan.missing(seqs.withColumnRenamed("accession", "entity"))
        if gone:
            LOG.warning("%d members have no sequence: %s", gone, ", ".join(some))
        told = {"annotations": row(ontology.propagation_counters(rows, terms, obsolete)), "evidence": {r["namespace"]: [r["any_entities"], r["good_entities"]] for r in ontology.namespace_stats(notes).collect()}}
        told |= {"direct_frequency": row(ontology.direct_frequency(rows)), "sequences": row(flatfiles.sequence_counts(sequences)), "motifs": row(flatfiles.prosite_counts(entries)) | {"failed": failed.count()}}
        told |= {"clustering": {"entities": given, "clustered": clustered, "without_neighbours": lone, "edges": edges.count()} | row(linkage.refine_stats(leiden, clusters.withColumnRenamed("cluster_id", "community"))) | row(linkage.size_stats(clusters))}
        return told | {"members_without_sequence": gone, "totals": totals}

    # files are made anew in the order of the library
    if cfg.exports:
        place = motifs.select(F.col("name").alias("motif_id"), "ord")
        tables_of = {
            "profiles": lambda: profiles.select("entity", F.array_join("term_ids", ";").alias("terms")).orderBy("entity"), "excluded": lambda: lib.load(spark, cfg.out, "excluded").orderBy("entity", "term_id"),
            "motifs": lambda: motifs.orderBy("ord").select("name", F.col("ac").alias("prosite_ac"), "description", "prosite_pattern", F.col("pattern").alias("motif_pattern"), "status"),
            "communities": lambda: leiden.select(F.col("entity").alias("member_id"), F.col("community").alias("cluster_id")).orderBy("member_id"), "clusters": lambda: clusters.select(F.col("entity").alias("member_id"), "cluster_id").orderBy("member_id"),
            "clusters_meta": lambda: lib.load(spark, cfg.out, "clusters_meta").orderBy("cluster_id"), "scoreboard": lambda: board.orderBy("motif_id", "cluster_id"),
            "motif_hits": lambda: hits.join(place, "motif_id").join(clusters.withColumnRenamed("entity", "accession"), "accession").orderBy("accession", "ord").select("accession", "motif_id"),
        }
        for name, path in cfg.exports.items():
            if name in tables_of:
                export_file(tables_of[name](), path, header=name != "profiles", trailer="# completed\ttrue" if name == "motif_hits" else None)
            elif name == "fasta":
                export_lines(flatfiles.to_fasta(sequences.orderBy("accession")), path)
            elif name == "go_json":
                export_lines(terms.orderBy("term_id").select(F.to_json(F.struct(*terms.columns)).alias("value")), path)
            elif name == "report":
                from seqgrove.plans.inspect import summary

                _write(path, summary(terms, 20) + "\n")
            else:
                _write(path, json.dumps(stats() if name == "stats" else meta, indent=2, sort_keys=True, default=str))
    return made


def _write(path: str, text: str) -> None:
    """By way of another name, so that a broken run leaves nothing that looks whole."""
    with open(path + ".part", "w", encoding="utf-8") as f:
        f.write(text)
    os.replace(path + ".part", path)


def export_lines(values: DataFrame, path: str, first: str | None = None, last: str | None = None) -> None:
    """The ``value`` column in its order as one local file, streamed through the driver."""
    with open(path + ".part", "w", encoding="utf-8") as f:
        for line in [first] if first else []:
            f.write(line + "\n")
        for r in values.toLocalIterator():
            f.write(r["value"] + "\n")
        if last:
            f.write(last + "\n")
    os.replace(path + ".part", path)


def export_file(t: DataFrame, path: str, header: bool = True, trailer: str | None = None) -> None:
    """A table as one tab-separated file: arrays joined by ';', similarities with five digits, NA for null."""
    flat = [F.array_join(c, ";") if k.startswith("array<string") else F.coalesce(F.format_string("%7.5f", c), F.lit("NA")) if c.startswith("sim_") else F.coalesce(F.col(c).cast("string"), F.lit("")) for c, k in t.dtypes]
    export_lines(t.select(F.concat_ws("\t", *flat).alias("value")), path, "\t".join(t.columns) if header else None, trailer)


def candidate_term_pairs(rows: DataFrame, ics: DataFrame) -> DataFrame:
    """Pairs t1 <= t2 of the terms that valid profiles hold: what set similarity can ask for, in one order."""
    used = neighbors.valid_profiles(rows, ics).select("term_id").distinct()
    return similarity.all_term_pairs(used).where("t1 <= t2")


def export_tsv(spark: SparkSession, folder: str, name: str, target: str) -> None:
    """A table as one tab-separated file, arrays joined by ';'."""
    t = lib.load(spark, folder, name)
    flat = [F.array_join(c, ";").alias(c) if k.startswith("array<string") else F.col(c).cast("string").alias(c) for c, k in t.dtypes]
    t.select(*flat).coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", "true").csv(target)
