"""The point query: sequences against a library, to function sets with calibrated confidence."""

from __future__ import annotations

import json
import textwrap

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrove.functions.text import number
from seqgrove.operators import motif_scan, predict
from seqgrove.plans import library as lib
from seqgrove.sources import flatfiles


def queries(spark: SparkSession, seq: str | None = None, fasta: str | None = None) -> DataFrame:
    """accession, sequence: exactly one of a sequence and a FASTA file."""
    if (seq is None) == (fasta is None):
        raise ValueError("give either a sequence or a FASTA file")
    if seq is not None:
        return spark.createDataFrame([("sequence", "".join(seq.split()).upper(), 0)], "accession string, sequence string, ord int")
    q = flatfiles.read_fasta(spark, fasta).withColumnRenamed("query", "accession")
    if not q.take(1):
        raise ValueError(f"{fasta} holds no sequences")
    return q


#: The calibration's columns, for libraries that have none: predictions then come without confidence.
CALIBRATION = "threshold double, set_accuracy double, top1_accuracy double, top3_accuracy double, coverage double"


def scan(spark: SparkSession, seqs: DataFrame, folder: str, min_weight: float = 2.0, top_n: int = 5) -> tuple[DataFrame, DataFrame]:
    """(hits, predictions) of all queries; predictions carry confidence and the motif's pattern as signature."""
    motifs = lib.load(spark, folder, "motifs")
    listed = [(r["name"], r["pattern"]) for r in motifs.orderBy("ord").select("name", "pattern").collect()]
    hits = motif_scan.scan(seqs.select("accession", "sequence"), listed)
    place = motifs.select(F.col("name").alias("motif_id"), F.col("ord").cast("int").alias("ordinal"), F.col("pattern").alias("signature"))
    p = predict.cluster_predictions(hits.join(place.drop("signature"), "motif_id"), lib.load(spark, folder, "scoreboard"), min_weight)
    sets = predict.function_sets(p, lib.load(spark, folder, "clusters_meta"), top_n)
    sets = sets.join(place.drop("ordinal"), "motif_id", "left")
    points = lib.load(spark, folder, "calibration") if lib.has(folder, "calibration") else spark.createDataFrame([], CALIBRATION)
    return hits, predict.confidence(sets, points)


def payload(spark: SparkSession, seqs: DataFrame, folder: str, source: str, min_weight: float = 2.0, top_n: int = 5) -> dict:
    """All results as one document, queries in their order."""
    hits, found = scan(spark, seqs, folder, min_weight, top_n)
    matched = {r["accession"]: r["n"] for r in hits.groupBy("accession").agg(F.count("*").alias("n")).collect()}
    sets: dict[str, list] = {}
    for r in found.orderBy("query", "rank").collect():
        c = r["confidence"]
        sets.setdefault(r["query"], []).append({"cluster_ids": r["cluster_ids"], "go_terms": [t for t in r["terms"] if t.startswith("GO:")], "description": r["description"], "weight": r["weight"], "motif_id": r["motif_id"], "signature": r["signature"], "calibrated_confidence": c.asDict() if c else None, "name": ";".join(r["terms"])})
    ids = [r["accession"] for r in seqs.orderBy("ord").select("accession").collect()]
    return {"library": {"source": source, "path": folder}, "min_weight": min_weight, "top_n": top_n, "queries": [{"query": i, "matched_motifs": matched.get(i, 0), "inferred_go_sets": sets.get(i, [])} for i in ids]}


def as_text(result: dict) -> str:
    wide = lambda name, value: textwrap.fill(str(value), 79, initial_indent=f"   {name + ':':<16}", subsequent_indent=" " * 19)
    n = f"top {result['top_n']}" if result["top_n"] else "all"
    out = [f"{'Library:':<15}{result['library']['source']}"]
    for q in result["queries"]:
        out += ["", f"{'Query:':<16}{q['query']}", f"{'Matched motifs:':<16}{q['matched_motifs']}", f"Inferred GO sets ({n}, weight >= {number(result['min_weight'])}):"]
        if not q["inferred_go_sets"]:
            out.append("- none")
        for i, s in enumerate(q["inferred_go_sets"], 1):
            c = s["calibrated_confidence"]
            sure = f"{number(c['set_accuracy'])} (set_acc @ >= {number(c['threshold'])})" if c else "NA"
            out += [f"{i}. {s['name']}", wide("Signature", s["signature"]), wide("Clusters", ", ".join(s["cluster_ids"])), wide("Description", s["description"]), wide("GO terms", ";".join(s["go_terms"]) or "NA"), wide("Weight", number(s["weight"])), wide("Confidence", sure)]
    return "\n".join(out)


def as_json(result: dict) -> str:
    return json.dumps(result, indent=2)
