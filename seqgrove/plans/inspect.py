"""Diagnostic queries: filters of small tables, collected and formatted on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrove.functions import tree
from seqgrove.functions.describe import Description, describe
from seqgrove.functions.text import kind, number, odds, parse_term_set
from seqgrove.operators import ontology, similarity
from seqgrove.plans import library as lib
from seqgrove.plans.build import edges_of, graph_of, reflexive_of
from seqgrove.sources.flatfiles import ROOT


def _line(r) -> str:
    return f"{r['term_id']} {r['name']} (IC={number(r['ic'])}, freq={number(r['freq'])}, depth={r['depth']})"


def _dict(r) -> dict:
    return {k: v for k, v in r.asDict(recursive=True).items() if k not in ("parents", "children", "ancestors")}


def summary_of(terms: DataFrame, limit: int = 10) -> dict:
    """The summary's values."""
    tops = {f"top_by_{by}": [_dict(x) for x in ontology.top_terms(terms, by, limit).collect()] for by in ("count", "ic")}
    return ontology.report(terms, edges_of(terms), terms, terms).first().asDict() | tops


def term_of(terms: DataFrame, term_id: str, ancestors: bool = False) -> dict:
    """A term's values, with its ancestors' where they are asked for."""
    r = terms.where(F.col("term_id") == term_id).first()
    if r is None:
        raise KeyError(f"unknown term {term_id}")
    out = r.asDict(recursive=True)
    if ancestors:
        out["ancestor_terms"] = [_dict(x) for x in terms.where(F.col("term_id").isin(r["ancestors"])).orderBy("depth", "term_id").collect()]
    return out


def summary(terms: DataFrame, limit: int = 10) -> str:
    """Counts and the most frequent and most specific terms."""
    r = ontology.report(terms, edges_of(terms), terms, terms).first().asDict()
    out = [f"{k}: {number(v)}" for k, v in r.items()]
    for by in ("count", "ic"):
        out += ["", f"Top terms by {by}:"] + [f"- {_line(x)}" for x in ontology.top_terms(terms, by, limit).collect()]
    return "\n".join(out)


def term(terms: DataFrame, term_id: str, ancestors: bool = False) -> str:
    r = terms.where(F.col("term_id") == term_id).first()
    if r is None:
        raise KeyError(f"unknown term {term_id}")
    out = [_line(r), f"parents: {';'.join(r['parents']) or 'none'}", f"children: {';'.join(r['children']) or 'none'}"]
    if r["semantic_role"]:
        out.append(f"role: {r['semantic_role']['role']} (priority {r['semantic_role']['priority']}, {r['semantic_role']['source']})")
    if ancestors:
        out += ["ancestors:"] + [f"- {_line(x)}" for x in terms.where(F.col("term_id").isin(r["ancestors"])).orderBy("depth", "term_id").collect()]
    return "\n".join(out)


def similarity_of(spark: SparkSession, terms: DataFrame, a: str, b: str) -> dict:
    """Lin score of two terms with its reason, ancestor and inputs."""
    pair = spark.createDataFrame([(a, b)], "t1 string, t2 string")
    r = similarity.lin(pair, reflexive_of(terms), terms.select("term_id", "ic")).first()
    rows = {x["term_id"]: x for x in terms.where(F.col("term_id").isin([a, b, r["mica"]])).collect()}
    return {"a": a, "b": b, "similarity": r["lin"], "status": "ok" if r["reason"] is None else "unavailable", "reason": r["reason"], "mica": r["mica"], "rows": rows}


def similarity_text(terms: DataFrame, s: dict, style: str = "unicode") -> str:
    rows, a, b, mica = s["rows"], s["a"], s["b"], s["mica"]
    ic = lambda t: number(rows[t]["ic"]) if t in rows else "NA"
    out = [f"Score: {number(s['similarity'])}", f"Status: {s['status']}"] + ([f"Reason: {s['reason']}"] if s["reason"] else [])
    out += ["", "Input terms:"] + [f"- {n}: {_line(rows[t]) if t in rows else t}" for n, t in (("A", a), ("B", b))]
    out += ["", "Common ancestors:"]
    above = lambda t: set(rows[t]["ancestors"]) | {t} if t in rows else set()
    shared = above(a) & above(b)
    common = terms.where(F.col("term_id").isin(list(shared))).orderBy("depth", "term_id").collect() if shared else []
    out += [f"- {_line(r)}" for r in common] or ["- none"]
    out += ["", "Compact GO path:"]
    if mica:
        parts = terms.where(F.col("term_id").isin(list(above(a) | above(b)))).collect()
        parents, names = {r["term_id"]: r["parents"] for r in parts}, {r["term_id"]: r["name"] for r in parts}
        down = lambda t: tree.path_from_root(parents, t, mica)[1:]
        top = tree.path_from_root(parents, mica, ROOT)
        paths = list(dict.fromkeys(tuple(top + down(t)) for t in (a, b)))
        mark = lambda t: "".join(f" [{m}]" for m, on in (("A", t == a), ("B", t == b), ("MICA", t == mica), ("common", t in shared and t not in (a, b, mica))) if on)
        out += tree.render([list(p) for p in paths], lambda t: f"{t} {names[t]}{mark(t)}", style)
    else:
        out.append("- none")
    pad = " " * len("Formula: Lin(A, B)")
    out += ["", f"MICA: {_line(rows[mica]) if mica in rows else 'none'}", "Formula: Lin(A, B) = 2 * IC(MICA) / (IC(A) + IC(B))", f"{pad} = 2 * {ic(mica)} / ({ic(a)} + {ic(b)}) ", f"{pad} = {number(s['similarity'])}"]
    return "\n".join(out)


def resolve_terms(query: str, profiles: DataFrame, meta: DataFrame | None = None) -> tuple[str, ...]:
    """Terms of a set expression, an accession's profile or a cluster's signature."""
    k = kind(query)
    if k == "set":
        return parse_term_set(query)
    if k == "cluster" and meta is not None:
        r = meta.where(F.col("cluster_id") == query).select(F.col("composed_go").alias("t")).first()
    else:
        r = profiles.where(F.col("entity") == query).select(F.col("term_ids").alias("t")).first()
    if r is None:
        raise KeyError(f"unknown {k} {query}")
    return tuple(r["t"])


def set_similarity_of(spark: SparkSession, terms: DataFrame, profiles: DataFrame, a: str, b: str, meta: DataFrame | None = None) -> dict:
    """Best-match average of two sets with all best matches, and terms that don't count."""
    ta, tb = resolve_terms(a, profiles, meta), resolve_terms(b, profiles, meta)
    ok = {r["term_id"]: r["name"] for r in terms.where(F.col("term_id").isin([*ta, *tb]) & F.col("ic").isNotNull()).select("term_id", "name").collect()}
    va, vb = [t for t in ta if t in ok], [t for t in tb if t in ok]
    out = {"query_a": a, "query_b": b, "terms_a": ta, "terms_b": tb, "missing_a": [t for t in ta if t not in ok], "missing_b": [t for t in tb if t not in ok], "names": ok, "valid_a": va, "valid_b": vb, "matches": {1: [], 2: []}, "similarity": None, "reason": None}
    if not va or not vb:
        return out | {"reason": "empty_cleaned_set"}
    pairs = spark.createDataFrame([(x, y) for x in va for y in vb] + [(y, x) for x in va for y in vb if x != y], "t1 string, t2 string").distinct()
    scores = similarity.lin(pairs, reflexive_of(terms), terms.select("term_id", "ic"))
    sets = spark.createDataFrame([("A", t) for t in va] + [("B", t) for t in vb], "entity string, term_id string")
    one = spark.createDataFrame([("A", "B")], "a string, b string")
    order = {t: i for i, t in enumerate([*va, *vb])}
    for r in similarity.best_match_details(one, sets, scores).collect():
        out["matches"][r["side"]].append((r["source"], r["target"], r["score"]))
    for m in out["matches"].values():
        m.sort(key=lambda x: order[x[0]])
    means = [sum(x[2] for x in m) / len(m) if m else None for m in out["matches"].values()]
    out["means"] = means
    if None in means:
        return out | {"reason": "no_scored_pairs"}
    return out | {"similarity": sum(means) / 2}


def set_similarity_text(s: dict) -> str:
    asked = lambda n, q, t: f"{n} query: {q}" + ("" if kind(q) == "set" else f" ({';'.join(t)})")
    out = [f"Score: {number(s['similarity'])}", f"Status: {'ok' if s['reason'] is None else 'unavailable'}"] + ([f"Reason: {s['reason']}"] if s["reason"] else [])
    out += ["", asked("A", s["query_a"], s["terms_a"]), asked("B", s["query_b"], s["terms_b"])]
    out += [f"Ignored missing {n} terms: {';'.join(s[k])}" for n, k in (("A", "missing_a"), ("B", "missing_b")) if s[k]]
    seen = dict.fromkeys([("A", t) for t in s["valid_a"]] + [("B", t) for t in s["valid_b"] if t not in s["valid_a"]])
    out += ["", "GO term descriptions:"] + ([f"- {n}: {t} {s['names'][t]}" for n, t in seen] or ["- none"])
    means = s.get("means") or [None, None]
    for (x, y), side, mean in ((("A", "B"), 1, means[0]), (("B", "A"), 2, means[1])):
        out += ["", f"{x} -> {y} best matches:"] + ([f"- {a} --{v:.4f}--> {b}" for a, b, v in s["matches"][side]] or ["- none"]) + [f"{x} -> {y} average max: {number(mean)}"]
    pad = " " * 19
    out += ["", "Formula: AMB(A, B) = (mean(A -> B) + mean(B -> A)) / 2", f"{pad}= ({number(means[0])} + {number(means[1])}) / 2", f"{pad}= {number(s['similarity'])}"]
    return "\n".join(out)


def function_of(terms: DataFrame, query: str, ids: tuple[str, ...], max_modifiers: int = 3) -> Description:
    """The sentence about a set; only its terms are collected."""
    return describe(query, ids, graph_of(terms.where(F.col("term_id").isin(list(ids)))), max_modifiers)


def cluster_of(spark: SparkSession, folder: str, cluster_id: str) -> dict:
    """Meta row and all weights of a cluster, heaviest first, with motif descriptions and odds."""
    meta = lib.load(spark, folder, "clusters_meta").where(F.col("cluster_id") == cluster_id).first()
    if meta is None:
        raise KeyError(f"unknown cluster {cluster_id}")
    names = lib.load(spark, folder, "motifs").select(F.col("name").alias("motif_id"), F.col("description").alias("motif_description"))
    rows = lib.load(spark, folder, "scoreboard").where(F.col("cluster_id") == cluster_id).join(names, "motif_id", "left").orderBy(F.desc("weight"), "motif_id").collect()
    told = meta["description"] or function_of(lib.load(spark, folder, "terms"), cluster_id, tuple(meta["composed_go"])).summary
    return {"cluster_id": cluster_id, "size": meta["size"], "composed_go": meta["composed_go"], "description": told, "motifs": [{"motif_id": r["motif_id"], "description": r["motif_description"] or "", "tp": r["tp"], "fp": r["fp"], "fn": r["fn"], "tn": r["tn"], "odds_ratio": odds(r["tp"], r["fp"], r["fn"], r["tn"]), "weight": r["weight"]} for r in rows]}


def cluster_text(c: dict) -> str:
    out = [f"{'Cluster ID:':<17}{c['cluster_id']}", f"{'Cluster Size:':<17}{c['size']}", f"{'Composed GO:':<17}{';'.join(c['composed_go']) or 'NA'}", f"{'Description:':<17}{c['description']}", "", "Motif Hits:"]
    for i, m in enumerate(c["motifs"], 1):
        out += [f"{i}. {m['motif_id']}", f"   {m['description']}", f"   {'':<16}{'In cluster':>12}{'Outside':>12}", f"   {'Motif present':<16}{m['tp']:>12}{m['fp']:>12}", f"   {'Motif absent':<16}{m['fn']:>12}{m['tn']:>12}", f"   {'Odds ratio:':<13}{m['odds_ratio']}", f"   {'Weight:':<13}{number(m['weight'])}"]
    return "\n".join(out if c["motifs"] else [*out, "- none"])
