"""Command line: build-library, scan, inspect, setup-data, version."""

from __future__ import annotations

import argparse
import json
import logging
import sys
from dataclasses import asdict, replace

from seqgrove import __version__
from seqgrove.plans.build import EXPORTS


#: Options of the panel command: name, kind, default. Fixed values.
PANEL = (("clusters", int, 4), ("members", int, 5), ("candidates", int, 200), ("low", float, 0.5), ("high", float, 0.8), ("most_identity", float, 0.9), ("attempts", int, 1000), ("pool", int, 20), ("seed", int, 1))


def _session(level: str = "ERROR"):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("seqgrove").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel({"WARNING": "WARN", "CRITICAL": "FATAL"}.get(level.upper(), level.upper()))
    return spark


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("seqgrove")
    p.add_argument("--log-level", default="WARNING")
    sub = p.add_subparsers(dest="command", required=True)
    q = sub.add_parser("panel")
    q.add_argument("--library-dir", required=True)
    q.add_argument("--out", required=True)
    for name, kind, value in PANEL:
        q.add_argument(f"--{name.replace('_', '-')}", type=kind, default=value)
    sub.add_parser("version")
    b = sub.add_parser("build-library")
    for name in ("obo", "knowledge-base", "prosite", "out"):
        b.add_argument(f"--{name}", required=True)
    b.add_argument("--role-map")
    b.add_argument("--cluster-config")
    b.add_argument("--min-cluster-similarity", type=float, default=0.25)
    b.add_argument("--min-cluster-size", type=int, default=10)
    b.add_argument("--min-support", type=int, default=5)
    b.add_argument("--package-dir")
    b.add_argument("--package", action="store_true", help="into the package's own library")
    b.add_argument("--motif-scan-processes", type=int, default=0, help="partitions of the motif scan; 0: as Spark deals them")
    for name in EXPORTS:
        b.add_argument(f"--{name.replace('_', '-')}-out", help="a file to write besides the library")
    b.add_argument("--force", action="store_true")
    s = sub.add_parser("scan")
    s.add_argument("--seq")
    s.add_argument("--fasta")
    s.add_argument("--library-dir")
    s.add_argument("--min-weight", type=float, default=2.0)
    s.add_argument("--top-n", type=int, default=5)
    s.add_argument("--json-out")
    i = sub.add_parser("inspect").add_subparsers(dest="what", required=True)
    for name, args in (("go-summary", ()), ("go-term", ("term",)), ("go-sim", ("a", "b")), ("go-set-sim", ("a", "b")), ("function", ("query",)), ("cluster", ("query",))):
        q = i.add_parser(name, description="Quote GO set expressions: they hold parentheses and semicolons.")
        for a in args:
            q.add_argument(a)
        q.add_argument("--library-dir")
        q.add_argument("--json", action="store_true")
        q.add_argument("-v", "--verbose", action="store_true")
        q.add_argument("--ancestors", action="store_true")
        q.add_argument("--tree-style", choices=("unicode", "ascii"), default="unicode")
        q.add_argument("--max-modifiers", type=int, default=3)
    d = sub.add_parser("setup-data")
    d.add_argument("--folder", required=True)
    d.add_argument("--source", action="append", default=[], metavar="NAME=URL")
    d.add_argument("--threads", type=int, default=16)
    d.add_argument("--force", action="store_true")
    d.add_argument("--dry-run", action="store_true")
    return p


def _inspect(args) -> str:
    from seqgrove.functions.text import number
    from seqgrove.plans import inspect as I
    from seqgrove.plans import library as lib

    spark = _session(args.log_level)
    folder, _ = lib.resolve(args.library_dir)
    terms = lib.load(spark, folder, "terms")
    if args.what == "go-summary":
        return json.dumps(I.summary_of(terms), indent=2) if args.json else I.summary(terms)
    if args.what == "go-term":
        return json.dumps(I.term_of(terms, args.term, args.ancestors), indent=2) if args.json else I.term(terms, args.term, args.ancestors)
    if args.what == "cluster":
        c = I.cluster_of(spark, folder, args.query)
        return json.dumps(c, indent=2) if args.json else I.cluster_text(c)
    if args.what == "go-sim":
        s = I.similarity_of(spark, terms, args.a, args.b)
        if args.json:
            return json.dumps({k: v for k, v in s.items() if k != "rows"}, indent=2)
        return I.similarity_text(terms, s, args.tree_style) if args.verbose else number(s["similarity"])
    profiles, meta = lib.load(spark, folder, "profiles"), lib.load(spark, folder, "clusters_meta")
    if args.what == "go-set-sim":
        s = I.set_similarity_of(spark, terms, profiles, args.a, args.b, meta)
        return json.dumps(s, indent=2) if args.json else I.set_similarity_text(s) if args.verbose else number(s["similarity"])
    d = I.function_of(terms, args.query, I.resolve_terms(args.query, profiles, meta), args.max_modifiers)
    return json.dumps(asdict(d), indent=2) if args.json else d.summary


def run(argv: list[str]) -> str:
    args = parser().parse_args(argv)
    logging.basicConfig(level=args.log_level.upper())
    if args.command == "panel":
        from seqgrove.plans import panel as P

        return P.run(_session(args.log_level), args.library_dir, args.out, P.PanelConfig(**{n: getattr(args, n) for n, *_ in PANEL}))
    if args.command == "version":
        return __version__
    if args.command == "inspect":
        return _inspect(args)
    if args.command == "setup-data":
        from seqgrove.sources.download import setup

        names = setup(dict(s.split("=", 1) for s in args.source), args.folder, args.force, args.dry_run, args.threads)
        return "\n".join(names)
    if args.command == "scan":
        from seqgrove.plans import library as lib
        from seqgrove.plans import scan as S

        if args.top_n < 0:
            raise ValueError("top-n must not be negative")
        folder, source = lib.resolve(args.library_dir, need=lib.SCAN)
        spark = _session(args.log_level)
        result = S.payload(spark, S.queries(spark, args.seq, args.fasta), folder, source, args.min_weight, args.top_n)
        if args.json_out:
            with open(args.json_out, "w", encoding="utf-8") as f:
                f.write(S.as_json(result))
            return ""
        return S.as_text(result)
    from seqgrove.operators.scoreboard import BoardConfig
    from seqgrove.plans.build import BuildConfig, build
    from seqgrove.plans.library import package, packaged_dir
    from seqgrove.sources import config

    cfg = BuildConfig(args.obo, args.knowledge_base, args.prosite, args.out, args.role_map, args.min_cluster_similarity, board=BoardConfig(args.min_cluster_size, args.min_support), force=args.force, exports={n: getattr(args, f"{n}_out") for n in EXPORTS if getattr(args, f"{n}_out")}, scan_partitions=args.motif_scan_processes)
    if args.cluster_config:
        cfg = replace(cfg, graph=config.graph_config(config.read(args.cluster_config)))
    made = build(_session(args.log_level), cfg)
    if args.package_dir or args.package:
        package(args.out, args.package_dir or packaged_dir())
    return "\n".join(f"{k}: {'built' if v else 'fresh'}" for k, v in made.items())


def main() -> None:
    try:
        text = run(sys.argv[1:])
    except (ValueError, KeyError, FileNotFoundError) as e:
        sys.exit(f"error: {e}")
    if text:
        print(text)


if __name__ == "__main__":
    main()
