"""Scanning a stream of sequences: stateless, so every micro-batch is the batch operator."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seqgrove.operators import motif_scan


def scan_stream(sequences: DataFrame, motifs: list[tuple[str, str]]) -> DataFrame:
    """sequences: a streaming (accession, sequence); the hits as a streaming DataFrame for any sink."""
    return motif_scan.scan(sequences, motifs)
