"""Scanning sequences for motifs. sequences: (accession, sequence); motifs: (ordinal, name, pattern) on the driver."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqgrove.functions import motif_lang as ml
from seqgrove.session import ship

#: Up to so many motifs are tested by expressions of one projection, more by compiled patterns in Arrow batches.
MANY = 64


def presence(sequence: Column, pattern: str) -> Column:
    """Whether the motif occurs: the cheap literal first, then a regular expression of the whole sequence."""
    test = (sequence != "") & sequence.rlike(ml.presence_regex(pattern))
    lit = ml.literal(pattern)
    return F.coalesce(sequence.contains(lit) & test if lit else test, F.lit(False))


def scan(sequences: DataFrame, motifs: list[tuple[str, str]], many: int = MANY) -> DataFrame:
    """accession, motif_id: one row for each motif that occurs in a sequence; no row otherwise.

    motifs: (name, pattern). A sequence is read once for all motifs and nothing is shuffled. Of many motifs only those whose literal an automaton
    of all literals finds, and those without one, are tried."""
    if not motifs:
        return sequences.select("accession", F.lit("").alias("motif_id")).limit(0)
    for name, pattern in motifs:
        ml.parse(pattern)
    if len(motifs) <= many:
        s = F.col("sequence")
        hits = F.array_compact(F.array(*[F.when(presence(s, p), F.lit(name)) for name, p in motifs]))
        return sequences.select("accession", F.explode(hits).alias("motif_id"))
    ship(sequences.sparkSession)

    def run(batches):
        of, free, words = [(name, ml.compiled(p), p) for name, p in motifs], [], {}
        for i, (_, p) in enumerate(motifs):
            if lit := ml.literal(p):
                words.setdefault(lit, []).append(i)
            else:
                free.append(i)
        at = _automaton(words)
        for b in batches:
            acc, ids = [], []
            for a, seq in zip(b.column("accession").to_pylist(), b.column("sequence").to_pylist()):
                if not seq:
                    continue
                may = free + [i for lit in {lit for _, lit in at.iter(seq)} for i in words[lit]] if at else free
                for i in sorted(may):
                    name, regex, p = of[i]
                    if _found(regex, p, seq):
                        acc.append(a)
                        ids.append(name)
            yield pa.RecordBatch.from_pydict({"accession": pa.array(acc, pa.string()), "motif_id": pa.array(ids, pa.string())})

    return sequences.select(F.col("accession").cast("string").alias("accession"), "sequence").mapInArrow(run, "accession string, motif_id string")


def _automaton(words):
    """All literals in one pass of a sequence, however many there are."""
    import ahocorasick

    at = ahocorasick.Automaton()
    for w in words:
        at.add_word(w, w)
    at.make_automaton()
    return at if words else None


def _found(regex, pattern: str, seq: str) -> bool:
    if not ml.ends_at_terminus(pattern):
        m = regex.search(seq)
        return m is not None and m.start() < len(seq)
    low, high = ml.widths(pattern)
    return any(regex.match(seq, i) for i in range(max(0, len(seq) - high), len(seq) - low + 1))


def matches(sequences: DataFrame, motifs: list[tuple[str, str]]) -> DataFrame:
    """accession, motif_id, start_n, end_n: the shortest match at every start, overlaps included."""
    ship(sequences.sparkSession)

    def run(batches):
        tests = [(name, ml.compiled(p)) for name, p in motifs]
        for b in batches:
            rows = [(a, name, s, e) for a, seq in zip(b.column("accession").to_pylist(), b.column("sequence").to_pylist()) if seq for name, p in tests for s, e in ml.matches(seq, p)]
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["accession", "motif_id", "start_n", "end_n"])

    return sequences.select(F.col("accession").cast("string").alias("accession"), "sequence").mapInArrow(run, "accession string, motif_id string, start_n int, end_n int")


def features(sequences: DataFrame, motifs: list[tuple[str, str]]) -> DataFrame:
    """accession, motif_id, count, first_position, last_position, fraction of every sequence and motif.

    count: starts that match; last_position: the last of them from the other end; fraction: null if empty.
    Look-ahead makes overlapping starts countable by built-in functions."""
    s = F.col("sequence")
    per = []
    for name, p in motifs:
        body = ml.regex(p)
        count = F.regexp_count(s, F.lit(f"(?=[A-Z])(?={body})"))
        first = F.length(F.regexp_extract(s, f"\\A([A-Z]*?)(?=[A-Z])(?={body})", 1)) + 1
        before_last = F.length(F.regexp_extract(s, f"\\A([A-Z]*)(?=[A-Z])(?={body})", 1))
        any_ = (s != "") & (count > 0)
        fraction = F.when(s == "", F.lit(None).cast("double")).otherwise(count / F.length(s))
        per.append(F.struct(F.lit(name).alias("motif_id"), F.when(any_, count).otherwise(0).alias("count"), F.when(any_, first).otherwise(0).alias("first_position"), F.when(any_, F.length(s) - before_last).otherwise(0).alias("last_position"), fraction.alias("fraction")))
    return sequences.select("accession", F.explode(F.array(*per)).alias("f")).select("accession", "f.*")


def member_sequences(members: DataFrame, sequences: DataFrame) -> DataFrame:
    """(entity, sequence) of all members; a missing sequence is null."""
    return members.select("entity").distinct().join(sequences.select(F.col("accession").alias("entity"), "sequence"), "entity", "left")


def missing(member_seqs: DataFrame, preview: int = 20) -> tuple[int, list[str]]:
    """Number of members without a sequence, and the first ids."""
    gone = member_seqs.where("sequence is null").select("entity")
    return gone.count(), [r["entity"] for r in gone.orderBy("entity").limit(preview).collect()]
