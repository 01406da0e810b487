"""Operator 11: source divergence audit. How far the words of each source of a language are from its other sources'.

A language keeps the terms that at least ``Settings.least`` of its documents hold. Every group (language, source) gives
each kept term a smoothed share p in whole parts of ``Settings.scale``; (p - q)^2 / q in whole numbers tells its distance
from another source's share (part ``pair``, summed over all kept terms) or from the language's (part ``term``).

1. Each task fills a count-min sketch of document frequencies: two rows of cells, counts stop at ``least``. Sketches are
   merged block by block; a cell needs one bit then ("may reach ``least``"), so what goes to every task has a fixed size.
   The merged sketch never underestimates: a term that it rejects is in fewer documents.
2. A second pass counts (language, source, term) in each task, and sends only terms that the sketch lets through.
   They meet by hash of (language, term), are counted exactly, and those of too few documents go.
3. Pairs of sources meet term by term only where both have the term. All others have the share of a count of zero,
   so their part of the sum comes from each group's histogram of counts: with z for the share at zero,
   sum f(p, q) = V f(z, z) + sum over p's terms (f(p, z) - f(z, z)) + sum over q's terms (f(z, q) - f(z, z))
   + sum over common terms (f(p, q) - f(p, z) - f(z, q) + f(z, z)).

Numbers stay whole: 64 bits, 38 decimal digits where products or sums are larger.

Defined cases: null text, lang and source are ''; repeated rows are documents of their own; a group without
terms or kept terms has its pairs; a language of one source has no pairs; equal values are ranked by the item's UTF-8 bytes; texts of any
length are read whole; an empty table gives no rows; further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, distinct, lean, materialise, mix, shuffle_parts, utf8, word_hashes

#: Terms are runs of ASCII letters and bytes above them.
TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
APART = np.ones(256, bool)
APART[[*range(65, 91), *range(97, 123), *range(128, 256)]] = False

ROWS = 2
BLOCK = 1 << 16


@dataclass(frozen=True)
class Settings:
    #: Documents of a language that a kept term is in, at least (1 to 85, so that two merged cells fit a byte).
    least: int = 3
    #: Whole parts of a share, what is added to each count, and terms told of a group.
    scale: int = 10**9
    added: int = 1
    top: int = 200
    #: Cells of a row of the sketch, as a power of two.
    sketch_bits: int = 23
    #: Different terms that a task gathers before it hands them on.
    lot: int = 300_000


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return (mix(h + np.uint64(0x51ED270B * (row + 1))) >> np.uint64(64 - bits)).astype(np.int64)


def _of_lang(h: np.ndarray, lang: bytes) -> np.ndarray:
    return mix(h ^ np.uint64(zlib.crc32(lang) << 20 ^ len(lang)))


def _sketches(s: Settings):
    """Each task's sketch of its documents, in compressed blocks of cells."""

    def run(batches):
        cells = np.zeros((ROWS, 1 << s.sketch_bits), np.uint8)
        waiting, n = [], 0

        def fill():
            h = np.concatenate(waiting)
            for row in range(ROWS):
                at, times = np.unique(_cells(h, row, s.sketch_bits), return_counts=True)
                cells[row, at] = np.minimum(cells[row, at] + np.minimum(times, s.least), s.least)

        for b in batches:
            hashes, counts = word_hashes(b.column("text").to_pylist(), apart=APART)
            for lang, h in zip(b.column("lang").to_pylist(), np.split(hashes, np.cumsum(counts)[:-1])):
                waiting.append(_of_lang(distinct(h), lang))
                n += len(h)
            if n > 1 << 20:
                fill()
                waiting, n = [], 0
        if waiting:
            fill()
        blocks = cells.reshape(-1, min(BLOCK, 1 << s.sketch_bits))
        for i in np.flatnonzero(blocks.any(axis=1)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "cells": pa.array([zlib.compress(blocks[i].tobytes(), 1)], pa.binary())})

    return run


def _merged(s: Settings):
    """One bit a cell: whether the sum over all tasks reaches ``least``. A task adds up its own blocks as they come."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for block, packed in zip(b.column("block").to_pylist(), b.column("cells")):
                cells = np.frombuffer(zlib.decompress(packed.as_py()), np.uint8)
                sums[block] = np.minimum(sums[block] + cells, s.least) if block in sums else cells
        for block, cells in sums.items():
            yield pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "bits": pa.array([np.packbits(cells >= s.least).tobytes()], pa.binary())})

    return run


def sketch(docs: DataFrame, settings: Settings = Settings()) -> np.ndarray:
    """The merged sketch of ``docs`` (lang, text as bytes): a bit for each cell of each row."""
    parts = docs.select("lang", "text").mapInArrow(lean(_sketches(settings)), "block int, cells binary")
    size = min(BLOCK, 1 << settings.sketch_bits)
    bits = np.zeros((ROWS << settings.sketch_bits) // size * size // 8, np.uint8).reshape(-1, size // 8)
    # as many rows as the sketch has blocks, whatever the input
    for r in parts.repartition(shuffle_parts(docs.sparkSession), "block").mapInArrow(lean(_merged(settings)), "block int, bits binary").collect():
        bits[r["block"]] = np.frombuffer(r["bits"], np.uint8)
    return bits.reshape(ROWS, -1)


def may_reach(bits: np.ndarray, lang: bytes, terms: list[bytes], settings: Settings = Settings()) -> np.ndarray:
    """For each term whether ``least`` documents of the language may hold it: never False for one that they do."""
    h = _of_lang(word_hashes([b"\n".join(terms[a : a + 4096]) for a in range(0, len(terms), 4096)], apart=APART)[0], lang)
    found = np.ones(len(h), bool)
    for row in range(ROWS):
        at = _cells(h, row, settings.sketch_bits)
        found &= (bits[row][at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
    return found


def _counted(bits, s: Settings):
    def run(batches):
        uses: dict[tuple, Counter] = defaultdict(Counter)
        holds: dict[tuple, Counter] = defaultdict(Counter)

        def tables():
            for (lang, source), n in uses.items():
                terms = list(n)
                keep = np.flatnonzero(may_reach(bits.value, lang, terms, s)) if terms else ()
                for a in range(0, len(keep), 1 << 15):
                    some = [terms[i] for i in keep[a : a + (1 << 15)]]
                    docs = holds[lang, source]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "lang": pa.array([lang] * len(some), pa.binary()),
                            "source": pa.array([source] * len(some), pa.binary()),
                            "term": pa.array(some, pa.binary()),
                            "n": pa.array([n[t] for t in some], pa.int64()),
                            "docs": pa.array([docs[t] for t in some], pa.int64()),
                        }
                    )

        for b in batches:
            for lang, source, text in zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("text").to_pylist()):
                terms = TERM.findall(text.lower())
                uses[lang, source].update(terms)
                holds[lang, source].update(set(terms))
            if sum(map(len, uses.values())) > s.lot:
                yield from tables()
                uses.clear()
                holds.clear()
        yield from tables()

    return run


def share(count: Column, total: Column, kept: Column, s: Settings) -> Column:
    """1 + floor(scale (count + added) / (total + added kept)); in 64 bits where they hold the products."""
    wide = lambda c: c.cast("decimal(28,0)")
    fits = (count <= F.lit(((1 << 63) - 1) // s.scale - s.added)) & (total <= F.lit(1 << 61)) & (kept <= F.lit((1 << 61) // max(1, s.added)))
    short = F.call_function("div", F.lit(s.scale).cast("bigint") * (count + s.added), total + kept * s.added)
    return F.when(fits, short).otherwise(F.call_function("div", F.lit(s.scale).cast("decimal(10,0)") * (wide(count) + s.added), wide(total) + wide(kept) * s.added)) + 1


def distance(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def halves(value: Column, name: str) -> tuple[Column, Column]:
    """The sum of whole numbers as those of their upper and lower 32 bits: ``joined`` is more than 64 bits hold."""
    return F.sum(F.shiftright(value, 32)).alias(f"{name}_upper"), F.sum(value.bitwiseAND(F.lit((1 << 32) - 1))).alias(f"{name}_lower")


def joined(name: str) -> Column:
    return F.col(f"{name}_upper").cast("decimal(28,0)") * F.lit(1 << 32).cast("decimal(10,0)") + F.col(f"{name}_lower").cast("decimal(38,0)")


def term_counts(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(lang, source, term, n, all_n): each kept term of a language in each source that has it, with its
    occurrences there and in the language. ``docs`` has lang, source and text as bytes."""
    spark = docs.sparkSession
    bits = spark.sparkContext.broadcast(sketch(docs, settings))
    rows = docs.select("lang", "source", "text").mapInArrow(lean(_counted(bits, settings)), "lang binary, source binary, term binary, n bigint, docs bigint")
    by_source = rows.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    lang_term = Window.partitionBy("lang", "term")
    all_of = by_source.withColumn("all_n", F.sum("n").over(lang_term)).withColumn("all_docs", F.sum("docs").over(lang_term))
    return all_of.where(F.col("all_docs") >= settings.least).drop("docs", "all_docs")


def divergence(docs: DataFrame, settings: Settings = Settings(), *, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank) of all groups."""
    s, spark = settings, docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(utf8(F.col(lang_col).cast("string")).alias("lang"), utf8(F.col(source_col).cast("string")).alias("source"), utf8(F.col(text_col)).alias("text"))
    terms = materialise(term_counts(docs, s), "divergence-terms")

    # a row a group, a row a language
    occurring = docs.select("lang", "source").distinct()
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    langs = terms.groupBy("lang", "term").agg(F.max("all_n").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count("*").alias("kept"))
    groups = occurring.join(totals, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    none = F.lit(0)
    groups = groups.withColumn("zero", F.when(F.col("kept") > 0, share(none, F.col("total"), F.col("kept"), s)))
    groups = materialise(groups, "divergence-groups")

    rated = terms.join(groups, ["lang", "source"]).select("lang", "source", "term", "n", "zero", share(F.col("n"), F.col("total"), F.col("kept"), s).alias("p"), share(F.col("all_n"), F.col("lang_total"), F.col("kept"), s).alias("q"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    told = rated.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance(F.col("p"), F.col("q")).alias("value"))
    told = told.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.top)

    # sums over the terms of one group, against each other group's share at zero
    alone = rated.groupBy("lang", "source", "p").agg(F.count("*").alias("times"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("zero").alias("other_zero"), F.col("kept"))
    pairs = groups.select("lang", "source", "zero").join(other, "lang").where("source <> item")
    wide = lambda c: c.cast("decimal(38,0)")
    p, z, o = F.col("p"), F.col("zero"), F.col("other_zero")
    base = distance(z, o)
    start = pairs.select("lang", "source", "item", wide(F.coalesce(F.when(F.col("kept") > 0, F.col("kept") * wide(base)), F.lit(0))).alias("value"))
    against = alone.join(pairs, ["lang", "source"])
    own = against.select("lang", "source", "item", wide(F.col("times") * wide(distance(p, o) - base)).alias("value"))
    # the same terms as the other side of the pair: q is theirs, p the share at zero
    others = against.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), wide(F.col("times") * wide(distance(o, p) - distance(o, z))).alias("value"))

    # terms that both have: a pair of sources once, both directions from it
    holders = rated.groupBy("lang", "term").agg(F.collect_list(F.struct("source", "p", "zero")).alias("xs")).where(F.size("xs") > 1)
    met = holders.select("lang", "xs", F.explode("xs").alias("a")).select("lang", "a", F.explode(F.filter("xs", lambda x: x["source"] > F.col("a.source"))).alias("b"))

    def common(x: str, y: str) -> Column:
        px, zx, py, zy = (F.col(c) for c in (f"{x}.p", f"{x}.zero", f"{y}.p", f"{y}.zero"))
        return distance(px, py) - distance(px, zy) - distance(zx, py) + distance(zx, zy)

    both = met.groupBy("lang", F.col("a.source").alias("a"), F.col("b.source").alias("b")).agg(*halves(common("a", "b"), "ab"), *halves(common("b", "a"), "ba"))
    both = both.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item"), wide(joined("ab")).alias("value")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"), wide(joined("ba")).alias("value")))).alias("x")).select("lang", "x.*")
    summed = start.unionByName(own).unionByName(others).unionByName(both).groupBy("lang", "source", "item").agg(F.sum("value").cast("bigint").alias("value"))
    paired = summed.select("lang", "source", F.lit("pair").alias("part"), "item", "value").withColumn("rank", F.row_number().over(order))
    return paired.unionByName(told).select(*(F.col(c).cast("string").alias(c) for c in ("lang", "source", "part", "item")), "value", "rank")
