"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are folded (small letters; every run of other characters is one space). An item of m
characters may differ by k = ``rate`` * m edits. Of k + 1 disjoint pieces of the item at least one survives
k edits unchanged, so an Aho-Corasick scan for all pieces finds every candidate place; the q-gram lemma
discards most false ones and Myers' bit-parallel distance decides on the rest.

The test set is a stated query set: it is scanned against all documents in blocks of ``block_chars``, each
broadcast, so its size has a bound at any scale. Documents are read once a block and are not shuffled.

Defined cases: null or empty text matches nothing; items that are null or fold to
nothing are left out; items shorter than ``least`` folded characters match exactly and at word boundaries only; equal items are reported each;
repeated documents are reported each; an empty table on either side gives no match.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept, lean

_other = re.compile(r"[\W_]+")


def fold(text: str) -> str:
    return _other.sub(" ", text.lower()).strip()


def folded_spans(text: str) -> tuple[str, list[int]]:
    """The folded text and, for each of its characters, the offset in ``text``."""
    out: list[str] = []
    at: list[int] = []
    for i, c in enumerate(text):
        for x in c.lower():
            if _other.match(x):
                if out and out[-1] != " ":
                    out.append(" ")
                    at.append(i)
            else:
                out.append(x)
                at.append(i)
    if out and out[-1] == " ":
        out.pop()
        at.pop()
    return "".join(out), at


def masks(pattern: str) -> dict[str, int]:
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    return peq


def myers(peq: dict[str, int], m: int, text: str, anchored: bool = False) -> tuple[int, int]:
    """(distance, end): the least edit distance of the pattern to a part of ``text``, and where it first ends.

    anchored: the part begins at the start of the text."""
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, end = m, 0
    for j, c in enumerate(text, 1):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = (ph << 1) | anchored
        pv = ((mh << 1) & full) | (full & ~(xv | ph))
        mv = ph & xv & full
        if score < best:
            best, end = score, j
    return best, end


@dataclass(frozen=True)
class Settings:
    rate: float = 0.08
    least: int = 24
    piece: int = 8
    q: int = 4
    block_chars: int = 4_000_000


def budget(m: int, cfg: Settings) -> int:
    """Allowed edits: ``rate`` of the length, as long as pieces keep ``piece`` characters."""
    return max(0, min(int(cfg.rate * m), m // cfg.piece - 1))


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """k + 1 disjoint (offset, piece) of nearly equal length that cover the item."""
    cut = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cut, cut[1:])]


#: Letters of scripts without spaces between words (Thai to Myanmar, Khmer, kana, Han): a word may begin or end beside them.
_unspaced = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")


def bounded(text: str, start: int, end: int) -> bool:
    """Whether a part of a folded text begins and ends at word boundaries."""
    return all(i in (0, len(text)) or " " in text[i - 1 : i + 1] or bool(_unspaced.search(text[i - 1 : i + 1])) for i in (start, end))


class Matcher:
    def __init__(self, items: list[tuple[int, str]], cfg: Settings):
        import ahocorasick

        by_text: dict[str, list[int]] = {}
        for i, t in items:
            by_text.setdefault(t, []).append(i)
        self.texts, self.ids, self.cfg = list(by_text), list(by_text.values()), cfg
        self.k = [budget(len(t), cfg) if len(t) >= cfg.least else 0 for t in self.texts]
        self.peq = [masks(t) for t in self.texts]
        self.back = [masks(t[::-1]) for t in self.texts]
        self.grams = [Counter(t[i : i + cfg.q] for i in range(len(t) - cfg.q + 1)) for t in self.texts]
        where: dict[str, list[tuple[int, int]]] = {}
        for n, t in enumerate(self.texts):
            for at, p in pieces(t, self.k[n]):
                where.setdefault(p, []).append((n, at))
        self.scan = ahocorasick.Automaton()
        for p, w in where.items():
            self.scan.add_word(p, (len(p), w))
        if where:
            self.scan.make_automaton()
        self.empty = not where

    def _near(self, n: int, window: str) -> bool:
        """q-gram lemma: k edits destroy at most k * q of the item's q-grams."""
        q, own = self.cfg.q, self.grams[n]
        need = len(self.texts[n]) - q + 1 - self.k[n] * q
        if need <= 0:
            return True
        left, got = dict(own), 0
        for i in range(len(window) - q + 1):
            g = window[i : i + q]
            if left.get(g, 0):
                left[g] -= 1
                got += 1
                if got >= need:
                    return True
        return False

    def find(self, text: str, first: bool = False) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best place of each item in the folded text.

        first: stop at the first item that matches."""
        if self.empty:
            return []
        tried: dict[int, set[int]] = {}
        best: dict[int, tuple[int, int, int]] = {}
        for end, (size, where) in self.scan.iter(text):
            for n, at in where:
                k, m = self.k[n], len(self.texts[n])
                start = end - size + 1 - at
                if m < self.cfg.least:
                    if n not in best and bounded(text, start, start + m):
                        best[n] = (0, start, start + m)
                        if first:
                            return [(self.ids[n][0], *best[n])]
                    continue
                # a place is tried once for all pieces that agree on it within k
                lot = start // (k + 1)
                done = tried.setdefault(n, set())
                if lot in done or best.get(n, (1,))[0] == 0:
                    continue
                done.add(lot)
                lo = max(0, lot * (k + 1) - k)
                window = text[lo : lot * (k + 1) + k + m + k + 1]
                if not self._near(n, window):
                    continue
                d, e = myers(self.peq[n], m, window)
                if d <= k and d < best.get(n, (k + 1,))[0]:
                    _, size_back = myers(self.back[n], m, window[:e][::-1], True)
                    best[n] = (d, lo + e - size_back, lo + e)
                    if first:
                        return [(self.ids[n][0], *best[n])]
        return [(i, *b) for n, b in best.items() for i in self.ids[n]]


def _matcher(items) -> Matcher:
    return kept(__name__, items, lambda: Matcher(*items.value))


MATCH = "doc_id bigint, item_id bigint, distance int, allowed int, start int, end int"


def _matches(items):
    def run(batches):
        m = _matcher(items)
        allowed = {i: k for ids, k in zip(m.ids, m.k) for i in ids}
        for b in batches:
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                found = m.find(fold(text)) if text else []
                if found:
                    at = folded_spans(text)[1]
                    rows += [(doc, i, d, allowed[i], at[s], at[e - 1] + 1) for i, d, s, e in found]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "distance", "allowed", "start", "end"])

    return run


def item_blocks(benchmark: DataFrame, cfg: Settings) -> list:
    """The test items, folded on the driver block by block, as broadcasts of bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    total = items.agg(F.coalesce(F.sum(F.length("text").cast("bigint")), F.lit(0)).alias("n")).first()["n"]
    n = max(1, -(-total // cfg.block_chars))
    out = []
    for k in range(n):
        some = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == k).collect()
        folded = [(r["item_id"], f) for r in some if (f := fold(r["text"]))]
        if folded:
            out.append(spark.sparkContext.broadcast((sorted(folded), cfg)))
    return out


def contaminated(docs: DataFrame, benchmark: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """A row for each document and test item that it holds: edits, edits allowed, span in the text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    found = [src.mapInArrow(lean(_matches(b)), MATCH) for b in item_blocks(benchmark, cfg)]
    if not found:
        return spark.createDataFrame([], MATCH)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def _clean(items):
    def run(batches):
        m = _matcher(items)
        for b in batches:
            ok = [not (t and m.find(fold(t), first=True)) for t in b.column("text").to_pylist()]
            yield b.filter(pa.array(ok, pa.bool_()))

    return run


def clean_documents(docs: DataFrame, benchmark: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """The documents that hold no test item, all columns, without a shuffle."""
    bounded_batches(docs.sparkSession)
    for b in item_blocks(benchmark, cfg):
        docs = docs.mapInArrow(lean(_clean(b)), docs.schema)
    return docs
