"""Operator 13: token counts of whole texts under a piece model, each distinct pre-token tokenised once.

A model with byte fallback merges characters only into pieces of its vocabulary. So no merge crosses a place where no
piece could lie: before a run of spaces (the model's word marks) that follows another character, and on both sides of a
character that no piece of several characters holds (digits, line feeds, most ideographs). Texts get the model's
leading space and are cut at these places; the pre-tokens' counts then sum to the whole text's, exactly.

1. One pass counts distinct pre-tokens in each task; they meet by hash and each is tokenised once: the table of pieces.
2. The most frequent pre-tokens, as many as ``Settings.held_bytes`` holds, go to every task. The threshold comes from a
   histogram of the table by powers of two, so the broadcast has a fixed bound at every size of the input.
3. A second pass takes each document's pre-token frequencies, sums those that are held, and sends the others by
   hash to the table of pieces. The table's most frequent keys are held, so no key of that join is hot.

Ids are never made for a document; long pre-tokens travel as 16-byte digests.

Defined cases: null text is the empty text and has no tokens; repeated rows and null ids have a row each; a text of
any length is counted whole; an empty table gives no rows; further columns are not read, whatever their names. Models
without byte fallback, with pieces that span a space after another character, or whose normaliser changes characters raise ValueError.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from hashlib import blake2b
from itertools import islice
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, kept, lean, materialise, utf8

MARK = "▁"
#: Characters that normalisers change, merge or drop.
CHANGED = "ｆ①ﬁ\u00a0\u3000\u200be\u0301\r\t\x00A가\u1100\u1161Å"


@dataclass(frozen=True)
class Settings:
    #: Bytes of keys and counts that every task holds.
    held_bytes: int = 12 << 20
    #: Distinct pre-tokens (and bytes of them) that a task gathers before it hands them on.
    lot: int = 200_000
    lot_bytes: int = 32 << 20
    #: Characters of a text that are cut at a time.
    slice_chars: int = 1 << 20


class PieceModel:
    """The library's model, its pre-tokens and their numbers of pieces."""

    def __init__(self, proto: bytes):
        from sentencepiece import SentencePieceProcessor

        self.sp = sp = SentencePieceProcessor(model_proto=proto)
        ids = range(sp.vocab_size())
        pieces = [sp.id_to_piece(i) for i in ids if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        joined = {c for p in pieces if len(p) > 1 for c in p} - {MARK}
        lone = next((c for c in "\n\t\x0b\x01" if c not in joined), None)
        plain = f" {''.join(sorted(joined))}  {CHANGED} {lone} "
        if lone is None or sp.normalize(plain) != MARK + plain.replace(" ", MARK) or not any(sp.is_byte(i) for i in ids) or any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("the model's pieces can't be counted apart at spaces")
        inside, space = "".join(map(re.escape, sorted(joined))), f"[ {MARK}]"
        self.cut = re.compile(f"{space}*[{inside}]+|{space}+|[^{inside} {MARK}]", re.DOTALL)
        self.lone, self.base = lone, len(sp.encode(lone))

    def pretokens(self, text: str, size: int):
        """The pre-tokens of a whole text in lists: one, or several of a very long text."""
        text = text and " " + text
        if len(text) <= size:
            yield self.cut.findall(text)
            return
        at = self.cut.finditer(text)
        while more := [m.group() for m in islice(at, size >> 3)]:
            yield more

    def pieces(self, pretokens: list[str]) -> list[int]:
        return [len(x) - self.base for x in self.sp.encode([self.lone + p for p in pretokens], num_threads=1)]


def key_of(pretoken: bytes) -> bytes:
    """The pre-token, or a digest where it is long; no UTF-8 text starts with the digest's first byte."""
    return pretoken if len(pretoken) <= 32 else b"\xff" + blake2b(pretoken, digest_size=16).digest()


def _model(proto) -> PieceModel:
    return kept(__name__ + ".model", proto, lambda: PieceModel(proto.value))


def _texts(batches):
    for b in batches:
        for i in range(b.num_rows):
            yield b, i, b.column("text")[i].as_py().decode("utf-8", "replace")


def _distinct(proto, s: Settings):
    def run(batches):
        model, found, size = _model(proto), Counter(), 0

        def table():
            return pa.RecordBatch.from_pydict({"pretoken": pa.array([p.encode() for p in found], pa.large_binary()).cast(pa.binary()), "n": pa.array(list(found.values()), pa.int64())})

        for _, _, text in _texts(batches):
            if size and (len(found) > s.lot or size > s.lot_bytes):
                yield table()
                found, size = Counter(), 0
            for lot in model.pretokens(text, s.slice_chars):
                found.update(lot)
            size += len(text)
        if found:
            yield table()

    return run


def _pieces(proto):
    def run(batches):
        model = _model(proto)
        for b in batches:
            ps = b.column("pretoken").to_pylist()
            yield pa.RecordBatch.from_pydict({"key": [key_of(p) for p in ps], "n": b.column("n"), "pieces": pa.array(model.pieces([p.decode() for p in ps]), pa.int64())})

    return run


def _sums(proto, held, s: Settings):
    def run(batches):
        model = _model(proto)
        known = kept(__name__, held, lambda: {k if k[:1] == b"\xff" else k.decode(): n for k, n in zip(*held.value)})
        for b in batches:
            sums, keys, counts = [], [], []
            for t in b.column("text"):
                total, rest, ns = 0, [], []
                freq = Counter()
                for lot in model.pretokens(t.as_py().decode("utf-8", "replace"), s.slice_chars):
                    freq.update(lot)
                for p, n in freq.items():
                    m = known.get(p)
                    if m is None:
                        k = key_of(p.encode())
                        m = known.get(k) if k[0] == 0xFF else None
                    if m is None:
                        rest.append(k)
                        ns.append(n)
                    else:
                        total += m * n
                sums.append(total)
                keys.append(rest)
                counts.append(ns)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "n_bytes": b.column("n_bytes"), "known": pa.array(sums, pa.int64()), "keys": pa.array(keys, pa.list_(pa.binary())), "counts": pa.array(counts, pa.list_(pa.int64()))})

    return run


def piece_table(docs: DataFrame, proto, settings: Settings = Settings(), *, text_col: str = "text") -> DataFrame:
    """(key, n, pieces): each distinct pre-token of all texts once, how often it comes and its number of pieces."""
    spans = docs.select(utf8(F.col(text_col)).alias("text")).mapInArrow(lean(_distinct(proto, settings)), "pretoken binary, n bigint")
    once = spans.groupBy("pretoken").agg(F.sum("n").alias("n"))
    return once.mapInArrow(lean(_pieces(proto)), "key binary, n bigint, pieces bigint")


def _held(table: DataFrame, settings: Settings) -> tuple[int, tuple[list, list]]:
    """The least power of two whose pre-tokens fit, and these with their pieces."""
    level = F.floor(F.log2("n")).cast("int")
    sizes = {r["level"]: r["size"] for r in table.groupBy(level.alias("level")).agg(F.sum(F.length("key") + 16).alias("size")).collect()}
    least, total = 64, 0
    for at in sorted(sizes, reverse=True):
        total += sizes[at]
        if total > settings.held_bytes:
            break
        least = at
    t = table.where(level >= least).select("key", "pieces").toArrow()
    return 0 if least == min(sizes, default=0) else least, (t.column("key").to_pylist(), t.column("pieces").to_pylist())


def token_counts(docs: DataFrame, model_path: str, settings: Settings = Settings(), *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row: bytes of the text in UTF-8 and tokens under the model."""
    spark = docs.sparkSession
    bounded_batches(spark)
    proto = spark.sparkContext.broadcast(Path(model_path).read_bytes())
    table = materialise(piece_table(docs, proto, settings, text_col=text_col), "pieces")
    least, found = _held(table, settings)
    held = spark.sparkContext.broadcast(found)
    rows = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("text")).withColumn("n_bytes", F.length("text").cast("bigint"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_bytes bigint, known bigint, keys array<binary>, counts array<bigint>"
    sums = rows.mapInArrow(lean(_sums(proto, held, settings)), schema)
    if not least:  # every pre-token is held
        return sums.select(F.col("id").alias(id_col), "n_bytes", F.col("known").alias("n_tokens"))
    sums = materialise(sums.withColumn("row", F.monotonically_increasing_id()), "known-tokens")
    rest = sums.select("row", F.explode(F.arrays_zip("keys", "counts")).alias("x")).select("row", F.col("x.keys").alias("key"), F.col("x.counts").alias("count"))
    more = rest.join(table.where(F.floor(F.log2("n")) < least).select("key", "pieces"), "key").groupBy("row").agg(F.sum(F.col("count") * F.col("pieces")).alias("more"))
    return sums.join(more, "row", "left").select(F.col("id").alias(id_col), "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens"))
