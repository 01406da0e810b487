"""Token-ID output: frequency-ranked ids, byte-aligned lengths, separate control bytes.

File format, version 1. A data set is a folder of Parquet parts, one row per block of whole
documents; Spark's committer writes it, so lost executors and remote stores are no special case.
``ranks/`` holds the table rank -> id, most frequent id first. A block row has ``part`` and
``block`` (their order is the order of documents), ``start`` (ids before the block), ``doc_ids``,
``lengths`` (ids of each document), ``control`` and ``data``. Each id is stored as its rank in 1 to 4
little-endian bytes in ``data``; ``control`` has two bits an id (bytes - 1), four ids a byte, low bits
first. The decoder turns control bytes into lengths by a 256 x 4 table.

Defined cases: null text is the empty text and gets the end id only; an added token of the tokenizer inside a text is
that token, as the tokenizer has it; documents come in ascending doc_id order, null ids first, equal ids ordered by a hash of the text and
the text; repeated rows are written as often as they come; very long texts are encoded whole and make a block each; an empty table gives
an empty data set; further columns are not read, whatever their names.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, discard, fresh_path, kept, lean, materialise, mix, powers, shuffle_parts, slices

#: Lengths (1 to 4) of the four values that a control byte describes.
LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1

RAW = "part int, block int, doc_ids array<bigint>, lengths array<bigint>, ids binary, n bigint"
CODED = "part int, block int, start bigint, doc_ids array<bigint>, lengths array<bigint>, control binary, data binary"


def pack(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of non-negative values below 2**32."""
    r = np.ascontiguousarray(ranks, dtype="<u4")
    n = 1 + (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    keep = np.arange(4) < n[:, None]
    data = r.view(np.uint8).reshape(-1, 4)[keep]
    two = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    two[: len(r)] = n - 1
    two = two.reshape(-1, 4)
    return (two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6).astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values, by table lookup."""
    lens = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    d = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)]).astype(np.uint32)
    at = np.zeros(n, np.int64)
    np.cumsum(lens[:-1], out=at[1:])
    out = d[at]
    for k in (1, 2, 3):
        more = np.flatnonzero(lens > k)
        out[more] |= d[at[more] + k] << np.uint32(8 * k)
    return out


_odd = re.compile(r"\s(?=\s)|[^\S \n]")
_SPACE, _LINE, _END = 0x20, 0x0A, 0x00
_LETTER = np.zeros(256, bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
#: What stands before a piece: nothing, a space (part of its first token), a line feed, or a letter.
_LEADS = {0: "", 1: " ", 2: "\n", 3: ""}


class PieceEncoder:
    """Whole texts through the tokenizer as it is, each distinct piece once.

    A lone space or line feed between two other characters starts a pretoken of this family of byte-level
    tokenizers, and so does a point or comma between an ASCII letter and one of these. Texts are cut there.
    Pieces are known by 64-bit hashes in sorted arrays, with their ids in one pool; texts with other white
    space, and texts that hold an added token of the tokenizer, are encoded whole. At ``most`` pieces those that
    were met again since the last time stay and the rest are forgotten, which bounds memory and changes no result.
    """

    def __init__(self, spec: str, most: int = 4_000_000):
        from tokenizers import Tokenizer

        self.t = Tokenizer.from_str(spec)
        self.added = [x.content for x in self.t.get_added_tokens_decoder().values()]
        self.kind = np.uint16 if self.t.get_vocab_size(True) <= 1 << 16 else np.uint32
        self.most = most
        self._reset()

    def _reset(self) -> None:
        self.tables = [self._table(), self._table()]
        self.pool, self.used = np.zeros(1 << 16, self.kind), 0

    @staticmethod
    def _table() -> list[np.ndarray]:
        """keys, places in the pool, numbers of ids, met again or not"""
        return [np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint32), np.zeros(0, bool)]

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.t.encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    def _look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(known, offset in the pool, number of ids)"""
        known, at, n = np.zeros(len(keys), bool), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        for k, a, m, met in self.tables:
            if len(k):
                i = np.minimum(np.searchsorted(k, keys), len(k) - 1)
                hit = k[i] == keys
                known |= hit
                i = i[hit]
                at[hit], n[hit], met[i] = a[i], m[i], True
        return known, at, n

    def _forget(self) -> None:
        """Keep the pieces that were met again, unless they are most of all."""
        keys, at, n, met = (np.concatenate(x) for x in zip(*self.tables))
        keys, at, n = keys[met], at[met], n[met].astype(np.int64)
        if len(keys) * 2 > self.most:
            self._reset()
            return
        order = np.argsort(keys)
        keys, at, n = keys[order], at[order], n[order]
        upto = np.cumsum(n)
        self.pool = self.pool[np.repeat(at - (upto - n), n) + np.arange(int(n.sum()))]
        self.used = len(self.pool)
        self.tables = [[keys, (upto - n).astype(np.uint32), n.astype(np.uint32), np.zeros(len(keys), bool)], self._table()]

    def _learn(self, keys: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(offset in the pool, number of ids) of new pieces"""
        one, ids, lens = self.t.encode, [], []
        for p in pieces:
            x = one(p, add_special_tokens=False).ids
            ids += x
            lens.append(len(x))
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.zeros(max(len(ids), self.used), self.kind)])
        self.pool[self.used : self.used + len(ids)] = ids
        lens = np.array(lens, np.uint32)
        new = [keys, (self.used + np.cumsum(lens, dtype=np.int64) - lens).astype(np.uint32), lens, np.zeros(len(keys), bool)]
        told = new[1].astype(np.int64), lens.astype(np.int64)
        self.used += len(ids)
        for level in (1, 0):  # recent pieces are kept apart until they are a quarter of all
            both = [np.concatenate(x) for x in zip(self.tables[level], new)]
            order = np.argsort(both[0])
            new = [x[order] for x in both]
            if level and len(new[0]) * 4 < len(self.tables[0][0]):
                self.tables[1] = new
                return told
        self.tables = [new, self._table()]
        return told

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            odd = "  " in t or "\n\n" in t or " \n" in t or "\n " in t or t[:1].isspace() or t[-1:].isspace()
            if odd or any(x in t for x in self.added) or not t.replace("\n", "").isprintable() and (_odd.search(t) or "\0" in t):
                out[i] = self.whole(t)
            else:
                plain.append(i)
        for a, z in slices([len(texts[i]) for i in plain], 1 << 20):
            for i, ids in zip(plain[a:z], self._plain([texts[i] for i in plain[a:z]])):
                out[i] = ids
        return out

    def _plain(self, texts: list[str]) -> list[np.ndarray]:
        if not texts:
            return []
        coded = [t.encode() for t in texts]
        raw = np.frombuffer(b"\0" + b"\0".join(coded) + b"\0", np.uint8)
        sep = (raw == _SPACE) | (raw == _LINE) | (raw == _END)
        glued = np.zeros(len(raw), bool)
        mark = np.flatnonzero((raw == 0x2E) | (raw == 0x2C))
        glued[mark[_LETTER[raw[mark - 1]] & sep[mark + 1]]] = True
        starts = np.flatnonzero(~sep[1:] & (sep[:-1] | glued[1:])) + 1
        if not len(starts):
            return [np.zeros(0, np.uint32) for _ in texts]
        before = raw[starts - 1]
        lead = np.where(before == _SPACE, 1, np.where(before == _LINE, 2, np.where(before == _END, 0, 3)))
        inside = ~sep
        body = raw[inside].astype(np.uint64) + np.uint64(1)
        upto = np.cumsum(inside)
        at = upto[starts] - 1
        lens = np.diff(np.append(at, len(body)))
        body *= powers(int(lens.max()))[np.arange(len(body)) - np.repeat(at, lens)]
        keys = mix(mix(np.add.reduceat(body, at) ^ lens.astype(np.uint64)) + powers(5)[lead + 1])
        order = np.argsort(keys)
        unique = keys[order]
        fresh = np.concatenate([[True], unique[1:] != unique[:-1]])
        unique, first, back = unique[fresh], order[fresh], np.empty(len(keys), np.int64)
        back[order] = np.cumsum(fresh) - 1
        known, where, n = self._look(unique)
        if not known.all():
            new = np.flatnonzero(~known)
            if len(self.tables[0][0]) + len(self.tables[1][0]) + len(new) > self.most:
                self._forget()
                known, where, n = self._look(unique)
                new = np.flatnonzero(~known)
            f = first[new]
            blob = raw.tobytes()
            where[new], n[new] = self._learn(unique[new], [_LEADS[k] + blob[s : s + m].decode() for k, s, m in zip(lead[f].tolist(), starts[f].tolist(), lens[f].tolist())])
        n, where = n[back], where[back]
        ends = np.cumsum(n)
        ids = self.pool[np.repeat(where - (ends - n), n) + np.arange(ends[-1])]
        sizes = np.fromiter(map(len, coded), np.int64, len(coded))
        last = np.searchsorted(starts, np.cumsum(sizes + 1))  # pieces up to each text's end
        cut = np.concatenate([[0], ends])[last]
        return np.split(ids, cut[:-1])


def _encoder(spec) -> PieceEncoder:
    """One encoder a worker, kept from task to task with all pieces it knows."""

    def make():
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        return PieceEncoder(spec.value)

    return kept(__name__, spec, make)


def _tokenise(spec, end_id: int, block_ids: int):
    end = np.array([end_id], dtype="<u4")

    def run(batches):
        enc, part, block = _encoder(spec), TaskContext.get().partitionId(), 0
        docs, lens, ids, held = [], [], [], 0

        def row():
            a = np.concatenate(ids)
            raw = (b"2" + a.astype("<u2").tobytes()) if not len(a) or a.max() < 65536 else b"4" + a.astype("<u4").tobytes()
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int32()), "doc_ids": pa.array([docs], pa.list_(pa.int64())), "lengths": pa.array([lens], pa.list_(pa.int64())), "ids": pa.array([raw], pa.binary()), "n": pa.array([len(a)], pa.int64())})

        for b in batches:
            for doc, x in zip(b.column("doc").to_pylist(), enc.encode(b.column("text").to_pylist())):
                docs.append(doc)
                lens.append(len(x) + 1)
                ids += [x, end]
                held += len(x) + 1
                if held >= block_ids:
                    yield row()
                    block, docs, lens, ids, held = block + 1, [], [], [], 0
        if docs:
            yield row()

    return run


def _raw(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u2" if ids[:1] == b"2" else "<u4", offset=1)


def _count(batches):
    total = np.zeros(0, np.int64)
    for b in batches:
        for x in b.column("ids").to_pylist():
            c = np.bincount(_raw(x).astype(np.int64))
            if len(c) > len(total):
                total = np.concatenate([total, np.zeros(len(c) - len(total), np.int64)])
            total[: len(c)] += c
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_pydict({"id": pa.array(at, pa.int64()), "n": pa.array(total[at], pa.int64())})


def _code(rank_of):
    def run(batches):
        table = rank_of.value
        for b in batches:
            for i in range(b.num_rows):
                row = b.slice(i, 1).to_pydict()
                control, data = pack(table[_raw(row["ids"][0])])
                yield pa.RecordBatch.from_pydict({"part": pa.array(row["part"], pa.int32()), "block": pa.array(row["block"], pa.int32()), "start": pa.array(row["start"], pa.int64()), "doc_ids": pa.array(row["doc_ids"], pa.list_(pa.int64())), "lengths": pa.array(row["lengths"], pa.list_(pa.int64())), "control": pa.array([control], pa.binary()), "data": pa.array([data], pa.binary())})

    return run


def write_tokens(docs: DataFrame, spec: str, path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", block_ids: int = 300_000) -> None:
    """Encode all texts and write the data set described above to ``path``.

    spec: the tokenizer's JSON. One shuffle (range partitions of doc_id); the ids are then counted,
    ranked and coded block by block. Only the vocabulary's counts and a row a block reach the driver's
    side of a join, so memory doesn't grow with the texts.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    spec_b = spark.sparkContext.broadcast(spec)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # rows of one id (or of none) spread by the hash, which orders them as well
    src = src.withColumn("hash", F.xxhash64("text"))
    ordered = src.repartitionByRange(shuffle_parts(spark), "doc", "hash").sortWithinPartitions("doc", "hash", "text").select("doc", "text")
    raw = materialise(ordered.mapInArrow(lean(_tokenise(spec_b, end_id, block_ids)), RAW), "token-ids")

    counts = raw.select("ids").mapInArrow(lean(_count), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = sorted(((r["n"], r["id"]) for r in counts.collect()), key=lambda x: (-x[0], x[1]))  # at most the vocabulary
    rank_of = np.zeros(max([i for _, i in ranked], default=0) + 1, dtype=np.uint32)
    for rank, (_, i) in enumerate(ranked):
        rank_of[i] = rank
    spark.createDataFrame([(rank, i, n) for rank, (n, i) in enumerate(ranked)], "rank int, id bigint, n bigint").coalesce(1).write.parquet(f"{path}/ranks")

    # ids before each part: one number a range partition; within a part, a running sum over its blocks
    from pyspark.sql import Window

    sizes = raw.select("part", "block", "n")
    before, total = [], 0
    for r in sizes.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row a partition
        before.append((r["part"], total))
        total += r["n"]
    offsets = spark.createDataFrame(before, "part int, before bigint")
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.withColumn("inside", F.coalesce(F.sum("n").over(w), F.lit(0))).join(offsets, "part").select("part", "block", (F.col("before") + F.col("inside")).alias("start"))
    coded = raw.join(starts, ["part", "block"]).mapInArrow(lean(_code(spark.sparkContext.broadcast(rank_of))), CODED)
    coded.write.parquet(f"{path}/blocks")
    discard(raw)


def _decode(id_of, digest: bool):
    def run(batches):
        table = id_of.value
        for b in batches:
            for i in range(b.num_rows):
                row = {k: v[0] for k, v in b.slice(i, 1).to_pydict().items()}
                lens = np.array(row["lengths"], np.int64)
                ids = table[unpack(row["control"], row["data"], int(lens.sum()))].astype("<u4") if len(lens) else np.zeros(0, "<u4")
                ends = np.cumsum(lens)
                cols = {"doc_id": pa.array(row["doc_ids"], pa.int64()), "start": pa.array(row["start"] + ends - lens, pa.int64()), "n_tokens": pa.array(lens, pa.int64())}
                if digest:
                    view = memoryview(ids.tobytes())
                    cols["ids_crc32"] = pa.array([zlib.crc32(view[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lens.tolist())], pa.int64())
                    yield pa.RecordBatch.from_pydict(cols)
                else:
                    at = np.concatenate([[0], ends]).astype(np.int32)
                    cols["ids"] = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int64), pa.int64()))
                    yield pa.RecordBatch.from_pydict(cols)

    return run


def read_tokens(spark: SparkSession, path: str, digest: bool = False) -> DataFrame:
    """Documents of a data set: doc_id, start, n_tokens and ids (or, with digest, their ids_crc32)."""
    bounded_batches(spark)
    ranks = spark.read.parquet(f"{path}/ranks").select("rank", "id").collect()  # at most the vocabulary
    id_of = np.zeros(len(ranks) + 1, dtype=np.uint32)
    for r in ranks:
        id_of[r["rank"]] = r["id"]
    kind = "ids_crc32 bigint" if digest else "ids array<bigint>"
    blocks = spark.read.schema(CODED).parquet(f"{path}/blocks")
    return blocks.select("start", "doc_ids", "lengths", "control", "data").mapInArrow(lean(_decode(spark.sparkContext.broadcast(id_of), digest)), f"doc_id bigint, start bigint, n_tokens bigint, {kind}")


def tokens_of(docs: DataFrame, tokenizer_path: str, end_id: int = 2, digest: bool = True) -> DataFrame:
    """Write ``docs`` to a new data set in the shared folder and read it back."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    path = fresh_path(spark, "tokens")
    write_tokens(docs, spec, path, end_id)
    return read_tokens(spark, path, digest)
