"""Shared pieces: bounded Arrow batches, text and hash kernels."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrove.session import ship
from seqgrove.storage import discard, fresh_path, materialise, shared_dir, sweep

__all__ = ["discard", "fresh_path", "materialise", "shared_dir", "sweep"]

#: Word separators of every contract here: space and the five ASCII controls 9-13.
SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
WORD = r"[^\x20\x09-\x0D]+"


#: Arrow batches of every operator here: cut by bytes as well as rows, so very long texts don't pile up in one.
BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "2m"}


def bounded_batches(spark: SparkSession) -> None:
    """Ships the package and bounds Arrow batches, alike for all operators; what the session sets itself stays.

    Plans run later than they are made, so the limits are the session's and no operator has its own."""
    ship(spark)
    given = {x._1() for x in spark.sparkContext._jsc.sc().conf().getAll()}
    for name, value in BATCHES.items():
        if name not in given:
            spark.conf.set(name, value)


def _libc():
    import ctypes

    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:
        return None


def give_back() -> None:
    """Memory that is free in this process goes back to the machine."""
    pa.default_memory_pool().release_unused()
    if (libc := _libc()) is not None:
        libc.malloc_trim(0)


#: What a worker keeps from task to task, by module.
KEPT: dict[str, tuple] = {}


def kept(module: str, source, make):
    """``make()`` once a worker and ``source`` (a broadcast, which is kept too, so that it stays the one known)."""
    if module not in KEPT or KEPT[module][0] is not source:
        KEPT[module] = (source, make())
    return KEPT[module][1]


def lean(run):
    """``run`` for a Python worker that gives memory back: very large blocks at once, the rest when a task ends.

    Workers live on from task to task, beside a JVM that has most of the executor's memory."""

    def task(*args):
        for other in [m for m in KEPT if m != run.__module__]:
            del KEPT[other]
        libc = _libc()
        if libc is not None:
            libc.mallopt(-3, 16 << 20)  # M_MMAP_THRESHOLD: work arrays below it are reused without page faults
            libc.mallopt(-1, 128 << 20)  # M_TRIM_THRESHOLD
        try:
            yield from run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return task


def lean_table(run):
    """``run`` (a group to a table) for a Python worker that gives memory back after each group."""

    def task(*args):
        libc = _libc()
        if libc is not None:
            libc.mallopt(-3, 16 << 20)
            libc.mallopt(-1, 128 << 20)
        try:
            return run(*args)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    # Spark tells by the number of arguments whether the keys are wanted
    if run.__code__.co_argcount == 3:
        return lambda key, left, right: task(key, left, right)
    return lambda key, rows: task(key, rows)


def lean_stream(run):
    """``run`` (a group's batches to batches), as ``lean_table``: no table of the whole group is made."""

    def task(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        libc = _libc()
        if libc is not None:
            libc.mallopt(-3, 16 << 20)
            libc.mallopt(-1, 128 << 20)
        try:
            yield from run(key, batches)
        finally:
            pa.default_memory_pool().release_unused()
            if libc is not None:
                libc.malloc_trim(0)

    return task


def utf8(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).cast("binary")


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def crc_bucket(key: Column, n: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % n


def slices(sizes, most: int):
    """(start, end) runs of items whose sizes sum to at most ``most``, or single larger items."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values."""
    h = h ^ (h >> np.uint64(30))
    h *= M1
    h ^= h >> np.uint64(27)
    h *= M2
    h ^= h >> np.uint64(31)
    return h


_powers = np.ones(1, dtype=np.uint64)


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        n = max(64, 1 << (n - 1).bit_length())
        p = np.full(n, BASE, dtype=np.uint64)
        p[0] = 1
        _powers = np.multiply.accumulate(p)
    return _powers


def ranked(keys: np.ndarray, width: int = 64) -> np.ndarray:
    """A stable argsort of numbers of ``width`` bits: a plain sort of upper bits and places, which is several times as fast."""
    n = len(keys)
    bits = max(1, (n - 1).bit_length())
    cut = max(0, width + bits - 64)
    packed = keys.astype(np.uint64) >> np.uint64(cut)
    packed <<= np.uint64(bits)
    packed |= np.arange(n, dtype=np.uint64)
    packed.sort()
    packed &= np.uint64((1 << bits) - 1)
    order = packed.view(np.int64)
    if cut:
        found = keys[order]
        if (found[1:] < found[:-1]).any():  # different keys have the same upper bits
            return np.argsort(keys, kind="stable")
    return order


def distinct(keys: np.ndarray) -> np.ndarray:
    """The different keys, in order; by a sort, where np.unique fills a hash table."""
    keys = np.sort(keys)
    return keys[np.concatenate([np.ones(min(1, len(keys)), bool), keys[1:] != keys[:-1]])]


def eights(raw: bytes | np.ndarray, step: int = 1) -> np.ndarray:
    """The eight bytes from each place that ``step`` divides, as numbers; ``raw`` has eight bytes more than are asked for."""
    return np.ndarray((max(0, len(raw) - 8) // step,), "<u8", raw, 0, (step,))


#: The bytes of a word that are among the eight from its start, by their number.
MASKS = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def word_hashes(texts: list[bytes], lower: bool = True, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all texts in order, and the number of words of each text; bytes that are
    ``apart`` (line feed must be) stand between words. Words are hashed by eight bytes at a time."""
    runs = list(slices([len(t) for t in texts], 1 << 18))
    if len(runs) != 1:  # the work arrays take many times the size of the texts
        parts = [word_hashes(texts[a:z], lower, apart) for a, z in runs]
        return np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in parts)]), np.concatenate([np.zeros(0, np.int64), *(c for _, c in parts)])
    joined = b"\n".join([b"", *texts, b"\n" * 9])
    inside = np.frombuffer(joined.translate((~apart).tobytes()), np.uint8)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    starts, lens = edges[::2], edges[1::2] - edges[::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    from_here = eights(joined.lower() if lower else joined)
    h = from_here[starts] & MASKS[np.minimum(lens, 8)]
    if len(long := np.flatnonzero(lens > 8)):
        more = (lens[long] - 1) >> 3  # eights after the first
        first = np.cumsum(more) - more
        nth = np.arange(int(more.sum())) - np.repeat(first, more) + 1
        rest = from_here[np.repeat(starts[long], more) + 8 * nth] & MASKS[np.minimum(np.repeat(lens[long], more) - 8 * nth, 8)]
        h[long] += np.add.reduceat(mix(mix(rest) + nth.astype(np.uint64) * BASE), first)
    h = mix(h + lens.astype(np.uint64) * BASE)
    ends_at = np.cumsum(np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    upto = np.searchsorted(starts, ends_at)
    return h, np.diff(upto, prepend=0)


def texts_of(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return batch.column(name).to_pylist()


def schema_of(**cols) -> pa.Schema:
    return pa.schema(list(cols.items()))


#: A filter of fixed size: a full one lets more through and drops nothing.
BLOOM_BITS = 25


def _bloom_at(keys: np.ndarray, k: int) -> np.ndarray:
    return (mix(keys + np.uint64(int(BASE) * k % (1 << 64))) & np.uint64((1 << BLOOM_BITS) - 1)).astype(np.int64)


def _bloom_part(keys_of):
    def run(batches):
        bits = np.zeros(1 << BLOOM_BITS, bool)
        for keys in keys_of(batches):
            for k in (1, 2, 3):
                bits[_bloom_at(keys, k)] = True
        if bits.any():
            yield pa.RecordBatch.from_pydict({"bits": pa.array([zlib.compress(np.packbits(bits).tobytes(), 1)], pa.binary())})

    return run


def bloom_of(rows: DataFrame, keys_of) -> np.ndarray:
    """The filter of all keys of ``rows``; keys_of makes arrays of 64-bit keys from batches."""
    bits = np.zeros((1 << BLOOM_BITS) // 8, np.uint8)
    for r in rows.coalesce(8).mapInArrow(lean(_bloom_part(keys_of)), "bits binary").toLocalIterator():
        bits |= np.frombuffer(zlib.decompress(bytes(r["bits"])), np.uint8)
    return bits


def bloom_has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    found, left = np.zeros(len(keys), bool), np.arange(len(keys))
    for k in (1, 2, 3):
        at = _bloom_at(keys, k)
        hit = (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0
        keys, left = keys[hit], left[hit]
    found[left] = True
    return found
