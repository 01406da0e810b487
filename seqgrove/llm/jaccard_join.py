"""N-gram Jaccard join: rare-first prefixes, length, positional and suffix filters, one verification a pair.

1. One pass hashes every text to its set of word n-grams. Texts with equal sets are one *node* (a 128-bit
   digest), so exact copies never form pairs. The same pass counts all n-grams and all words in a fixed
   number of hash buckets. The bucket of an n-gram and those of its words bound how often it occurs; the
   least of these bounds orders n-grams from rare to frequent, everywhere alike.
2. A second pass emits the prefix n-grams of each node, packed by hash partition; an n-gram that only one
   node has is dropped where its partition meets. What is left are the groups of nodes that share an n-gram.
3. First each group pairs a few of its nodes with all others (stars), never all pairs. Pairs that pass the
   length and the positional filter are made distinct, checked by the suffix filter (a bound of the overlap
   from the sizes of fixed parts of both sets) and verified on the whole sets.
4. In groups whose nodes are not yet one component, a node is paired with each other component that it could
   link into (one row, however many nodes that has): of two components, the one with fewer nodes in the group
   sends its nodes. A pair of two single nodes passes the suffix filter and is verified. A node and a larger
   component meet with that component's whole sets, in blocks of ``BLOCK`` nodes on both sides. Jaccard distance is a
   metric: the distances of all nodes of a block to a few of them (far from each other) tell, once a node's distances to
   these are known, which nodes it can't link with, and the rest is verified until one links. So any two linked
   texts end in one component, while a group of many near copies costs a few times as many rows as it has
   members. Whole sets are only made for nodes that passed all filters.

Defined cases: texts without words (or null) have the empty set and link with nothing; a text shorter than
n words is one n-gram of its whole sequence; rows with equal ids are kept apart by their sets; a null id is
kept, and names a component only where no other id does; very long texts are hashed in slices; an empty table gives no rows;
further columns are not read, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bloom_has, bloom_of, bounded_batches, discard, lean, lean_table, materialise, mix, shuffle_parts, sweep, utf8, word_hashes
from seqgrove.operators.components import components

SKETCH_BITS = 21
PIECES = 64


def shingle_sets(texts: list[bytes], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's word n-grams, words by the ASCII-only rules."""
    return _sets_of(*word_hashes(texts), n)


def _sets_of(h: np.ndarray, counts: np.ndarray, n: int, bound: np.ndarray | None = None):
    """The sets; with bounds of the words' counts also the least bound of each n-gram's words."""
    at = np.cumsum(counts) - counts
    turn = mix(np.arange(1, n + 1, dtype=np.uint64)) | np.uint64(1)
    if len(h) >= n:
        g = h[: len(h) - n + 1] * turn[0]
        for k in range(1, n):
            g = g + h[k : len(h) - n + 1 + k] * turn[k]
        g = mix(g)
        if bound is not None:
            least = bound[: len(g)]
            for k in range(1, n):
                least = np.minimum(least, bound[k : len(g) + k])
    out, bounds = [], []
    for a, c in zip(at.tolist(), counts.tolist()):
        if c >= n and bound is None:
            out.append(np.unique(g[a : a + c - n + 1]))
        elif c >= n:
            s, first = np.unique(g[a : a + c - n + 1], return_index=True)
            out.append(s)
            bounds.append(least[a + first])
        elif c:
            out.append(mix((h[a : a + c] * turn[:c]).sum(keepdims=True) + np.uint64(c)))
            bounds.append(bound[a : a + c].min(keepdims=True) if bound is not None else None)
        else:
            out.append(np.zeros(0, np.uint64))
            bounds.append(out[-1])
    return out if bound is None else (out, bounds)


def node_of(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sketch_at(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int32)


SUMMARY = "doc bigint, n bigint, node binary, hist binary, piece int, counts binary"


def _summaries(n: int):
    def run(batches):
        grams, words = np.zeros(1 << SKETCH_BITS, np.uint32), np.zeros(1 << SKETCH_BITS, np.uint32)  # of one task
        for b in batches:
            h, counts = word_hashes(b.column("text").to_pylist())
            sets = _sets_of(h, counts, n)
            if not sets:
                continue
            for total, keys in ((grams, np.concatenate(sets)), (words, h)):
                at, k = np.unique(_sketch_at(keys), return_counts=True)
                total[at] += k.astype(np.uint32)
            k = len(sets)
            yield pa.RecordBatch.from_pydict({"doc": b.column("doc"), "n": pa.array([len(s) for s in sets], pa.int64()), "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.binary()), "hist": pa.array([_parts(s) if len(s) else None for s in sets], pa.binary()), "piece": pa.nulls(k, pa.int32()), "counts": pa.nulls(k, pa.binary())})
        yield from _sketch_rows(np.concatenate([grams, words]))

    return run


def _classes(n: int) -> int:
    """About one n-gram a class, from the size of the smallest set that may still match: texts that can
    match have equal numbers or neighbours of them."""
    return max(16, 1 << max(0, n.bit_length() - 1))


def _parts(s: np.ndarray) -> bytes:
    """Sizes of the parts of a set, by hash class: at most 255 is told exactly, more as 255."""
    c = _classes(len(s))
    return np.minimum(np.bincount((s & np.uint64(c - 1)).astype(np.int64), minlength=c), 255).astype(np.uint8).tobytes()


def _sketch_rows(sketch: np.ndarray, bare: bool = False):
    if sketch.any():
        parts = [x.astype("<u2" if x.max() < 1 << 16 else "<u4" if x.max() < 1 << 32 else "<u8").tobytes() for x in np.split(sketch, PIECES)]
        own = {"piece": pa.array(range(PIECES), pa.int32()), "counts": pa.array(parts, pa.binary())}
        rest = {} if bare else {"doc": pa.nulls(PIECES, pa.int64()), "n": pa.nulls(PIECES, pa.int64()), "node": pa.nulls(PIECES, pa.binary()), "hist": pa.nulls(PIECES, pa.binary())}
        yield pa.RecordBatch.from_pydict(rest | own)


def _piece_counts(raw: bytes) -> np.ndarray:
    size = (2 << SKETCH_BITS) // PIECES
    return np.frombuffer(raw, f"<u{len(raw) // size}").astype(np.int64)


def _sum_sketches(batches):
    total = np.zeros((PIECES, (2 << SKETCH_BITS) // PIECES), np.int64)
    for b in batches:
        for p, c in zip(b.column("piece").to_pylist(), b.column("counts").to_pylist()):
            total[p] += _piece_counts(c)
    yield from _sketch_rows(total.ravel(), bare=True)


def _sketch(rows: DataFrame) -> np.ndarray:
    """The sum of all tasks' counts, level by level; of fixed size (2 ** SKETCH_BITS numbers twice)."""
    kind = "piece int, counts binary"
    part = rows.mapInArrow(lean(_sum_sketches), kind)
    n = rows.rdd.getNumPartitions()
    while n > 1:
        n = -(-n // 16)
        part = part.repartition(n).mapInArrow(lean(_sum_sketches), kind)
    total = np.zeros((PIECES, (2 << SKETCH_BITS) // PIECES), np.uint32)
    for r in part.toLocalIterator():
        total[r["piece"]] += np.minimum(_piece_counts(bytes(r["counts"])), 2**32 - 1).astype(np.uint32)
    return total.reshape(2, -1)


class Threshold:
    """Jaccard >= num / den in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def prefix(self, n):
        return n - -(-(self.num * n) // self.den) + 1

    def sizes_fit(self, a, b):
        return self.den * np.minimum(a, b) >= self.num * np.maximum(a, b)

    def enough(self, overlap, a, b):
        return (self.den + self.num) * overlap >= self.num * (a + b)


def _pack(p: int, nodes: list[bytes], n: np.ndarray, h: np.ndarray, d: np.ndarray, pos: np.ndarray) -> bytes:
    wide = len(nodes) > 65535 or (len(pos) and pos.max() > 65535)
    kind = "<u4" if wide else "<u2"
    head = np.array([len(nodes), len(h), wide], "<u4").tobytes()
    return b"".join([head, b"".join(nodes), n.astype("<u4").tobytes(), h.astype("<u4").tobytes(), d.astype(kind).tobytes(), pos.astype(kind).tobytes()])


def _unpack(blob: bytes):
    k, m, wide = np.frombuffer(blob, "<u4", 3).tolist()
    kind, width = ("<u4", 4) if wide else ("<u2", 2)
    at = 12
    nodes = [blob[at + 16 * i : at + 16 * i + 16] for i in range(k)]
    at += 16 * k
    n = np.frombuffer(blob, "<u4", k, at).astype(np.int64)
    at += 4 * k
    h = np.frombuffer(blob, "<u4", m, at)
    at += 4 * m
    d = np.frombuffer(blob, kind, m, at).astype(np.int64)
    pos = np.frombuffer(blob, kind, m, at + width * m).astype(np.int64)
    return nodes, n, h, d, pos


def _prefixes(sketch, n: int, t: Threshold, parts: int, flush: int = 400_000):
    """Prefix n-grams of the distinct nodes of a run of rows, packed by hash partition."""

    def emit(nodes, sizes, hs, ps):
        lens = np.fromiter(map(len, hs), np.int64, len(hs))
        h, pos, d = np.concatenate(hs), np.concatenate(ps), np.repeat(np.arange(len(nodes)), lens)
        part = ((h >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        h, pos, d, part = (h[order] & np.uint64(0xFFFFFFFF)), pos[order], d[order], part[order]
        edges = np.searchsorted(part, np.arange(parts + 1))
        size = np.array(sizes)
        keys, blobs = [], []
        for p in range(parts):
            a, z = edges[p], edges[p + 1]
            if a < z:
                own, back = np.unique(d[a:z], return_inverse=True)
                keys.append(p)
                blobs.append(_pack(p, [nodes[i] for i in own], size[own], h[a:z], back, pos[a:z]))
            if len(blobs) == 64 or (p == parts - 1 and blobs):
                yield pa.RecordBatch.from_pydict({"p": pa.array(keys, pa.int32()), "blob": pa.array(blobs, pa.binary())})
                keys, blobs = [], []

    def run(batches):
        counts = sketch.value
        seen, nodes, sizes, hs, ps, held = set(), [], [], [], [], 0
        for b in batches:
            words, per = word_hashes(b.column("text").to_pylist())
            for s, bound in zip(*_sets_of(words, per, n, counts[1][_sketch_at(words)])):
                if not len(s):
                    continue
                node = node_of(s)
                if node in seen:
                    continue
                seen.add(node)
                k = int(t.prefix(len(s)))
                f = np.minimum(counts[0][_sketch_at(s)], bound)
                if k < len(s):
                    few = np.flatnonzero(f <= np.partition(f, k - 1)[k - 1])
                    few = few[np.argsort(f[few], kind="stable")][:k]
                else:
                    few = np.argsort(f, kind="stable")
                nodes.append(node)
                sizes.append(len(s))
                hs.append(s[few])
                ps.append(np.arange(k))
                held += k
                if held >= flush or len(nodes) >= 60_000:
                    yield from emit(nodes, sizes, hs, ps)
                    seen, nodes, sizes, hs, ps, held = set(), [], [], [], [], 0
        if nodes:
            yield from emit(nodes, sizes, hs, ps)

    return run


def _shared(batches):
    """All of one partition: keep the n-grams of at least two nodes."""
    parts: dict[int, list[bytes]] = {}
    for b in batches:
        for p, blob in zip(b.column("p").to_pylist(), b.column("blob").to_pylist()):
            parts.setdefault(p, []).append(blob)
    for p in list(parts):
        cols, base, all_nodes, all_n = [], 0, [], []
        for blob in parts.pop(p):
            nodes, n, h, d, pos = _unpack(blob)
            cols.append((h, d + base, pos))
            base += len(nodes)
            all_nodes += nodes
            all_n.append(n)
        h, d, pos = (np.concatenate(x) for x in zip(*cols))
        n = np.concatenate(all_n)
        order = np.argsort(h, kind="stable")
        h, d, pos = h[order], d[order], pos[order]
        same = h[1:] == h[:-1]
        keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        h, d, pos = h[keep], d[keep], pos[keep]
        used, back = np.unique(d, return_inverse=True)
        names = sorted({all_nodes[i] for i in used})
        number = {x: i for i, x in enumerate(names)}
        node = np.array([number[all_nodes[i]] for i in used], np.int64)
        size = np.zeros(len(names), np.int64)
        size[node] = n[used]
        d = node[back] if len(used) else back
        # copies of a node came from several tasks
        order = np.lexsort((d, h))
        h, d, pos = h[order], d[order], pos[order]
        if len(h):
            new = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
            h, d, pos = h[new], d[new], pos[new]
            same = h[1:] == h[:-1]
            keep = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            h, d, pos = h[keep], d[keep], pos[keep]
        if len(h):
            yield pa.RecordBatch.from_pydict({"p": pa.array([p], pa.int32()), "blob": pa.array([_pack(p, names, size, h, d, pos)], pa.binary())})


def _fits(t: Threshold, n, d, pos, i, j):
    a, b = n[d[i]], n[d[j]]
    left = np.minimum(a - pos[i], b - pos[j])  # at the first common n-gram of the pair: all that can follow, and itself
    return t.sizes_fit(a, b) & t.enough(left, a, b)


def _pair_rows(names, a, b, lots: int):
    """Distinct pairs (a < b by number), packed by a hash of both names."""
    if not len(a):
        return
    yield from _named_rows(names, names, np.unique(np.minimum(a, b) * len(names) + np.maximum(a, b)), lots)


def _named_rows(left: list[bytes], right: list[bytes], codes: np.ndarray, lots: int):
    """Codes (number in ``left`` * len(right) + number in ``right``) as names, packed by a hash of both."""
    rows: dict[int, list[bytes]] = {}
    for x in codes.tolist():
        u, v = left[x // len(right)], right[x % len(right)]
        rows.setdefault((u[0] | u[1] << 8 | v[0] << 16 | v[1] << 24) % lots, []).append(u + v)
    if rows:
        yield pa.RecordBatch.from_pydict({"lot": pa.array(list(rows), pa.int32()), "pairs": pa.array([b"".join(v) for v in rows.values()], pa.binary())})


def _centres(names: list[bytes], h: np.ndarray, d: np.ndarray, turn: int) -> np.ndarray:
    """For each row the row of its group's centre: a node by a hash that differs each turn, equal everywhere."""
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    lens = np.diff(np.append(starts, len(h)))
    key = mix(np.array([int.from_bytes(x[:8], "little") for x in names], np.uint64) + np.uint64(turn))[d]
    group = np.repeat(np.arange(len(starts)), lens)
    at = np.flatnonzero(key == np.minimum.reduceat(key, starts)[group])
    return at[np.unique(group[at], return_index=True)[1]][group]


#: Nodes of each group that are paired with all others before anything is known.
STARS = 6


def _stars(t: Threshold, lots: int):
    def run(batches):
        for b in batches:
            for blob in b.column("blob").to_pylist():
                names, n, h, d, pos = _unpack(blob)
                a, z = [], []
                for turn in range(STARS):
                    centre = _centres(names, h, d, turn)
                    i = np.flatnonzero(d != d[centre])
                    i = i[_fits(t, n, d, pos, centre[i], i)]
                    a.append(d[centre[i]])
                    z.append(d[i])
                yield from _pair_rows(names, np.concatenate(a), np.concatenate(z), lots)

    return run


def _meetings(t: Threshold, lots: int):
    """(node, component) of groups whose nodes are in several; rows: the packed groups and (node, label)."""

    def run(key, groups, labels):
        label = dict(zip(labels["node"].to_pylist(), labels["label"].to_pylist()))
        out = []
        for blob in groups["blob"].to_pylist():
            names, n, h, d, pos = _unpack(blob)
            roots = sorted({label.get(x, x) for x in names})
            number = {x: i for i, x in enumerate(roots)}
            lab = np.array([number[label.get(x, x)] for x in names], np.int64)[d]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            ends = np.append(starts[1:], len(h))
            mixed = np.minimum.reduceat(lab, starts) != np.maximum.reduceat(lab, starts)
            found = []
            for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist()):
                own = lab[s:e]
                kinds, size = np.unique(own, return_counts=True)
                rank = np.empty(len(kinds), np.int64)
                rank[np.lexsort((kinds, size))] = np.arange(len(kinds))
                rank = rank[np.searchsorted(kinds, own)]  # by nodes in the group, then name
                for i in np.flatnonzero(rank < len(kinds) - 1).tolist():
                    j = np.flatnonzero(rank > rank[i]) + s
                    j = j[_fits(t, n, d, pos, np.full(len(j), s + i), j)]
                    if len(j):
                        found.append(np.unique(lab[j]) + d[s + i] * len(roots))
            out += _named_rows(names, roots, np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64), lots)
        return pa.Table.from_batches(out, schema=pa.schema([("lot", pa.int32()), ("pairs", pa.binary())]))

    return run


def _distinct_pairs(key, rows):
    pairs = {x[i : i + 32] for x in rows["pairs"].to_pylist() for i in range(0, len(x), 32)}
    return pa.table({"u": pa.array([x[:16] for x in pairs], pa.binary()), "v": pa.array([x[16:] for x in pairs], pa.binary())})


def _overlap_bound(x: bytes, y: bytes, m: int, k: int) -> int:
    """No more n-grams in common than the smaller of two parts has, summed over the parts."""
    a, b = np.frombuffer(x, np.uint8).astype(np.int64), np.frombuffer(y, np.uint8).astype(np.int64)
    if max(a.max(), b.max()) == 255:
        return min(m, k)
    c = min(len(a), len(b))  # a power of two: coarser parts are sums of finer ones
    a, b = a.reshape(-1, c).sum(0), b.reshape(-1, c).sum(0)
    return int(np.minimum(a, b).sum())


def _suffix_ok(t: Threshold):
    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            rows = zip(*(b.column(c).to_pylist() for c in ("hu", "hv", "nu", "nv")))
            ok = [bool(t.enough(_overlap_bound(x, y, m, k), m, k)) for x, y, m, k in rows]
            yield pa.RecordBatch.from_pydict({c: b.column(c).filter(pa.array(ok)) for c in ("u", "v")})

    return run


def _node_keys(batches):
    for b in batches:
        yield _keys_of(b.column("node").to_pylist())


def _keys_of(nodes: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(nodes), np.uint64).reshape(-1, 2)[:, 0]


def _sets(bloom, n: int):
    """node, grams of the texts that the filter lets through, each node once a batch."""

    def run(batches):
        bits = bloom.value
        for b in batches:
            sets = {node_of(s): s for s in shingle_sets(b.column("text").to_pylist(), n) if len(s)}
            names = list(sets)
            found = {x: sets[x] for x, ok in zip(names, bloom_has(bits, _keys_of(names)).tolist()) if ok}
            if found:
                yield pa.RecordBatch.from_pydict({"node": pa.array(list(found), pa.binary()), "grams": pa.array([s.tobytes() for s in found.values()], pa.binary())})

    return run


def _verified(t: Threshold):
    """Verifies every pair; what a partition's links join is told by one link a node."""

    def run(batches):
        up: dict[bytes, bytes] = {}

        def root(x: bytes) -> bytes:
            while up.setdefault(x, x) != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for b in batches:
            for u, v, x, y in zip(*(b.column(c).to_pylist() for c in ("u", "v", "gu", "gv"))):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.sort(np.concatenate([x, y]), kind="stable")
                if t.enough(int((both[1:] == both[:-1]).sum()), len(x), len(y)):
                    u, v = sorted((root(u), root(v)))
                    up[v] = u
        tree = [(x, root(x)) for x in up if up[x] != x]
        yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in tree], pa.binary()), "v": pa.array([r for _, r in tree], pa.binary())})

    return run


SMALL = 100_000


def _only(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of the wanted nodes: their names are broadcast up to ``SMALL``, else joined by a shuffle."""
    few = wanted.count() <= SMALL
    return table.join(F.broadcast(wanted) if few else wanted, "node", "left_semi")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()


#: Nodes of a component, and nodes compared with it, that meet in one task.
BLOCK = 2048
#: Nodes of a block whose distances to all others are taken first.
PIVOTS = 4


def _overlap(x: np.ndarray, y: np.ndarray) -> int:
    both = np.sort(np.concatenate([x, y]), kind="stable")
    return int((both[1:] == both[:-1]).sum())


def _distances(p: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Overlaps and Jaccard distances."""
    n = np.array([_overlap(p, s) for s in sets])
    return n, 1 - n / (np.array([len(s) for s in sets]) + len(p) - n)


def _joined(t: Threshold):
    """One link into the block for each node that has one."""

    def run(key, outer, inner):
        names, sets = inner["node"].to_pylist(), [np.frombuffer(x, np.uint64) for x in inner["grams"].to_pylist()]
        asked = dict(zip(outer["node"].to_pylist(), outer["grams"].to_pylist()))
        links = []
        if names and asked:
            sizes = np.array([len(s) for s in sets])
            pivots, far = [0], []
            while True:
                far.append(_distances(sets[pivots[-1]], sets)[1])
                least = np.min(far, axis=0)
                if len(far) == PIVOTS or not least.any():
                    break
                pivots.append(int(least.argmax()))
            reach = 1 - t.num / t.den + 1e-9
            for u, raw in asked.items():
                x = np.frombuffer(raw, np.uint64)
                n, d = _distances(x, [sets[p] for p in pivots])
                hit = np.flatnonzero(t.enough(n, len(x), sizes[pivots]))
                if len(hit):
                    links.append((u, names[pivots[hit[0]]]))
                    continue
                near = t.sizes_fit(len(x), sizes)
                for own, to in zip(far, d):
                    near &= np.abs(own - to) <= reach
                for i in np.flatnonzero(near).tolist():
                    if t.enough(_overlap(x, sets[i]), len(x), len(sets[i])):
                        links.append((u, names[i]))
                        break
        return pa.table({"u": pa.array([u for u, _ in links], pa.binary()), "v": pa.array([v for _, v in links], pa.binary())})

    return run


class _Search:
    """Pairs to links: filters, whole sets as they are needed, verification."""

    def __init__(self, texts: DataFrame, hists: DataFrame, t: Threshold, n: int):
        self.texts, self.hists, self.t, self.n = texts, hists, t, n
        self.sets: list[DataFrame] = []

    def passing(self, pairs: DataFrame) -> DataFrame:
        """Pairs of nodes that pass the suffix filter."""
        hists = _only(self.hists, _ends(pairs))
        hu, hv = (hists.select(F.col("node").alias(c), F.col("hist").alias(f"h{c}"), F.col("n").alias(f"n{c}")) for c in "uv")
        return materialise(pairs.join(hu, "u").join(hv, "v").select("u", "v", "hu", "hv", "nu", "nv").mapInArrow(lean(_suffix_ok(self.t)), "u binary, v binary"), "jaccard-pairs")

    def fetch(self, wanted: DataFrame) -> None:
        """Make the whole sets of nodes that have none yet, in one pass over the texts; of copies one will do."""
        for s in self.sets:
            wanted = wanted.join(s.select("node"), "node", "left_anti")
        wanted = materialise(wanted, "jaccard-wanted")
        if wanted.take(1):
            bloom = self.texts.sparkSession.sparkContext.broadcast(bloom_of(wanted, _node_keys))
            sets = _only(self.texts.mapInArrow(lean(_sets(bloom, self.n)), "node binary, grams binary"), wanted)
            self.sets.append(materialise(sets.groupBy("node").agg(F.first("grams").alias("grams")), "jaccard-sets"))
            bloom.destroy()
        discard(wanted)

    def every_set(self) -> DataFrame:
        sets = self.sets[0]
        for s in self.sets[1:]:
            sets = sets.unionByName(s)
        return sets

    def verify(self, pairs: DataFrame) -> DataFrame:
        """Links that join what the links among the pairs join."""
        if not self.sets:
            return materialise(pairs.limit(0), "jaccard-links")
        sets = _only(self.every_set(), _ends(pairs))
        gu, gv = (sets.select(F.col("node").alias(c), F.col("grams").alias(f"g{c}")) for c in "uv")
        return materialise(pairs.join(gu, "u").join(gv, "v").select("u", "v", "gu", "gv").mapInArrow(lean(_verified(self.t)), "u binary, v binary"), "jaccard-links")

    def join(self, meetings: DataFrame, members: DataFrame) -> DataFrame:
        """Links of (u: node, v: component) into components of (root, node) with several nodes."""
        if not self.sets:
            return materialise(meetings.limit(0), "jaccard-links")
        sets = self.every_set()
        inner = members.join(meetings.select(F.col("v").alias("root")).distinct(), "root")
        outer = meetings.select(F.col("v").alias("root"), F.col("u").alias("node"))
        blocks = lambda d, name: d.groupBy("root").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(name))
        size = blocks(inner, "ins").join(blocks(outer, "outs"), "root")
        part = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
        every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        keys = ["root", "in_block", "out_block"]
        inner = inner.join(size, "root").withColumn("in_block", part("ins")).withColumn("out_block", every("outs")).select(*keys, "node").join(sets, "node")
        outer = outer.join(size, "root").withColumn("out_block", part("outs")).withColumn("in_block", every("ins")).select(*keys, "node").join(sets, "node")
        named = lambda d: d.select(*[F.col(c).alias(c) for c in (*keys, "node", "grams")])
        inner, outer = named(inner), named(outer)
        return materialise(outer.groupBy(*keys).cogroup(inner.groupBy(*keys)).applyInArrow(lean_table(_joined(self.t)), "u binary, v binary"), "jaccard-links")


#: Least number of hash lots; with few lots a node's n-grams would share more of them than in a larger run.
LOTS = 64


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, node of every row."""
    spark = docs.sparkSession
    bounded_batches(spark)
    t, parts = Threshold(num, den), shuffle_parts(spark)
    lots = max(LOTS, parts)
    src = docs.select(F.col(id_col).cast("bigint").alias("doc"), utf8(F.col(text_col)).alias("text"))
    first = materialise(src.mapInArrow(lean(_summaries(n)), SUMMARY), "jaccard-summaries")
    sketch = spark.sparkContext.broadcast(_sketch(first.where("piece is not null").select("piece", "counts")))
    rows = first.where("piece is null").select("doc", "n", "node")
    texts = src.select("text")
    packed = texts.mapInArrow(lean(_prefixes(sketch, n, t, lots)), "p int, blob binary")
    groups = materialise(packed.repartition(parts, "p").mapInArrow(lean(_shared), "p int, blob binary"), "jaccard-groups")
    sketch.destroy()  # the driver has a copy as well
    sweep(spark)

    members = materialise(groups.mapInArrow(lean(_member_rows), "p int, node binary"), "jaccard-members")
    hists = _only(first.where("node is not null").select("node", "n", "hist"), members.select("node").distinct())
    hists = materialise(hists.groupBy("node").agg(F.first("n").alias("n"), F.first("hist").alias("hist")), "jaccard-parts")
    search = _Search(texts, hists, t, n)
    stars = groups.select("blob").mapInArrow(lean(_stars(t, lots)), "lot int, pairs binary")
    pairs = search.passing(materialise(stars.groupBy("lot").applyInArrow(_distinct_pairs, "u binary, v binary"), "jaccard-stars"))
    sweep(spark)
    search.fetch(_ends(pairs))
    sweep(spark)
    comp = components(search.verify(pairs))
    sweep(spark)
    # what is left: nodes and the other components of their groups
    linked = comp.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = members.join(linked, "node").select("p", "node", "label")
    meetings = groups.select("p", "blob").groupBy("p").cogroup(labels.groupBy("p")).applyInArrow(_meetings(t, lots), "lot int, pairs binary")
    meetings = materialise(meetings.groupBy("lot").applyInArrow(_distinct_pairs, "u binary, v binary"), "jaccard-meetings")
    sweep(spark)
    roots = comp.select("v").distinct()
    single, many = search.passing(meetings.join(roots, "v", "left_anti")), materialise(meetings.join(roots, "v", "left_semi"), "jaccard-many")
    sweep(spark)
    whole = comp.select(F.col("v").alias("root"), F.col("u").alias("node")).unionByName(roots.select(F.col("v").alias("root"), F.col("v").alias("node")))
    asked = whole.join(many.select(F.col("v").alias("root")).distinct(), "root", "left_semi").select("node")
    search.fetch(_ends(single).union(many.select("u")).union(asked).distinct())
    sweep(spark)
    verified = search.verify(single)
    sweep(spark)
    more = verified.unionByName(search.join(many, whole))
    sweep(spark)
    if more.take(1):
        comp = components(comp.unionByName(more))
    for table in (groups, members, hists, pairs, meetings, single, many, *search.sets):
        discard(table)
    sweep(spark)

    ids = rows.where("node is not null").groupBy("node").agg(F.min("doc").alias("own"))
    comp = comp.select(F.col("u").alias("node"), F.col("v").alias("root"))
    comp = comp.unionByName(comp.select(F.col("root").alias("node"), "root").distinct())
    least = comp.join(ids, "node").groupBy("root").agg(F.min("own").alias("component"))
    comp = comp.join(least, "root").select("node", "component")
    named = ids.join(comp, "node", "left").select("node", F.coalesce("component", "own").alias("component"))
    out = rows.join(named, "node", "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"), "node")


def _member_rows(batches):
    for b in batches:
        for p, blob in zip(b.column("p").to_pylist(), b.column("blob").to_pylist()):
            names = _unpack(blob)[0]
            yield pa.RecordBatch.from_pydict({"p": pa.array([p] * len(names), pa.int32()), "node": pa.array(names, pa.binary())})


def one_of_each(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """The rows of ``docs`` whose id names its component: one document of each group of near copies.

    Repeated rows (equal id and text) stay once. The texts move once, to meet the ids that stay."""
    from pyspark.sql import Window

    comps = jaccard_components(docs, n=n, num=num, den=den)
    stay = comps.where("doc_id <=> component_id").select(F.col("doc_id").alias("_stay")).distinct()
    d = docs.select(F.struct(*docs.columns).alias("row")).alias("d")
    kept = d.join(stay, F.col("d.row.doc_id").eqNullSafe(F.col("_stay")), "left_semi")
    again = F.row_number().over(Window.partitionBy("row.doc_id", "row.text").orderBy(F.lit(1)))
    return kept.withColumn("_again", again).where("_again = 1").select("row.*")
