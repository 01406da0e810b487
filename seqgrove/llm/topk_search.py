"""Exact top-k search by a Voronoi kNN join.

Pivots (a bounded sample of the data, more of them for more rows) cut the space into cells, and distances to a cell's pivot cut
it into rings; rings of many rows are dealt to blocks by a hash. A summary row a ring holds its rows, the greatest distance
to the pivot, the least cosine to it and the range of lengths. Queries belong to the cell of their own
nearest pivot and are solved there first, by one matrix product a block. That gives each query a true lower bound of its
k-th best score. For every other ring the summaries bound the scores it can hold:
``q.x <= q.p + |q| r`` (Cauchy-Schwarz), and ``q.x <= |q| |x| cos(angle(q, p) - greatest angle(p, x))``. A query goes to
the rings that reach its bound and to no other, so only necessary rows are compared; of queries and rows the
smaller side, the queries, is what is copied. ``shares`` tells how much was necessary: where nothing is near anything, as
for random vectors of many dimensions, no bound on distances excludes a cell, and all of them are.

Defined cases: vectors that are null or hold null or non-finite components take no part; vectors of
different lengths are compared as if filled with zeros; ties go to the smaller id; rows with the query's
id are the query's own; repeated rows are candidates each, and repeated queries are asked once; queries of one id
and different vectors have their best each; components of any finite size are taken, and ranks follow the exact scores (up to 2**124,
beyond which they count as that); a score that a long can't hold is shown as the nearest long; empty tables give no rows; further
columns are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, lean, materialise


HUGE = float(np.finfo(np.float64).max)


def _packed(whole: np.ndarray) -> bytes:
    """Whole numbers as 32-bit integers, or where they don't fit as doubles, which hold every floor exactly, and a byte more."""
    return whole.astype(np.int32).tobytes() if (np.abs(whole) < 2**31).all() else whole.astype("<f8").tobytes() + b"d"


def _unpacked(vec: bytes) -> np.ndarray:
    return np.frombuffer(vec, "<f8", len(vec) // 8) if len(vec) & 3 else np.frombuffer(vec, np.int32)


def _quantised(scale: int):
    def run(batches):
        for b in batches:
            ids, vecs = [], []
            for i, v in zip(b.column("id").to_pylist(), b.column("v").to_pylist()):
                if i is None or v is None or any(x is None for x in v):
                    continue
                a = np.asarray(v, dtype=np.float64)
                if np.isfinite(a).all():
                    ids.append(i)
                    vecs.append(_packed(np.floor(np.clip(scale * a, -HUGE, HUGE))))
            yield pa.RecordBatch.from_pydict({"id": pa.array(ids, pa.int64()), "vec": pa.array(vecs, pa.binary())})

    return run


def quantise(vectors: DataFrame, id_col: str, vec_col: str, scale: int = 256) -> DataFrame:
    """id, vec: floor(scale * x) of every component, packed, valid vectors only."""
    return vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vec_col).alias("v")).mapInArrow(lean(_quantised(scale)), "id bigint, vec binary")


def _matrix(vecs, dim: int = 0) -> np.ndarray:
    rows = [_unpacked(x) for x in vecs]
    dim = max([dim, *map(len, rows)], default=dim)
    if all(len(r) == dim for r in rows):
        return np.stack(rows).astype(np.float64) if rows else np.zeros((0, dim))
    out = np.zeros((len(rows), dim))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _placed(pivots):
    """Adds the nearest pivot, the distance to it, the cosine to it and the length."""

    def run(batches):
        np.seterr(over="ignore", invalid="ignore")
        p = pivots.value
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("vec").to_pylist(), p.shape[1])
            pp = np.pad(p, ((0, 0), (0, x.shape[1] - p.shape[1])))
            size = (pp * pp).sum(1)
            d2 = (x * x).sum(1)[:, None] - 2 * x @ pp.T + size
            cell = d2.argmin(1)
            near = pp[cell]
            dist, norm = np.sqrt(((x - near) ** 2).sum(1)), np.sqrt((x * x).sum(1))
            dist[~np.isfinite(norm) | ~np.isfinite(size[cell])] = np.nan  # no bound: such a ring is always looked into
            cos = np.clip((x * near).sum(1) / np.maximum(norm * np.sqrt(size[cell]), 1e-300), -1, 1)
            yield pa.RecordBatch.from_pydict({"id": b.column("id"), "vec": b.column("vec"), "cell": pa.array(cell.astype(np.int32)), "dist": pa.array(dist), "cos": pa.array(cos), "norm": pa.array(norm)})

    return run


@dataclass
class Rings:
    """Summaries: a row a ring."""

    cell: np.ndarray
    ring: np.ndarray
    radius: np.ndarray
    cos: np.ndarray
    low: np.ndarray
    high: np.ndarray
    blocks: np.ndarray

    def best_scores(self, q: np.ndarray, p: np.ndarray) -> np.ndarray:
        """No score of a query (row) with a vector of a ring (column) is greater."""
        pivots = p[self.cell]
        dot, norm = q @ pivots.T, np.sqrt((q * q).sum(1))[:, None]
        away = np.arccos(np.clip(dot / np.maximum(norm * np.sqrt((pivots * pivots).sum(1)), 1e-300), -1, 1)) - np.arccos(self.cos)
        cos = np.cos(np.clip(away, 0, None))
        bound = np.minimum(dot + norm * self.radius, norm * np.where(cos > 0, self.high, self.low) * cos)
        return bound + 1e-6 * (1 + np.abs(dot) + norm * self.high)


def _routed(pivots, rings):
    """One row for each query and each block of each ring outside its cell that may hold one of its best."""

    def run(batches):
        np.seterr(over="ignore", invalid="ignore")
        p, r = pivots.value, rings.value
        for b in batches:
            if not b.num_rows:
                continue
            q = _matrix(b.column("vec").to_pylist(), p.shape[1])
            pp = np.pad(p, ((0, 0), (0, q.shape[1] - p.shape[1])))
            least = b.column("least").to_numpy(zero_copy_only=False).astype(float)[:, None]
            need = ~(r.best_scores(q, pp) < least) & (r.cell != b.column("cell").to_numpy()[:, None])
            i, c = np.nonzero(need)
            n = r.blocks[c]
            ii, cc = np.repeat(i, n), np.repeat(c, n)
            part = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            take = pa.array(ii)
            yield pa.RecordBatch.from_pydict({"id": b.column("id").take(take), "vec": b.column("vec").take(take), "cell": pa.array(r.cell[cc].astype(np.int32)), "ring": pa.array(r.ring[cc].astype(np.int32)), "part": pa.array(part.astype(np.int32))})

    return run


#: Scores travel as two longs, high * 2**62 + low, and beyond FAR as FAR.
HALF, FAR = 62, 2**124


def _scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact inner products: by doubles or 64 bits where these hold all sums, else pair by pair with whole numbers of any size."""
    size = lambda a: np.maximum(np.abs(a).max(axis=1, initial=0), 1)
    most = np.outer(size(q), size(x) * max(q.shape[1], 1))
    if most.max(initial=0) < 2**53:
        return (q @ x.T).astype(np.int64)
    if most.max() < 2**62:
        return q.astype(np.int64) @ x.astype(np.int64).T
    out = np.empty(most.shape, object)
    small = most < 2**53
    with np.errstate(over="ignore", invalid="ignore"):
        out[small] = (q @ x.T)[small].astype(np.int64).tolist()
    whole_q, whole_x = ([[int(v) for v in row] for row in m] for m in (q, x))
    for i, j in np.argwhere(~small):
        out[i, j] = max(-FAR, min(FAR, sum(a * b for a, b in zip(whole_q[i], whole_x[j]))))
    return out


def _best(q_ids, q, x_ids, x, k: int):
    """The k best of x for each q, ties to the smaller id, the query's own id left out."""
    order = np.argsort(x_ids, kind="stable")
    s, x_ids = _scores(q, x)[:, order], x_ids[order]
    for i in range(len(q_ids)):
        ok = x_ids != q_ids[i]
        row, xs = s[i][ok], x_ids[ok]
        if len(row) > k:
            cut = np.sort(row)[-k] if row.dtype == object else np.partition(row, len(row) - k)[len(row) - k]
            pick = np.flatnonzero(row >= cut)
            pick = pick[np.argsort(-row[pick], kind="stable")][:k]
        else:
            pick = np.argsort(-row, kind="stable")
        yield i, q_ids[i], xs[pick].tolist(), row[pick].tolist()


def _solve(k: int, chunk: int):
    def run(key, queries, data):
        cols: tuple[list, list, list, list] = ([], [], [], [])
        if len(queries) and len(data):
            x = _matrix(data["vec"])
            for i in range(0, len(queries), chunk):
                some = queries.iloc[i : i + chunk]
                q = _matrix(some["vec"], x.shape[1])
                wide = np.pad(x, ((0, 0), (0, q.shape[1] - x.shape[1])))
                for row, own, best, score in _best(some["id"].to_numpy(), q, data["id"].to_numpy(), wide, k):
                    cols[0].extend([own] * len(best))
                    cols[1].extend([some["vec"].iloc[row]] * len(best))
                    cols[2].extend(best)
                    cols[3].extend(score)
        whole = lambda xs: pd.Series(xs, dtype="int64")
        low = (1 << HALF) - 1
        return pd.DataFrame({"query_id": whole(cols[0]), "query": pd.Series(cols[1], dtype=object), "vec_id": whole(cols[2]), "high": whole([v >> HALF for v in cols[3]]), "low": whole([v & low for v in cols[3]])})

    return run


FOUND = "query_id bigint, query binary, vec_id bigint, high bigint, low bigint"
#: Rings of a cell, by quarters of its rows.
QUARTERS = (0.25, 0.5, 0.75)


def _as_long(high: Column, low: Column) -> Column:
    """high * 2**62 + low, or the nearest long."""
    least = F.lit(-(2**63))
    return F.when(high >= 2, F.lit(2**63 - 1)).when(high < -2, least).when(high == -2, least + low).when(high == -1, low - F.lit(2**HALF)).when(high == 0, low).otherwise(low + F.lit(2**HALF))


def pivot_count(rows: int) -> int:
    """As many as cells have rows, in bounds that a broadcast can take."""
    return int(min(1024, max(64, rows**0.5)))


class Search:
    """The plan and, once run, what it compared."""

    def __init__(self, vectors: DataFrame, queries: Column, k: int, id_col: str, vec_col: str, scale: int, pivots: int | None, block_rows: int, query_rows: int):
        spark = vectors.sparkSession
        bounded_batches(spark)
        self.spark, self.k, self.query_rows = spark, k, query_rows
        ints = materialise(quantise(vectors, id_col, vec_col, scale), "knn-vectors")
        self.rows = ints.count()
        chosen = ints.select("id", "vec").orderBy(F.xxhash64("id"), "id", "vec").limit(pivots or pivot_count(self.rows)).collect()
        if not chosen:
            self.result = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
            return
        sc = spark.sparkContext
        p = sc.broadcast(_matrix(dict.fromkeys(bytes(r["vec"]) for r in chosen)))
        placed = materialise(ints.mapInArrow(lean(_placed(p)), "id bigint, vec binary, cell int, dist double, cos double, norm double"), "knn-cells")
        # at most four rows a pivot from here to the driver
        cuts = placed.groupBy("cell").agg(F.percentile_approx("dist", list(QUARTERS), 1000).alias("cuts"))
        ringed = placed.join(cuts, "cell").withColumn("ring", F.size(F.filter("cuts", lambda c: c < F.col("dist")))).drop("cuts")
        self.data = materialise(ringed, "knn-rings")
        told = self.data.groupBy("cell", "ring").agg(F.count("*").alias("n"), F.max("dist").alias("radius"), F.min("cos").alias("cos"), F.min("norm").alias("low"), F.max("norm").alias("high")).orderBy("cell", "ring").collect()
        of = lambda c: np.array([r[c] for r in told])
        self.rings = Rings(*[of(c) for c in ("cell", "ring", "radius", "cos", "low", "high")], -(-of("n") // block_rows))
        self.sizes = of("n")
        asked = self.data.where(queries).dropDuplicates(["id", "vec"])
        summary = sc.broadcast(self.rings)
        blocks = spark.createDataFrame([(int(c), int(g), int(n)) for c, g, n in zip(self.rings.cell, self.rings.ring, self.rings.blocks)], "cell int, ring int, parts int")
        self.data = self.data.join(blocks, ["cell", "ring"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).cast("int"))
        # first at home
        places = blocks.select("cell", "ring", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        self.home = asked.select("id", "vec", "cell").join(places, "cell")
        near = materialise(self._solved(self.home), "knn-home")
        about = F.col("high").cast("double") * 2.0**HALF + F.col("low").cast("double")
        best = near.groupBy(F.col("query_id").alias("id"), F.col("query").alias("vec")).agg(F.sort_array(F.collect_list(about), False).alias("s"))
        least = F.when(F.size("s") >= k, F.element_at("s", k))
        asked = asked.join(best.select("id", "vec", least.alias("least")), ["id", "vec"], "left").select("id", "vec", "cell", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
        self.away = materialise(asked.mapInArrow(lean(_routed(p, summary)), "id bigint, vec binary, cell int, ring int, part int"), "knn-queries")
        found = near.unionByName(self._solved(self.away))
        rank = F.row_number().over(Window.partitionBy("query_id", "query").orderBy(F.desc("high"), F.desc("low"), "vec_id"))
        self.result = found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", _as_long(F.col("high"), F.col("low")).alias("score"))

    def _solved(self, asked: DataFrame) -> DataFrame:
        """Queries and rows of a block meet; many queries of a block are dealt to several lots."""
        keys = ["cell", "ring", "part", "lot"]
        lots = asked.groupBy("cell", "ring", "part").agg(F.ceil(F.count("*") / self.query_rows).cast("int").alias("lots"))
        left = asked.join(lots, keys[:3]).withColumn("lot", F.pmod(F.xxhash64("id", "vec"), F.col("lots")).cast("int")).select(*[F.col(c).alias(c) for c in ("id", "vec", *keys)])
        right = self.data.join(lots, keys[:3]).withColumn("lot", F.explode(F.sequence(F.lit(0), F.col("lots") - 1))).select(*[F.col(c).alias(c) for c in ("id", "vec", *keys)])
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_solve(self.k, 512), FOUND)

    def shares(self) -> dict[str, float]:
        """Of all pairs of a query and a ring, and of a query and a row: the shares that were compared."""
        size = {(int(c), int(g)): int(n) for c, g, n in zip(self.rings.cell, self.rings.ring, self.sizes)}
        asked = self.home.select("id", "vec").distinct().count()
        met = self.home.select("id", "vec", "cell", "ring").unionByName(self.away.select("id", "vec", "cell", "ring")).distinct().groupBy("cell", "ring").count().collect()
        return {"rings": sum(r["count"] for r in met) / (asked * len(size)), "rows": sum(r["count"] * size[r["cell"], r["ring"]] for r in met) / (asked * self.rows)}


def top_k(vectors: DataFrame, queries: Column, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256, pivots: int | None = None, block_rows: int = 8192, query_rows: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, score: the k largest inner products of every row for which ``queries`` (a
    condition on ``id``) holds, against all other rows.

    pivots bounds what is broadcast (pivots * dimensions numbers and four summary rows a cell); None: ``pivot_count``."""
    return Search(vectors, queries, k, id_col, vec_col, scale, pivots, block_rows, query_rows).result
