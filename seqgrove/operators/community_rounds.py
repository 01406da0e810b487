"""Communities of components that are too large for a task: Leiden in bulk-synchronous rounds of joins.

A level moves vertices, refines the communities and contracts the graph to the refined ones, each a DataFrame plan:

* *Moves.* Each vertex finds the neighbouring community of greatest gain. Communities are dealt to two sides by a hash of
  the round, and only moves from the one to the other count, so no community loses and gains vertices at once. A move
  is made if its gain pays for all pairs it may form with others that leave or join the same communities, or
  if it is the best of both: every round that makes moves raises the quality, and while any vertex would gain, some round makes one.
* *Refinement.* Inside each community its vertices start alone, and only vertices that are still alone join others, so
  refined communities are connected.
* *Contraction.* Edges are summed between refined communities, which keep the degrees of their members.

When the contracted graph has few enough edges, the kernel finishes it in one task; communities that are not
connected are split at last, which never lowers the quality. Sums over vertices and communities are partial ones
first, so neither a vertex of very many edges nor a very large community is gathered anywhere.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from seqgrove.operators.components import components
from seqgrove.session import ship
from seqgrove.storage import discard, materialise

EPSILON = 1e-12
#: Rounds of a level: what they leave to gain is gained at the next levels and by the kernel, at last.
MOST_ROUNDS = 10
REFINE_ROUNDS = 4


def _side(c: Column, salt: int) -> Column:
    return F.pmod(F.xxhash64(c, F.lit(salt)), F.lit(2))


def _options(both: DataFrame, vertices: DataFrame, gamma: float, m2: float) -> DataFrame:
    """v, k, own, to, gain, stay: the best neighbouring community of each vertex, and what staying is worth.

    both: (v, u, w), each edge in both directions; vertices: (v, k, own)."""
    totals = vertices.groupBy(F.col("own").alias("to")).agg(F.sum("k").alias("total"))
    there = vertices.select(F.col("v").alias("u"), F.col("own").alias("to"))
    reach = both.join(there, "u").groupBy("v", "to").agg(F.sum("w").alias("w"))
    home = vertices.join(totals.withColumnRenamed("to", "own").withColumnRenamed("total", "home"), "own")
    rows = reach.join(totals, "to").join(home, "v")
    is_own = F.col("to") == F.col("own")
    gain = F.col("w") - gamma * F.col("k") * (F.col("total") - F.when(is_own, F.col("k")).otherwise(0.0)) / m2
    rows = rows.select("v", "k", "own", "home", "to", gain.alias("gain"), is_own.alias("is_own"))
    best = rows.groupBy("v", "k", "own", "home").agg(F.max(F.when(~F.col("is_own"), F.struct("gain", "to"))).alias("best"), F.max(F.when(F.col("is_own"), F.col("gain"))).alias("stay"))
    alone = -gamma * F.col("k") * (F.col("home") - F.col("k")) / m2
    return best.where("best is not null").select("v", "k", "own", "best.to", "best.gain", F.coalesce("stay", alone).alias("stay"))


def _accepted(moves: DataFrame, gamma: float, m2: float) -> DataFrame:
    """(v, to) of the moves (v, k, own, to, delta) that may be made together."""
    first = F.max(F.struct("delta", "v"))
    join = moves.groupBy("to").agg(F.sum("k").alias("joining"), first.alias("first_in"))
    leave = moves.groupBy("own").agg(F.sum("k").alias("leaving"), first.alias("first_out"))
    j = moves.join(join, "to").join(leave, "own")
    pays = F.col("delta") > gamma * F.col("k") / m2 * (F.col("joining") + F.col("leaving") - 2 * F.col("k")) + EPSILON
    best = (F.col("first_in.v") == F.col("v")) & (F.col("first_out.v") == F.col("v"))
    return j.where(pays | best).select("v", "to")


def _moved(vertices: DataFrame, accepted: DataFrame) -> DataFrame:
    return vertices.join(accepted, "v", "left").select("v", "k", F.coalesce("to", "own").alias("own"))


def local_moves(both: DataFrame, vertices: DataFrame, gamma: float, m2: float, rounds: int = MOST_ROUNDS) -> DataFrame:
    """The vertices after rounds of moves: until none would gain, or all rounds are through."""
    for turn in range(rounds):
        want = materialise(_options(both, vertices, gamma, m2).where(F.col("gain") > F.col("stay") + EPSILON).select("v", "k", "own", "to", (F.col("gain") - F.col("stay")).alias("delta")), "moves")
        wanting = want.count()
        if wanting:
            made = _accepted(want.where((_side(F.col("own"), turn) == 0) & (_side(F.col("to"), turn) == 1)), gamma, m2)
            after = materialise(_moved(vertices, made), "vertices")
            discard(vertices)
            vertices = after
        discard(want)
        if not wanting:
            break
    return vertices


def refined(both: DataFrame, vertices: DataFrame, gamma: float, m2: float, rounds: int = REFINE_ROUNDS) -> DataFrame:
    """(v, k, own) with a refined community for each vertex: connected parts of the communities of ``vertices``."""
    c = vertices.select(F.col("v").alias("x"), F.col("own").alias("c"))
    inner = both.join(c.select(F.col("x").alias("v"), F.col("c").alias("a")), "v").join(c.select(F.col("x").alias("u"), F.col("c").alias("b")), "u").where("a = b").select("v", "u", "w")
    inner = materialise(inner, "inner-edges")
    now = materialise(vertices.select("v", "k", F.col("v").alias("own")), "refined")
    for turn in range(rounds):
        alone = now.groupBy("own").agg(F.count("*").alias("n")).where("n = 1").select("own")
        want = _options(inner, now, gamma, m2).join(alone, "own", "left_semi").where(F.col("gain") > F.col("stay") + EPSILON)
        moves = want.select("v", "k", "own", "to", (F.col("gain") - F.col("stay")).alias("delta")).where((_side(F.col("own"), turn) == 0) & (_side(F.col("to"), turn) == 1))
        moves = materialise(moves, "moves")
        after = materialise(_moved(now, _accepted(moves, gamma, m2)), "refined")
        discard(moves)
        discard(now)
        now = after
    discard(inner)
    return now


def _finished(edges: DataFrame, vertices: DataFrame, gamma: float, total: float) -> DataFrame:
    """(v, own) by the kernel, in one task: edges (v, u, w) with v < u, vertices (v, k, own)."""
    from seqgrove.operators.community import leiden

    def solve(_, es, vs):
        vs = vs.sort_values("v")
        names = vs["v"].tolist()
        at = {x: i for i, x in enumerate(names)}
        rows = sorted((at[a], at[b], w) for a, b, w in zip(es["v"], es["u"], es["w"]))
        groups = {c: i for i, c in enumerate(sorted(set(vs["own"])))}
        label = leiden(len(names), rows, gamma, total, vs["k"].tolist(), [groups[c] for c in vs["own"]])
        return pd.DataFrame({"v": names, "own": [names[i] for i in label.tolist()]})

    one = F.lit(0).alias("one")
    return edges.select(one, "v", "u", "w").groupBy("one").cogroup(vertices.select(one, "v", "k", "own").groupBy("one")).applyInPandas(solve, "v string, own string")


def communities_in_rounds(edges: DataFrame, gamma: float, total: float, task_edges: int, levels: int = 20) -> DataFrame:
    """entity, community of every end of ``edges`` (src, dst, weight); total: the weight of the whole graph."""
    ship(edges.sparkSession)
    m2 = 2 * total
    pairs = edges.where("src <> dst").groupBy(F.least("src", "dst").alias("v"), F.greatest("src", "dst").alias("u")).agg(F.sum("weight").alias("w"))
    pairs = materialise(pairs, "level-edges")
    ends = edges.select(F.col("src").alias("v"), "weight").unionByName(edges.where("src <> dst").select(F.col("dst").alias("v"), "weight"))
    vertices = materialise(ends.groupBy("v").agg(F.sum("weight").alias("k")).select("v", "k", F.col("v").alias("own")), "vertices")
    places = materialise(vertices.select(F.col("v").alias("entity"), "v"), "places")  # the vertex of this level that each entity is in
    for level in range(levels):
        size = pairs.count()
        if level and size <= task_edges:
            break
        both = materialise(pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u"), "w")), "both-ways")
        vertices = local_moves(both, vertices, gamma, m2)
        small = refined(both, vertices, gamma, m2)
        part = small.select("v", F.col("own").alias("part"))
        joined = vertices.select("v", "k", "own").join(part, "v")
        above = materialise(joined.groupBy("part").agg(F.sum("k").alias("k"), F.min("own").alias("own")).select(F.col("part").alias("v"), "k", "own"), "vertices")
        moved = pairs.join(part, "v").select("u", F.col("part").alias("a"), "w").join(part.withColumnRenamed("v", "u"), "u").select("a", F.col("part").alias("b"), "w").where("a <> b")
        fewer = materialise(moved.groupBy(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).agg(F.sum("w").alias("w")), "level-edges")
        inside = materialise(places.join(part, "v").select("entity", F.col("part").alias("v")), "places")
        same = above.count() == vertices.count()
        for old in (both, small, vertices, places, pairs):
            discard(old)
        pairs, vertices, places = fewer, above, inside
        if same:
            break
    found = _finished(pairs, vertices, gamma, total) if pairs.count() <= task_edges else vertices.select("v", "own")
    labels = materialise(places.join(found, "v").select("entity", F.col("own").alias("community")), "labels")
    own = lambda v, name: labels.select(F.col("entity").alias(v), F.col("community").alias(name))
    inner = edges.join(own("src", "x"), "src").join(own("dst", "y"), "dst").where("x = y")
    split = components(inner.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return labels.select("entity").join(split.select(F.col("u").alias("entity"), F.col("v").alias("community")), "entity", "left").select("entity", F.coalesce("community", "entity").alias("community"))
