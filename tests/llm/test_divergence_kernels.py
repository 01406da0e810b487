import random

from pyspark.sql import functions as F

from seqgrove.llm import source_divergence as audit


def test_shares_and_sums_are_exact_at_the_edges_of_64_bits(spark):
    s = audit.Settings()
    edge = ((1 << 63) - 1) // s.scale - s.added
    counts = [(c, t, k) for c in (0, 1, edge - 1, edge, edge + 1, 10**15) for t in (0, 7, 10**12, 1 << 61, (1 << 61) + 1) for k in (1, 10**9) if c <= t]
    found = spark.createDataFrame(counts, "c bigint, t bigint, k bigint").select("c", "t", "k", audit.share(F.col("c"), F.col("t"), F.col("k"), s).alias("p"))
    assert [r.p for r in found.collect()] == [1 + s.scale * (c + s.added) // (t + k * s.added) for c, t, k in counts]
    rng = random.Random(3)
    values = [rng.randint(-2 * 10**18, 2 * 10**18) for _ in range(300)] + [2 * 10**18] * 50 + [-1, 0]
    summed = spark.createDataFrame([(v,) for v in values], "v bigint").agg(*audit.halves(F.col("v"), "x")).select(audit.joined("x").alias("v")).first()["v"]
    assert int(summed) == sum(values) > 1 << 63
