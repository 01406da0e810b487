import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqgrove.llm import topk_search, toxicity
from test_operators import DOC, documents, prose

pipeline = pytest.importorskip("corpus_pipeline")


def brute_top(vectors, asked, k):
    whole = {i: [int(np.floor(256 * np.float64(x))) for x in v] for i, v in vectors}
    out = {}
    for q in asked:
        found = sorted((-sum(a * b for a, b in zip(whole[q], whole[x])), x) for x in whole if x != q)
        out |= {(q, r + 1): (x, max(-(2**63), min(2**63 - 1, -s))) for r, (s, x) in enumerate(found[:k])}
    return out


# 1e7 passes 32 bits, 1e12 and more 64 bits of a product, 1e200 the doubles' range of products
@pytest.mark.parametrize("size", [1e7, 1e9, 1e12, 1e15, 1e200])
def test_top_k_of_large_components(spark, size):
    rng = random.Random(9)
    vectors = [(i, [rng.uniform(-1, 1) * (size if rng.random() < 0.3 else 1) for _ in range(4)]) for i in range(120)]
    vectors += [(200, [1.0, 0.0]), (201, [1e7, 0.0]), (202, [2.0, 0.0])]
    d = spark.createDataFrame(vectors, "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_search.top_k(d, F.col("id") % 10 == 0, pivots=7).collect()}
    want = brute_top(vectors, [i for i, _ in vectors if i % 10 == 0], 5)
    if size < 1e200:
        assert got == want
    else:  # beyond 2**124 scores are alike; what is shown is the nearest long
        assert {k: s for k, (_, s) in got.items()} == {k: s for k, (_, s) in want.items()}


def test_top_k_order_beyond_longs(spark):
    d = spark.createDataFrame([(0, [1e12]), (1, [1e12]), (2, [2e12]), (3, [-1e12]), (4, [-3e12])], "vec_id bigint, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk_search.top_k(d, F.col("id") == 0).orderBy("rank").collect()]
    assert got == [(2, 2**63 - 1), (1, 2**63 - 1), (3, -(2**63)), (4, -(2**63))]


CLASHING = ("score", "_text", "_stay", "h1", "keep_h1", "size", "row", "epochs", "times", "item", "key", "target", "source_size", "_again", "bucket")


def test_toxicity_equals_brute_force_and_keeps_any_names(spark):
    rng = random.Random(4)
    texts = [prose(rng, 12) + (" idiot scum" if i % 4 == 0 else "") for i in range(300)] + [None, "", "Idiot " * 30_000]
    d = documents(spark, texts)
    for c in CLASHING:
        d = d.withColumn(c, F.lit(c))
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(300)], "doc_id bigint, toxic int")
    model = toxicity.fit(d, labels)
    got = toxicity.score(d, model, keep=tuple(d.columns)).select("row.*", F.col("score").alias("its")).collect()
    for r in got:
        w = model.weights
        z = model.intercept + sum(w[f] for f in toxicity.features(toxicity.words((r.text or "").encode())) if f in w)
        assert r.its == pytest.approx(1 / (1 + np.exp(-max(-30, min(30, z)))), abs=1e-12) and all(r[c] == c for c in CLASHING)
    assert len(got) == len(texts)


def tables(spark, path, rows, labels, items, extra=()):
    docs = spark.createDataFrame(rows, DOC)
    for c in extra:
        docs = docs.withColumn(c, F.lit(c))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")


def test_pipeline_keeps_clashing_columns(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, prose(rng, 40) + (" idiot scum" if i % 5 == 0 else ""), "en", rng.choice("ab"), 1) for i in range(60)]
    rows += rows[1:4] + [(None, None, None, None, None)] * 2 + [(70, "", None, None, None), (71, prose(rng, 30_000), "en", "a", 1)]
    tables(spark, str(tmp_path), rows, [(i, 1, int(i % 5 == 0)) for i in range(60)], [(1, prose(rng, 12))], CLASHING)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    sizes = []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert all(r[c] == c for r in rows for c in CLASHING)
        sizes.append(len(rows))
        docs = spark.createDataFrame(rows, docs.schema)
    # 12 toxic rows go; then three repeated rows and one of two rows of no id
    assert sizes[0] == 55 and sizes[1] == sizes[2] == 51
    assert pipeline.run(spark, str(tmp_path)).count() == sizes[-1]


def test_pipeline_of_empty_tables(spark, tmp_path):
    tables(spark, str(tmp_path), [], [], [])
    assert pipeline.run(spark, str(tmp_path)).collect() == []
