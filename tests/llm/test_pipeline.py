import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqgrove.llm import queries
from test_operators import DOC, naive_components, naive_targets, prose

pipeline = pytest.importorskip("corpus_pipeline")
duckdb = pytest.importorskip("duckdb")


def test_stages_in_order():
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_copies", "decontamination", "mixing", "token_output"]


def test_pipeline_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(21)
    items = [prose(rng, 20) for _ in range(5)]
    rows, labels = [], []
    for i in range(240):
        kind = i % 6
        t = prose(rng, rng.randint(30, 80))
        if kind == 1:
            t += " idiot scum idiot"
        if kind == 2 and rows:
            t = rows[i - 2][1] + " again"
        if kind == 3:
            t += "\n" + rng.choice(items)
        rows.append((i, t, "en", rng.choice(["a", "b", "c"]), len(t)))
        labels.append((i, 1, int(kind == 1)))
    rows += [(900, None, "en", "a", None), (901, "", None, None, 0)]
    spark.createDataFrame(rows, DOC).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    steps = {}
    for name, stage in pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        steps[name] = docs.collect()
        docs = spark.createDataFrame(steps[name], docs.schema)
        if name != "token_output":
            assert docs.columns == [c.split()[0] for c in DOC.split(", ")]
    kept = {r.doc_id for r in steps["toxicity"]}
    assert kept == {i for i, *_ in rows} - {i for i, _, y in labels if y}
    before = sorted((r for r in steps["toxicity"]), key=lambda r: r.doc_id)
    roots = naive_components([r.text for r in before])
    assert {r.doc_id for r in steps["near_copies"]} == {before[c].doc_id for _, c in roots}
    assert {r.doc_id for r in steps["decontamination"]} == {r.doc_id for r in steps["near_copies"] if not any(x in (r.text or "") for x in items)}
    sizes = {}
    for r in steps["decontamination"]:
        sizes[r.source] = sizes.get(r.source, 0) + len((r.text or "").split())
    want = naive_targets(sizes)
    took = {}
    for r in steps["mixing"]:
        took[r.source] = took.get(r.source, 0) + len((r.text or "").split())
    assert all(abs(took.get(s, 0) - want[s]) <= 90 for s in sizes)
    t = Tokenizer.from_file(queries.tokenizer_path())
    crc = lambda x: zlib.crc32(np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4").tobytes())
    assert sorted((r.doc_id, crc(r.text)) for r in steps["mixing"]) == sorted((r.doc_id, r.ids_crc32) for r in steps["token_output"])
    assert sorted(map(tuple, pipeline.run(spark, str(tmp_path)).collect())) == sorted(map(tuple, steps["token_output"]))


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql(spark, sf, name):
    import os

    from test_queries import canonical

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{f}')")
    got, want = queries.QUERIES[name](spark, sf).toPandas(), con.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and canonical(got) == canonical(want)


def test_every_operator_has_its_query(spark, sf):
    assert sorted(int(n[2:].partition("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert queries.op6_lm_scoring(spark, sf).where(F.col("held_out")).count() > 0
