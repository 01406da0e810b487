import random

import pytest
from pyspark.sql import functions as F

from seqgrove.llm import queries, token_counts
from test_operators import DOC, documents

ODD = [" ", "  ", "\n", "\t", "▁", "a", "b", "the", "Ing", "1", "23", ".", "...", "--", "é", "中", "文字", "漢", "😀", "\0", "<s>", "</s>", "<unk>", "<0x0A>", "ß", "при", "가", "́", "‍", "ｆ", "\xa0", "　", "\r\n", "====", "(", ");", "a" * 40, "é" * 17]


def whole(texts):
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=queries.tokenizer_path("piece_bpe_32k.model"))
    return [len(sp.encode(t or "")) for t in texts]


# all held; few held, small lots and slices; none held
@pytest.mark.parametrize("settings", [token_counts.Settings(), token_counts.Settings(held_bytes=2000, lot=50, slice_chars=100), token_counts.Settings(held_bytes=0, lot_bytes=100)])
def test_token_counts_equal_the_library(spark, settings):
    rng = random.Random(3)
    texts = [None, "", " ", "▁", "\n", "é" * 17, "a" * 40, *("".join(rng.choices(ODD, k=rng.randint(1, 60))) for _ in range(800)), "".join(rng.choices(ODD, k=100_000)), "x" * 50_000] * 2
    d = documents(spark, texts).withColumn("n_tokens", F.lit("x")).withColumn("id", F.lit(0)).withColumn("key", F.lit(b"k")).withColumn("row", F.lit(1))
    got = token_counts.token_counts(d, queries.tokenizer_path("piece_bpe_32k.model"), settings).orderBy("doc_id").collect()
    assert [(r.n_tokens, r.n_bytes) for r in got] == [(n, len((t or "").encode())) for n, t in zip(whole(texts), texts)]


def test_token_counts_repeated_and_empty(spark):
    path = queries.tokenizer_path("piece_bpe_32k.model")
    rows = spark.createDataFrame([(None, "a b"), (None, "a b"), (1, None), (1, "a b"), (1, "a b")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts.token_counts(rows, path).collect()) == [(0, 2), (0, 2), (1, 0), (1, 2), (1, 2)]
    assert token_counts.token_counts(documents(spark, []).limit(0), path).collect() == []


def test_query_equals_the_library(spark, sf):
    texts = spark.read.parquet(f"{sf}/documents.parquet").select(*[c.split()[0] for c in DOC.split(", ")]).orderBy("doc_id").collect()
    got = queries.op13_token_counts(spark, sf).orderBy("doc_id").collect()
    assert [(r.doc_id, r.n_tokens, r.over_limit) for r in got] == [(t.doc_id, n, n > 4096) for t, n in zip(texts, whole(t.text for t in texts))]
