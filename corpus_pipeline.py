"""The corpus pipeline: five stages over ``documents``, each written as Parquet and reread by the next.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor kept. All but the last
return the columns of ``documents``, further ones included, whatever their names.

Defined cases. Null and empty texts: scored by the intercept (kept), near copies of nothing, without test items, without words (once
in the mix), the end id alone. Repeated rows: the first stage keeps each, the second one of them. Null ids: rows of one
null id and text are one document. Null sources are a source, the last. Ties of near copies: the smallest id stays; ties of mixing
keys: by id, then size. Very long texts are read whole by all stages. Empty tables: no rows; without labels of both
classes no document is toxic unless the prior is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqgrove.llm import decontaminate, jaccard_join, mixing, token_output, toxicity
from seqgrove.llm.common import materialise
from seqgrove.llm.queries import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents that the classifier rejects go. It learns from the labels of other folds."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.fit(docs, labels, toxicity.held_out_rows(F.col("doc_id")))
    scored = toxicity.score(docs, model, keep=tuple(docs.columns), text_col="text")
    return scored.where(F.col("score") < model.threshold).select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: one document of each group of near copies stays, the one with the smallest id."""
    return jaccard_join.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: documents that hold a test item go."""
    return decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 5: each document as often as its source's budget takes it."""
    return mixing.mixed_documents(docs)


def write_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: token ids in the binary format, read back: a row a document of the mix."""
    return token_output.tokens_of(docs, tokenizer_path())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("token_output", write_ids),
]

#: The classifier, the edit matching and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
