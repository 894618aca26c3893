"""A corpus pipeline: each stage reads what its predecessor kept, written as Parquet.

toxic documents go; of near copies one stays; documents that hold benchmark passages go;
secrets are masked; the last stage encodes and decodes the texts that remain.

Defined cases: null and empty texts pass every stage (null stays null up to the last, which
encodes it as empty); rows without doc_id stay in near_dedup; rows that share a doc_id are
judged by their own texts, but in near_dedup stay or go together; extra columns, whatever their
names, are passed on up to the last stage; an empty table of documents, labels or benchmark
items makes the stages that read it keep everything, and an empty corpus gives no rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import bpe_transducer, golay_simhash, latent_decontamination, secret_index, toxicity_trees
from quillgraph.llm.common import discard, free, saved

#: SQL cannot express these stages; tests/llm/test_pipeline.py runs them against slow versions.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold."""
    model = toxicity_trees.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    name = free("toxicity_score", docs.columns)
    return toxicity_trees.score(docs, model, docs.columns, name=name).where(F.col(name) < toxicity_trees.THRESHOLD).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of least doc_id; those without doc_id stay."""
    return golay_simhash.representatives(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return latent_decontamination.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    return secret_index.masked(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the decoded text."""
    # the workers still hold what earlier stages took: a quarter of the usual memos
    return bpe_transducer.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, bpe_transducer.MOST_STATES // 4)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("secrets", mask_secrets),
    ("byte_bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs, f"stage-{name}")
            if before is not None:
                discard(before)  # all that read it is written
            before = docs
    return docs
