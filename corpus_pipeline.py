"""From documents to training ids: toxic documents go, one document of each near-duplicate group stays, secrets are
replaced, sources are mixed to their target weights, and what is left is encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. All but the last return the
columns of documents; the last returns the ids in training order.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gablework.llm import bpe, mixing, secret_scan, simhash, toxicity
from gablework.llm.common import written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those whose toxicity reaches the threshold, by a model of the labels outside the held-out fold.

    Null and empty texts are clean; null and repeated ids stay; all columns come back as they were; an empty table, or
    labels of one kind only, rejects nothing.
    """
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.clean_documents(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with one document, that of the smallest id, of each group that five-word shingle sets of a similarity of 0.8 or more join.

    Null and wordless texts are copies of each other; of rows that repeat an id one stays; rows of a null id all stay;
    all columns come back as they were; an empty table gives no rows.
    """
    return simhash.kept_documents(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs with the secrets in text replaced by a mark; no row goes. Null texts stay null; an empty table gives no rows."""
    return secret_scan.redacted_documents(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs as the mix takes them, in training order: each as often as it is taken, at most twice; one document of a source may be cut.

    A null source is a source; null and wordless texts come once; null and repeated ids are rows of their own; an empty
    table gives no rows.
    """
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows (doc_id, n_tokens, ids, whole) of docs, in their order. Null and empty texts have no ids; an empty table gives no rows."""
    return bpe.encoded(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", reject_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

#: Trained scores, fingerprints and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
