"""Documents to encoded training text: language ID, near-duplicates, secrets, mixing, SentencePiece."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from weekloom.llm import langid, mixing, secret_scan, simhash, spm_codec
from weekloom.llm.common import checkpoint_dir
from weekloom.llm.queries import reachable


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; the others go."""
    reachable(spark)
    return langid.accepted(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: that of the smallest doc_id."""
    reachable(spark)
    return simhash.keep_one(docs)


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets masked."""
    reachable(spark)
    return secret_scan.redacted(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return mixing.mixed(docs)


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document's text, to train on, and digests of ids, spans and decoding. Copies that the mix made
    lie side by side, so that each text is encoded once."""
    reachable(spark)
    return spm_codec.digests(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("secret_redaction", secret_redaction),
    ("source_mixing", source_mixing),
    ("sentencepiece_encoding", sentencepiece_encoding),
]

#: Language models, SimHash links and token ids are beyond SQL; tests/llm holds the pipeline against brute force.
ORACLE_SQL = None


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. Each result is written to the shared folder and read again by the next stage; that of
    a stage is deleted when the next one's is complete. The last one that is written stays: the rows returned read it."""
    reachable(spark)
    home = f"{checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{home}/{k}-{name}")
        docs = spark.read.parquet(f"{home}/{k}-{name}")
        if k:
            _delete(spark, f"{home}/{k - 1}-{STAGES[k - 1][0]}")
    return STAGES[-1][1](spark, docs, sf_dir)
