"""Training-data pipeline: five stages over the documents, each made of one operator of ``sowmill.llm``.

A stage takes the session, the documents that the stage before it kept and the
folder of the tables, and returns documents with the same columns; the last
one returns packed pieces. ``run`` applies them in turn and writes what each
stage keeps, so that a stage reads its input instead of computing it again.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sowmill.llm import decontaminate, packing, secrets, similar, toxicity
from sowmill.llm.common import table, work_folder


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression distances do not call toxic; trained on the labelled ones among them."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are 80 per cent alike, the one with the smallest id; documents without words or id stay."""
    return similar.one_of_each(docs, shingle=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mask in place of secrets."""
    return secrets.redact_secrets(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of windows of 2048 tokens, with the checksum of their ids."""
    return packing.piece_digest(packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json")))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_benchmark), ("secrets", mask_secrets),
          ("packing", pack_sequences)]

#: Trained dictionaries, fingerprints and token ids are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents that pass every stage."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{work_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
