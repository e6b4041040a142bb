"""A corpus pipeline of five stages: from the documents table to encoded, clean, deduplicated, mixed documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and reread as the docs of the
next one. All but the last return the columns of documents. No stage is cut short: each works on all that its predecessor
kept, and its decisions take effect.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm.bpe import bpe_round_trip
from larkspur.llm.common import documents, ensure_checkpoint_dir
from larkspur.llm.mixing import mix
from larkspur.llm.ngram_join import drop_near_copies
from larkspur.llm.secrets import redact_secrets
from larkspur.llm.toxicity import drop_toxic

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return drop_toxic(docs.select(COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked documents stays; links are similarities of 0.8 on shingles of five words."""
    return drop_near_copies(docs.select(COLUMNS), size=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the texts, and n_chars counts the new ones; every document stays."""
    kind = docs.schema["n_chars"].dataType
    return redact_secrets(docs.select(COLUMNS)).withColumn("n_chars", F.length("text").cast(kind))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are sampled by calibrated probabilities."""
    return mix(docs.select(COLUMNS)).where("mix_kept").select(COLUMNS)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of what is left."""
    return bpe_round_trip(docs.select(COLUMNS))


STAGES = [("toxicity", toxicity), ("near copies", near_copies), ("secrets", secrets), ("mixing", mixing), ("encoding", encoding)]

#: SQL can express neither the classifier nor the field nor the encoder; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what lies between is written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/corpus-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
