"""A training-data pipeline: quality rules, near-duplicates, source mixing, byte-level BPE."""

from __future__ import annotations

import posixpath
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskweave.llm import bpe, decision_list, files, mixing, queries, simhash
from riskweave.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the learned list keep."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return decision_list.kept_documents(docs, labels, "doc_id", "text")


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    return simhash.kept_documents(docs, "doc_id", "text")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix: file by file and row by row."""
    return mixing.in_mixed_order(docs, "doc_id", "source", queries.TARGET_WEIGHTS, queries.OTHER_WEIGHT)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of ids of each document, digests of the ids and of the bytes they decode to, position.

    Spark reads files packed by size, so the sequence of the mix is taken from the files: ``position``
    counts from 0 over the files in order and the rows in each. It is null for documents that do not
    come straight from files. The texts are not shuffled for it.
    """
    path = public_tokenizers.path(queries.RANK_FILE)
    file, row = "_file", "_file_row"
    placed = files.with_file_rows(docs.select("doc_id", "text"), file, row)
    starts = files.file_starts(placed, file, "_start")
    encoded = bpe.round_trip(placed, "doc_id", "text", path, public_tokenizers.PATTERN, (file, row))
    return encoded.join(starts, file, "left").select(
        "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", (F.col("_start") + F.col(row)).alias("position")
    )


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_duplicates", one_of_each),
    ("source_mixing", mix),
    ("byte_level_bpe", encode),
]

#: Learned rules, XXH64 fingerprints and BPE are beyond SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = posixpath.join(shared_folder(spark), "pipeline", uuid.uuid4().hex)
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
