"""A training-corpus pipeline over `documents`: five operators, each stage written and read again."""

from __future__ import annotations

import posixpath
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from cloudloom.llm import bpe, decontam, langid, linededup, simhash
from cloudloom.llm.common import shared_dir, table
from cloudloom.llm.queries import BYTE_BPE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled documents teach; null texts, texts without a letter and those of which the model knows no word or n-gram go."""
    return langid.keep_known(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; so do documents that lose all their lines."""
    return linededup.clean(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays."""
    return simhash.keep_first(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def bpe_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the ids and of the text decoded from them."""
    return bpe.digest(docs, public_tokenizers.path(BYTE_BPE))


STAGES = [
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("BPE encoding and decoding", bpe_encoding),
]

#: SQL cannot express the first stage's model; tests/llm hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over sf_dir's documents; each stage is written to the shared folder and read again.

    Defined cases: null, empty and letterless texts go in the first stage; empty tables give no rows; other columns, whatever
    their names, pass all stages but the last; rows that repeat an id are kept or dropped together by the near-dedup.
    """
    base = posixpath.join(shared_dir(spark), "cloudloom", uuid.uuid4().hex)
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out.write.parquet(f"{base}/stage{k}")
        docs = spark.read.schema(out.schema).parquet(f"{base}/stage{k}")
    return docs
