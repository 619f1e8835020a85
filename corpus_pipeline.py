"""A corpus pipeline of five stages, each written as Parquet and read again as the next one's documents.

Language ID drops what it rejects, near-duplicates keep one document of each
group, personal data is replaced in the text, sources are mixed to their target
weights in training order, and byte-level BPE encodes the texts.

Each stage takes documents(doc_id, text, source and any other columns) and all
but the last return the same columns. Rows with nulls: a null text goes at the
first stage, like one without a letter; where a later stage is run alone, a null
text has no shingle and stays, holds no personal data, is mixed once with no
words, and encodes to no ids. A null doc_id is nobody's duplicate and stays. A
null lang is no example; a null source is one source like others. Repeated rows,
equal in doc_id, leave one at the second stage. Texts may be of any length, and
an empty table stays empty.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from faultline.llm import bpe, language_id, minhash_dedup, mixing, pii
from faultline.llm.common import shared_folder
from faultline.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; null texts, texts without a letter and those between two languages go."""
    return language_id.keep_identified(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group that 0.8 similar sets of five-word shingles link; empty and null texts are in no group."""
    return minhash_dedup.keep_one(docs)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data and secrets in its text replaced by their kind in brackets; null texts stay null."""
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in training order, repeated or left out so that each source's words come near its target."""
    return mixing.laid_out(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document without its text, with n_tokens, ids, ids_sha256 and decoded_sha256; a null text has no ids."""
    return bpe.encode(docs, tokenizer_path()).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_duplicates),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: Compression and merges have no SQL; the tests run the stages on documents of their own and compare each with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; what lies between them goes to the folder that the cluster shares."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
