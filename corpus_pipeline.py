"""From raw documents to token counts: filter by quality, drop copies and near-copies, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's docs. All stages but the last return the columns of documents, and any further ones, whatever their names.

Defined cases, in every stage: null text counts as empty; an empty table gives an empty result; rows without an
identifier take part, and are told apart by their text; of repeated rows one passes the stages that drop copies; very
long texts are handled whole; which of equal rows passes is decided by hashes, so reruns agree.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, exact_dedup, jaccard_join, mixing, quality
from gleaner.llm.shared import drop, stored


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, fitted on the labels, doesn't reject; without labels none is. Empty texts are scored like others."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = quality.train(docs, labels)
    return quality.accepted(docs, model)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that is equal but for white space: the longest, then of the smallest identifier. Empty texts are one group."""
    return exact_dedup.keep_one(docs, stored(exact_dedup.decide(docs), "pipeline-copies"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each connected group of near-copies: the smallest identifier, a null one last. Empty texts are one group."""
    return jaccard_join.keep_one(docs, jaccard_join.join(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: never, once or twice; those without words never. A null source is a source of its own."""
    return mixing.apply_mix(docs, stored(mixing.decide(docs), "pipeline-mix"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the encoded and decoded documents, a row for each time the mix takes one."""
    encoded = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, keep=("doc_id", "source"))
    return bpe.digests(encoded, keep=("doc_id", "source"))


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]

#: Classifier, join, rounding and encoder are beyond SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        drop(*last)  # once its successor is written, no later stage reads a table
        last = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
