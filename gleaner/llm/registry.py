"""The queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.llm import bpe, clustering, embedding_join, exact_dedup, fingerprints, html_text, jaccard_join, language, licenses, mixing, periodic_runs, quality, url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(_read(spark, sf_dir, "documents")))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    out = language.held_out(F.col("doc_id"), 3, 1)
    model = language.train(docs.filter(~out))
    return language.predict(docs, model).withColumn("held_out", out)


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.report(exact_dedup.decide(_read(spark, sf_dir, "documents")))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.report(html_text.extract(_read(spark, sf_dir, "pages")))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.report(fingerprints.compare_edited(_read(spark, sf_dir, "documents")))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), url_filter.rules_frame(spark))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels")
    out = language.held_out(F.col("doc_id"), 5, 0)
    model = quality.train(docs, labels.filter(~out))
    return quality.score(docs, model).withColumn("held_out", out)


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = jaccard_join.join(_read(spark, sf_dir, "documents"))
    return joined.select(F.col("id").alias("doc_id"), "set_id", "class_id", "n_links")


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = _read(spark, sf_dir, "documents")
    return bpe.digests(bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(mixing.decide(_read(spark, sf_dir, "documents")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = periodic_runs.with_periodic_tail(_read(spark, sf_dir, "documents"))
    return periodic_runs.report(periodic_runs.find(docs))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(clustering.cluster(_read(spark, sf_dir, "embeddings")))


def op13_embedding_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.report(embedding_join.join(_read(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_license_scan, op2_language, op3_exact_dedup, op4_html_text, op5_fingerprints, op6_url_filter, op7_quality, op8_jaccard_join, op9_byte_bpe, op10_mixing, op11_periodic_runs, op12_clustering, op13_embedding_join)}

ORACLES = {"op1_license_scan": licenses.oracle(), "op3_exact_dedup": exact_dedup.ORACLE, "op6_url_filter": url_filter.ORACLE, "op12_clustering": clustering.oracle(), "op13_embedding_join": embedding_join.ORACLE}
