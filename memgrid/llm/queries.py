"""The queries of this package by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memgrid.llm import alignment, bpe, decontaminate, hmm, language_id, mixing, near_duplicates, quality, quality_rules, secret_scan, token_counts, url_filter, whitening
from memgrid.llm.common import read


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(read(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_secrets(read(spark, sf_dir, "documents")).drop("values")


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicates(read(spark, sf_dir, "documents")).drop("node")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.train_on(docs))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "rejected")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))
    return found.select("doc_id", language_id.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages")).drop("score")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark")).drop("h_doc")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(read(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.judge(read(spark, sf_dir, "documents"))
    base = F.expr(" OR ".join(f"({r.rejects})" for r in quality_rules.RULES if r.name in quality_rules.BASE))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    embeddings = read(spark, sf_dir, "embeddings")
    found = whitening.whiten(embeddings, whitening.fit(embeddings))
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mixing.schedule(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("taken_turns")).alias("taken"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_secrets, op3_near_duplicates, op4_language, op5_quality, op6_urls, op7_decontaminate, op8_token_counts, op9_language_model, op10_quality_rules, op11_whitening, op12_alignment, op13_mixing)}
ORACLES = {"op6_urls": url_filter.ORACLE, "op7_decontaminate": decontaminate.ORACLE, "op10_quality_rules": quality_rules.ORACLE, "op13_mixing": mixing.ORACLE}
