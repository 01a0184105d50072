"""A pipeline over the table of documents: five stages, each over all that the one before kept.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet to the
shared folder and reads it again as the next one's docs. All but the last return the columns of
documents. None can be given in SQL as a whole, so ORACLE_SQL is None; a test holds the pipeline
against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memgrid.llm import bpe, decontaminate, language_id, near_duplicates, secret_scan
from memgrid.llm.common import fresh, read, scratch, stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose text is null, has no letter, or fits no language that was learned.

    If nothing can be learned (no row with a text and a lang), all go. Rows that repeat stay or go
    together; long texts are judged as wholes.
    """
    model = language_id.train_on(docs)
    return language_id.accepted(docs, model)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of copies and near copies: the least doc_id.

    Rows that repeat a doc_id and text are copies, one stays; of copies without a doc_id as well.
    Null texts are copies of nothing, all stay; empty texts are copies of each other.
    """
    return near_duplicates.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that contain four fifths of a benchmark item's shingles at least.

    Null and empty texts contain nothing and stay; rows that repeat stay or go together. Without
    benchmark items all stay.
    """
    (h,) = fresh(docs, "h")
    found = decontaminate.contaminated(docs, read(spark, sf_dir, "benchmark")).withColumnRenamed("h_doc", h)
    small = decontaminate.small(found)
    return docs.join(small, F.xxhash64(docs["text"]) == small[h], "left_anti")


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks secrets in each text; n_chars, where there is one, follows. No document is dropped; null and empty texts stay as they are."""
    clean = secret_scan.mask_secrets(docs)
    if "n_chars" not in docs.columns:
        return clean
    kind = docs.schema["n_chars"].dataType
    return clean.withColumn("n_chars", F.char_length("text").cast(kind))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each text with the digests of the round trip; a row for each document, null texts as empty ones."""
    return bpe.encode_decode(docs)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("secrets", secrets), ("tokens", tokens)]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. What stages write on the way is emptied once the next stage's input is stored."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch():
            out = stage(spark, docs, sf_dir)
            kept = stored(out, f"stage-{name}")
        docs = kept
    return docs
