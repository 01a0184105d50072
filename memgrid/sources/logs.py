"""JSON-lines logs, quarantine files and golden sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T


def history(spark: SparkSession, path: str, schema: str, ts: str = "ts", cutoff: Column | None = None) -> DataFrame:
    """Rows of *.jsonl; blank and broken lines are left out; rows without an instant always stay."""
    df = spark.read.option("columnNameOfCorruptRecord", "_bad").schema(f"{schema}, _bad string").json(path).where("_bad IS NULL").drop("_bad")
    return df if cutoff is None else df.where(F.col(ts).isNull() | (F.col(ts) >= cutoff))


def quarantine_codes(spark: SparkSession, path: str) -> DataFrame:
    """Findings by code over all files; an entry without one counts as unspecified."""
    df = history(spark, path, "validator_findings array<struct<code:string>>")
    return df.select(F.explode_outer("validator_findings.code").alias("code")).groupBy(F.coalesce("code", F.lit("unspecified")).alias("code")).agg(F.count("*").alias("n"))


GOLDEN = T.StructType([T.StructField("queries", T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("query", T.StringType()), T.StructField("language", T.StringType()), T.StructField("relevant", T.ArrayType(T.StructType([T.StructField("node_id", T.StringType()), T.StructField("tier", T.StringType())]))), T.StructField("expect_no_result", T.BooleanType())])))])


def golden(spark: SparkSession, path: str) -> DataFrame:
    """query_id, text, slice, must and may; raises on a query that is blank, unlabelled, of an odd tier, or twice there."""
    df = spark.read.option("multiLine", True).schema(GOLDEN).json(path).select(F.explode("queries").alias("q")).select("q.*")
    none = F.coalesce("expect_no_result", F.lit(False))
    same = F.count("*").over(W.partitionBy("id"))
    wrong = (
        F.when(F.coalesce(F.trim("query"), F.lit("")) == "", "blank query")
        .when(F.exists(F.coalesce("relevant", F.array()), lambda r: ~F.coalesce(r["tier"].isin("must", "may"), F.lit(False))), "tier is not must or may")
        .when(~none & (F.coalesce(F.size("relevant"), F.lit(0)) <= 0), "neither relevant nor expect_no_result").when(F.col("same") > 1, "id twice")
    )
    df = df.withColumn("same", same).withColumn("wrong", wrong)
    tier = lambda t: F.transform(F.filter(F.coalesce("relevant", F.array()), lambda r: r["tier"] == t), lambda r: r["node_id"])
    checked = F.when(F.col("wrong").isNotNull(), F.raise_error(F.concat(F.lit("golden set: "), F.coalesce("id", F.lit("?")), F.lit(": "), F.col("wrong"))).cast("string")).otherwise(F.col("id"))
    return df.select(checked.alias("query_id"), F.col("query").alias("text"), F.when(none, "none").otherwise(F.coalesce("language", F.lit("en"))).alias("slice"), tier("must").alias("must"), tier("may").alias("may"))


def append_jsonl(df: DataFrame, path: str) -> None:
    """K2, K7: one line for each row, after what is there."""
    df.write.mode("append").json(path)


def append_events(df: DataFrame, path: str, ts: str) -> None:
    """K3: events as Parquet, a folder for each day."""
    df.withColumn("day", F.to_date(ts)).write.mode("append").partitionBy("day").parquet(path)
