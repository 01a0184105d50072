"""Retrieval quality: recall, reciprocal rank, slices, no-result queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memgrid.operators.events import nearest_rank


def per_query(results: DataFrame, golden: DataFrame) -> DataFrame:
    """A row for each golden query (query_id, slice, must array) from results (query_id, pos, node_id, score, inject).

    The variants keep results with a positive score, or with inject, and number them anew before the cut.
    """
    w = W.partitionBy("query_id").orderBy("pos")
    rank = lambda keep: F.when(keep, F.sum(keep.cast("int")).over(w))
    r = results.select("query_id", "node_id", F.col("pos").alias("r"), rank(F.col("score") > 0).alias("rp"), rank(F.col("inject")).alias("ri"), "score", "inject")
    df = golden.join(r, "query_id", "left").withColumn("hit", F.array_contains("must", F.col("node_id")))
    n = F.size("must")

    def recall(c: str) -> Column:
        k = F.count_if(F.col("hit") & (F.col(c) <= 5))
        return F.when(F.first(n) > 0, F.least(F.lit(1.0), k / F.first(n))).otherwise(0.0)

    def mrr(c: str) -> Column:
        return F.coalesce(1.0 / F.min(F.when(F.col("hit") & (F.col(c) <= 10), F.col(c))), F.lit(0.0))

    out = df.groupBy("query_id", "slice").agg(
        F.first(n).alias("n_must"), recall("r").alias("recall5"), recall("rp").alias("recall5_pos"), recall("ri").alias("recall5_inject"), mrr("r").alias("mrr10"), mrr("rp").alias("mrr10_pos"),
        F.coalesce(F.bool_or(F.col("hit") & (F.col("r") == 1)), F.lit(False)).alias("top1"), F.count("node_id").alias("returned"), F.count_if(F.col("score") > 0).alias("positive"), F.count_if("inject").alias("injected"),
    )
    return out.withColumn("empty_ok", F.col("positive") == 0).withColumn("empty_ok_inject", F.col("injected") == 0)


def report(rows: DataFrame) -> DataFrame:
    """Means of each slice and of all; the slice `none` (no result expected) counts for its own rates only."""
    both = rows.select(F.explode(F.array("slice", F.lit("overall"))).alias("part"), *rows.columns)
    ranked = (F.col("part") == F.col("slice")) | (F.col("slice") != "none")
    mean = lambda c: F.round(F.coalesce(F.avg(F.when(ranked, F.col(c).cast("double"))), F.lit(0.0)), 4)
    share = lambda c: F.round(F.avg(F.when(F.col("returned") > 0, F.col(c) / F.col("returned")).otherwise(0.0)), 4)
    none = lambda c: F.round(F.avg(F.when(F.col("slice") == "none", F.col(c).cast("double"))), 4)
    measures = ["recall5", "recall5_pos", "recall5_inject", "mrr10", "mrr10_pos", "top1"]
    return both.groupBy("part").agg(F.count("*").alias("n"), *[mean(c).alias(c) for c in measures], share("positive").alias("positive_rate"), share("injected").alias("inject_rate"), none("empty_ok").alias("no_result_rate"), none("empty_ok_inject").alias("no_result_rate_inject"))


def latency_and_zero_hits(rows: DataFrame) -> DataFrame:
    """Of each slice and of all (part): p50 and p95 of latency_ms by nearest rank, and the share of queries without a lexical hit.

    rows: query_id, slice, latency_ms, lexical_hits.
    """
    both = rows.select(F.explode(F.array("slice", F.lit("overall"))).alias("part"), "latency_ms", "lexical_hits")
    return both.groupBy("part").agg(nearest_rank("latency_ms", 0.5).alias("p50"), nearest_rank("latency_ms", 0.95).alias("p95"), F.round(F.avg((F.col("lexical_hits") == 0).cast("double")), 4).alias("lexical_zero_rate"))


def median_run(runs: DataFrame) -> DataFrame:
    """Of each query's runs the one in the middle by latency."""
    w = W.partitionBy("query_id")
    place = F.row_number().over(w.orderBy("latency_ms", "run"))
    return runs.withColumn("place", place).withColumn("n", F.count("*").over(w)).where("place = n div 2 + 1").drop("place", "n")


def history_line(report_: DataFrame, ts: str, golden_hash: str) -> DataFrame:
    """A run as one JSON line: all, and each slice."""
    parts = report_.agg(F.collect_list(F.struct(*report_.columns)).alias("x"))
    slices = F.map_from_entries(F.transform(F.array_sort(F.filter("x", lambda p: p["part"] != "overall")), lambda p: F.struct(p["part"], p)))
    return parts.select(F.to_json(F.struct(F.lit(ts).alias("ts"), F.lit(golden_hash).alias("golden_sha256"), F.element_at(F.filter("x", lambda p: p["part"] == "overall"), 1).alias("overall"), slices.alias("slices"))).alias("value"))
