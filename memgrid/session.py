"""A session with the settings that the operators rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def make_session(name: str = "memgrid", master: str | None = None, shuffle_partitions: int | None = None, memory: str | None = None) -> SparkSession:
    """UTC time, adaptive plans and no console progress; the rest is the caller's."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.cteRecursionLevelLimit", "100")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if master:
        builder = builder.master(master)
    if memory:
        builder = builder.config("spark.driver.memory", memory)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
