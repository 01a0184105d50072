"""Markdown notes with YAML front matter as a source and a sink."""

from __future__ import annotations

import os

import datetime as dt
import json

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from memgrid.functions.bodies import without_banners
from memgrid.functions.text import kebab

FRONT = r"(?s)\A---[ \t]*\n(.*?)(?:\n)?^---[ \t]*(?:\n|\z)"


def scan(spark: SparkSession, path: str) -> DataFrame:
    """Path, mtime, raw of every *.md below a folder."""
    df = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("mtime"), F.regexp_replace("value", r"\r\n?", "\n").alias("raw"))


def archived(spark: SparkSession, path: str) -> DataFrame:
    """node_id and sources of every readable note below a folder's .archive; what can't be parsed is left out."""
    df = parsed(scan(spark, f"{path.rstrip('/')}/.archive"))
    return df.where("not error").select("node_id", "sources")


def front_matter(raw: Column) -> tuple[Column, Column]:
    """(front matter, body); an unterminated one is body."""
    pattern = "(?m)" + FRONT
    has = F.rlike(raw, F.lit(pattern))
    return F.when(has, F.regexp_extract(raw, pattern, 1)), F.when(has, F.regexp_replace(raw, pattern, "")).otherwise(raw)


@F.pandas_udf(T.StringType())
def yaml_to_json(text: pd.Series) -> pd.Series:
    """A mapping as JSON; {} without front matter; null for what is no mapping or no YAML."""

    def one(x: str | None) -> str | None:
        if x is None:
            return "{}"
        try:
            v = yaml.safe_load(x)
        except yaml.YAMLError:
            return None
        if v is None:
            return "{}"
        return json.dumps(v, default=lambda o: o.isoformat() if isinstance(o, (dt.date, dt.datetime)) else str(o)) if isinstance(v, dict) else None

    return text.map(one)


META = "id string, title string, type string, status string, created_at string, last_accessed string, tags array<string>, sources array<string>, superseded_by string, okf_type string, project string, verified boolean"


def parsed(files: DataFrame) -> DataFrame:
    """Nodes with defaults; `error` says that the front matter is no mapping."""
    meta, body = front_matter(F.col("raw"))
    df = files.withColumn("__json", yaml_to_json(meta)).withColumn("content", F.regexp_replace(without_banners(body), r"\s+\z", "")).withColumn("m", F.from_json("__json", META))
    name = F.regexp_extract("path", r"([^/]+)\.md$", 1)
    heading = F.nullif(F.trim(F.regexp_extract("content", r"(?m)^#{1,6}[ \t]+(.+?)[ \t]*$", 1)), F.lit(""))
    title = F.coalesce(F.nullif(F.trim("m.title"), F.lit("")), heading, F.nullif(F.initcap(F.trim(F.regexp_replace(name, r"[-_]+", " "))), F.lit("")), F.lit("Untitled Node"))
    created = F.coalesce(F.try_to_timestamp("m.created_at"), F.col("mtime"))
    ts = F.date_format(created, "yyyyMMdd")
    none = F.array().cast("array<string>")
    return df.select(
        "path", "mtime", F.coalesce("m.id", F.concat(F.lit("mem_"), ts, F.lit("_"), F.replace(kebab(title), F.lit("-"), F.lit("_")))).alias("node_id"), title.alias("title"), "content",
        F.coalesce("m.type", F.lit("persistent")).alias("type"), F.coalesce("m.status", F.lit("active")).alias("status"), created.alias("created_at"), F.coalesce(F.try_to_timestamp("m.last_accessed"), created).alias("last_accessed"),
        F.coalesce("m.tags", none).alias("tags"), F.coalesce("m.sources", none).alias("sources"), "m.superseded_by", "m.okf_type", "m.project", "m.verified", F.col("__json").isNull().alias("error"),
    )


def rendered(nodes: DataFrame) -> DataFrame:
    """path and text of each node, front matter first.

    The path is relative: project/slug.md; of several nodes with one slug the first has it, the
    next that were created on a day of their own have the day behind it, the others a hash.
    """
    fields = ["title", "type", "status", "okf_type", "project", "superseded_by", "verified"]
    line = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.to_json(F.array(F.col(c).cast("string"))) if c == "title" else F.col(c).cast("string")))
    title = F.concat(F.lit("title: "), F.regexp_replace(F.to_json(F.array("title")), r"^\[|\]$", ""))
    head = [F.concat(F.lit("id: "), F.col("node_id")), title, *[line(c) for c in fields[1:]], F.concat(F.lit("created_at: "), F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")), F.concat(F.lit("tags: "), F.to_json("tags")), F.concat(F.lit("sources: "), F.to_json("sources"))]
    text = F.concat(F.lit("---\n"), F.array_join(F.array_compact(F.array(*head)), "\n"), F.lit("\n---\n"), F.col("content"), F.lit("\n"))
    slug = F.coalesce(F.nullif(F.rtrim(F.substring(kebab(F.col("title")), 1, 80), F.lit("-")), F.lit("")), F.lit("untitled"))
    folder = F.coalesce("project", F.lit("unassigned"))
    df = nodes.select("node_id", folder.alias("folder"), slug.alias("slug"), F.date_format("created_at", "yyyyMMdd").alias("day"), text.alias("text"))
    n = F.expr("row_number() over (partition by folder, slug order by node_id)")
    # the first is out of the way of the days of the others
    k = F.expr("row_number() over (partition by folder, slug, day, n = 1 order by node_id)")
    suffix = F.when(F.col("n") == 1, "").when(F.col("k") == 1, F.concat(F.lit("-"), F.col("day"))).otherwise(F.concat(F.lit("-"), F.substring(F.sha1(F.col("node_id").cast("binary")), 1, 8)))
    return df.withColumn("n", n).withColumn("k", k).select(F.concat("folder", F.lit("/"), "slug", suffix, F.lit(".md")).alias("path"), "text")


def put(folder: str, path: str, text: str) -> None:
    """Writes one file under a folder, by rename."""
    to = os.path.join(folder, path)
    os.makedirs(os.path.dirname(to), exist_ok=True)
    part = f"{to}.{os.getpid()}.tmp"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, to)


def write(nodes: DataFrame, folder: str) -> DataFrame:
    """K1: writes each node's file under a folder that all executors share, by rename; returns the paths written."""

    def run(batches):
        for pdf in batches:
            for path, text in zip(pdf.path, pdf.text, strict=True):
                put(folder, path, text)
            yield pdf[["path"]]

    return rendered(nodes).mapInPandas(run, "path string")
