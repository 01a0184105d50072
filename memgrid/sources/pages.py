"""Pages compiled from nodes, and a Markdown report from aggregates."""

from __future__ import annotations

import os

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memgrid.functions.knowledge import takeaway
from memgrid.functions.text import kebab, table_cell
from memgrid.operators.cuts import checkpointed
from memgrid.operators.lifecycle import unique_slugs
from memgrid.sources.markdown import put


#: Rows of a table in a report.
ROWS = 1000


def handbook(nodes: DataFrame) -> DataFrame:
    """A page for each project (path, text): what is known, by kind, then title; and an index page.

    A page holds one line for each node; the compiler of a page is a sorted aggregate, so pages
    are compiled side by side.
    """
    known = nodes.where("status = 'active' AND type = 'persistent' AND project IS NOT NULL").where(F.coalesce("verified", F.lit(True)))
    line = F.concat(F.lit("- **"), table_cell(F.col("title")), F.lit("** — "), table_cell(F.substring(takeaway(F.col("content"), F.col("title")), 1, 200)))
    lines = known.groupBy("project", F.coalesce("okf_type", F.lit("untyped")).alias("kind")).agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("title", "node_id", line.alias("l")))).alias("x"))
    part = F.concat(F.lit("## "), F.initcap("kind"), F.lit("\n\n"), F.array_join(F.transform("x", lambda y: y["l"]), "\n"))
    pages = lines.groupBy("project").agg(F.sum("n").alias("n"), F.array_sort(F.collect_list(F.struct("kind", part.alias("p")))).alias("y"))
    slugs = unique_slugs(pages.select(F.col("project").alias("name"), kebab(F.col("project")).alias("slug")))
    pages = pages.join(slugs, F.col("project") == F.col("name")).select("project", "n", F.concat("slug", F.lit(".md")).alias("path"), F.concat(F.lit("# "), F.col("project"), F.lit("\n\n"), F.array_join(F.transform("y", lambda z: z["p"]), "\n\n"), F.lit("\n")).alias("text"))
    row = F.concat(F.lit("| ["), F.col("project"), F.lit("]("), F.col("path"), F.lit(") | "), F.col("n").cast("string"), F.lit(" |"))
    index = pages.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("project", row.alias("r")))), lambda z: z["r"]), "\n").alias("rows"))
    index = index.select(F.lit("index.md").alias("path"), F.concat(F.lit("# Handbook\n\n| Project | Notes |\n|---|---|\n"), F.col("rows"), F.lit("\n")).alias("text"))
    return pages.select("path", "text").union(index)


MANIFEST = "path string, digest string, version int"


def manifest(spark: SparkSession, ledger: str) -> tuple[DataFrame, int]:
    """Pages (path, digest) of the last version in a ledger, and that version's number; none: -1."""
    try:
        rows = spark.read.schema(MANIFEST).parquet(ledger)
        last = rows.agg(F.max("version")).first()[0]
    except AnalysisException:  # there is no ledger yet
        last = None
    if last is None:
        return spark.createDataFrame([], "path string, digest string"), -1
    return rows.where(F.col("version") == last).where("path <> ''").select("path", "digest"), last


def published(pages: DataFrame, folder: str, ledger: str) -> DataFrame:
    """K5: makes a folder that all executors share hold these pages (path, text): path, action.

    What was generated before stands in a ledger (Parquet, a version each time). A page is written if it
    is new or has another text, kept if it has the same, and removed if it is not generated any more;
    the ledger decides, so files that others put there stay, and a page in the place of such a file is
    left out (foreign). The ledger names what is about to be written before the first file is, and
    what there is after the last; a run that was cut short is made good by the next one.
    """
    spark = pages.sparkSession
    cut = checkpointed(spark)
    old, version = manifest(spark, ledger)
    both = pages.select("path", "text", F.sha2("text", 256).alias("digest")).join(old.withColumnRenamed("digest", "had"), "path", "full_outer")

    def found(batches):
        for pdf in batches:
            pdf["there"] = [h is None and os.path.exists(os.path.join(folder, p)) for p, h in zip(pdf.path, pdf.had, strict=True)]
            yield pdf[["path", "text", "digest", "had", "there"]]

    action = F.when(F.col("digest").isNull(), "removed").when(F.col("there"), "foreign").when(F.col("digest") == F.col("had"), "kept").otherwise("written")
    plan = cut(both.mapInPandas(found, "path string, text string, digest string, had string, there boolean").select("path", "text", "digest", "had", action.alias("action")))

    def note(rows: DataFrame, v: int) -> None:
        # a version without pages is one, too
        rows.select("path", "digest").unionByName(spark.createDataFrame([("", "")], "path string, digest string")).coalesce(1).write.mode("overwrite").parquet(f"{ledger}/version={v}")

    own = plan.where("action <> 'foreign'")
    note(own.select("path", F.when(F.col("action") == "kept", F.col("had")).otherwise(F.lit("?")).alias("digest")), version + 1)

    def run(batches):
        for pdf in batches:
            for path, text, what in zip(pdf.path, pdf.text, pdf.action, strict=True):
                if what == "written":
                    put(folder, path, text)
                elif what == "removed":
                    to = os.path.join(folder, path)
                    if os.path.exists(to):
                        os.remove(to)
                    if os.path.dirname(path) and not os.listdir(os.path.dirname(to)):
                        os.rmdir(os.path.dirname(to))
            yield pdf[["path", "action"]]

    done = cut(plan.mapInPandas(run, "path string, action string"))
    note(own.where("action <> 'removed'"), version + 2)
    return done


def report(title: str, **parts: DataFrame) -> str:
    """A Markdown document with a table for each aggregate; one of more than ROWS rows is refused, not cut."""
    out = [f"# {title}"]
    for name, df in parts.items():
        out += ["", f"## {name.replace('_', ' ').capitalize()}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
        rows = df.limit(ROWS + 1).collect()
        if len(rows) > ROWS:
            raise ValueError(f"{name} has more than {ROWS} rows: no table for a report")
        out += ["| " + " | ".join("" if v is None else str(v).replace("|", "\\|") for v in r) + " |" for r in rows] or ["| " + " | ".join([""] * len(df.columns)) + " |"]
    return "\n".join(out) + "\n"
