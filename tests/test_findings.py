"""What findings of round 3 said, on small tables."""

from __future__ import annotations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from memgrid.operators import lifecycle as L, vector_cells as C, vectors as V
from memgrid.plans import catalog, registry  # noqa: F401  the registry fills the catalog
from memgrid.sources.logical import Tables


def with_odd_texts(spark, sf_dir, folder):
    """Tables like the given ones, with a null and an empty text; a folder."""
    import glob
    import os
    import shutil

    for p in glob.glob(f"{sf_dir}/*.parquet"):
        if not p.endswith("documents.parquet"):
            shutil.copy(p, folder)
    duckdb.sql(f"copy (select * replace (case doc_id when 1 then null when 6 then '' else text end as text) from '{sf_dir}/documents.parquet') to '{folder}/documents.parquet' (format parquet)")
    return os.fspath(folder)


def expected(name, folder, columns):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "events", "labels", "orders", "lineitem", "conversations"):
        con.sql(f"create view {table} as select * from '{folder}/{table}.parquet'")
    return sorted(con.sql(f"select {', '.join(columns)} from ({catalog.SQL[name]})").fetchall())


def test_oversized_actions_judge_all_notes(spark, sf_dir, tmp_path):
    folder = with_odd_texts(spark, sf_dir, tmp_path)
    for name in ("oversized_actions", "sibling_parts"):
        df = catalog.QUERIES[name](Tables(spark, folder))
        got = sorted(map(tuple, df.collect()))
        assert got == expected(name, folder, df.columns) and len(got) == Tables(spark, folder).texts().count()


def test_sections_are_split_once(spark):
    """A lambda works out what it closes over for each element: the text must not be split in one."""
    from memgrid.functions.episodes import shards
    from memgrid.functions.text import sections
    from memgrid.operators.lifecycle import siblings

    df = spark.createDataFrame([("a", "t", "x", 900)], "node_id string, title string, content string, most int")
    for c in (sections(F.col("content")), shards(F.col("content"), F.col("most"))):
        plan = df.select(c.alias("x"))._jdf.queryExecution().analyzed().toString()
        assert plan.count("split(") == 1
    assert siblings(df, F.col("most"))._jdf.queryExecution().analyzed().toString().count("split(") <= 4


@pytest.mark.parametrize("decimals", [1, 8])
def test_linkage_from_vectors_equals_that_from_pairs(spark, decimals, monkeypatch):
    """Clusters told from the vectors, without a list of pairs, with ties and copies; all projects in one task each, or none."""
    monkeypatch.setattr(V, "PARTNERS", 2)
    rng = np.random.default_rng(4)
    m = np.round(np.vstack([b + rng.normal(size=6) * 0.6 for b in rng.normal(size=(5, 6)) * 1.5 for _ in range(24)] + [np.ones(6)] * 15), decimals)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    ids = np.array([f"n{i * 37 % 135:03}" for i in range(135)])
    by = {f"{x}": v.tolist() for x, v in zip(ids, m, strict=True)}
    vectors = spark.createDataFrame(list(by.items()), "node_id string, embedding array<double>")
    project = F.when(F.col("node_id") < "n050", "p").otherwise("q")
    nodes = vectors.select("node_id", F.lit("active").alias("status"), F.lit("persistent").alias("type"), F.lit("fact").alias("okf_type"), project.alias("project"), F.array().cast("array<string>").alias("tags"))
    pairs = V.similar_pairs(vectors.join(nodes.select("node_id", "project"), "node_id"), 0.6, by="project")
    want = sorted(map(tuple, V.folded(pairs.withColumn("label", F.lit("all")), 0.8, 6).collect()))
    for numbers in (0, 60 * 6, 1_000_000):
        got = V.complete_linkage(nodes, vectors, 0.8, 0.6, numbers=numbers).collect()
        assert sorted((r.cluster, r.node_id) for r in got) == want and all(r.project == ("p" if r.node_id < "n050" else "q") for r in got)
    assert len({c for c, _ in want}) > 10


def clustered(spark, n=300, d=12):
    rng = np.random.default_rng(9)
    base = rng.normal(size=(7, d))
    m = np.vstack([base[i % 7] * 2 + rng.normal(size=d) * 0.6 for i in range(n)] + [base[0]] * 20)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    m[::2] = m[::2].astype(np.float32)
    odd = [("zero", [0.0] * d), ("long", [3.0] * d), ("other", [1.0, 0.0]), ("none", None), ("empty", [])]
    return spark.createDataFrame([(f"n{i * 37 % 320:04}", v.tolist()) for i, v in enumerate(m)] + odd, "node_id string, embedding array<double>")


@pytest.mark.parametrize("per_block", [40, 65536])
def test_links_counts_and_partners_are_told_where_pairs_are_found(spark, per_block, monkeypatch):
    monkeypatch.setattr(C, "MOST_PER_BLOCK", per_block)
    monkeypatch.setattr(C, "PER_BLOCK", per_block)
    df = clustered(spark)
    ids = [r[0] for r in df.where("node_id like 'n%' and node_id <> 'none'").select("node_id").collect()]
    edges = spark.createDataFrame([(ids[i], ids[i * 7 % 320]) for i in range(320)] + [(ids[i * 7 % 320], ids[i]) for i in range(40)] + [("gone", ids[0])], "source_id string, target_id string")
    every = V.similar_pairs(df, 0.5)
    want = sorted(map(tuple, V.unlinked(every, edges).collect()))
    got = sorted(map(tuple, V.similar_pairs(df, 0.5, links=edges).collect()))
    assert got == want and len(want) < every.count() - 20
    thresholds = (0.5, 0.8, 0.99, 1.5)
    assert sorted(map(tuple, V.pair_counts(df, thresholds, links=edges).collect())) == sorted(map(tuple, V.histogram(V.unlinked(every, edges), thresholds).collect()))
    notes = df.select("node_id", F.when(F.col("node_id") < "n0100", "see [[n0007]] [[n0008 and [[n001").otherwise("none").alias("content"))
    assert sorted(map(tuple, L.partners_woven(notes, V.similar_partners(df, 0.5)).collect())) == sorted(map(tuple, L.links_woven(notes, every).collect()))


def test_pairs_are_not_shuffled_to_be_counted(spark):
    """Only counts leave the tasks that find pairs."""
    plan = V.pair_counts(clustered(spark), (0.5,))._jdf.queryExecution().executedPlan().toString()
    assert "id_a" not in plan and "threshold" in plan


@pytest.mark.parametrize("sent", [0, 1_000_000])
def test_near_duplicates_by_few_blocks_and_hashed_tokens(spark, tmp_path, sent, monkeypatch):
    """Blocks are few however many vectors there are, and both searches say what comparing all says."""
    monkeypatch.setattr(V, "SENT_IDS", sent)
    monkeypatch.setattr(C, "PER_BLOCK", 4)
    df = clustered(spark)
    index = C.VectorIndex.build(df, str(tmp_path / "v"))
    assert sum(index._parts().values()) <= 3 * C.SPLIT
    words = F.concat_ws(" ", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.concat(F.lit("w"), (F.hash("node_id", k) % 3).cast("string"))))
    nodes = df.select("node_id", F.lit("active").alias("status"), F.lit("persistent").alias("type"), F.lit("fact").alias("okf_type"), F.lit("p").alias("project"), words.alias("content"))
    for overlap in (None, 0.5):
        want = V.near_duplicates(df, nodes, nodes.select("node_id"), 0.8, 6, overlap)
        got = sorted(map(tuple, V.near_duplicates(df, nodes, nodes.select("node_id"), 0.8, 6, overlap, index=index).collect()))
        assert got == sorted(map(tuple, want.collect())) and got
    texts = {r.node_id: set(r.content.replace("-", " ").split()) for r in nodes.collect()}
    texts = {k: {w for w in v if len(w) > 1} for k, v in texts.items()}
    close = {(r.source, r.node_id) for r in V.near_duplicates(df, nodes, nodes.select("node_id"), 0.8, 6, index=index).collect() if len(texts[r.source] & texts[r.node_id]) >= 0.5 * len(texts[r.source] | texts[r.node_id])}
    assert {(r[0], r[1]) for r in got} == close
