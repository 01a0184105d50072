"""What findings of round 4 said, on small tables."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from memgrid.operators import blocks as B, vector_cells as C, vectors as V
from tests.test_findings import clustered


@pytest.mark.parametrize("scale", [1.0, 1e20])
def test_best_of_blocks_in_any_order(scale, monkeypatch):
    """Copies, ties, zeros, long vectors and numbers that aren't: as a sort of all distances."""
    monkeypatch.setattr(B, "NEAR_QUERIES", 7)
    monkeypatch.setattr(B, "NEAR_VECTORS", 32)
    monkeypatch.setattr(B, "GATHERED", 50)
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(300, 5)), 1)
    m[::3] /= np.maximum(np.linalg.norm(m[::3], axis=1, keepdims=True), 1e-9)
    m[40:80], m[200:230], m[250], m[5] = m[3], m[6], 0, m[5] * scale
    m[9, 2] = np.nan if scale > 1 else 0.5
    ids = np.array([f"é{i * 37 % 300}".encode() for i in range(300)])
    q = np.vstack([m[:60], -m[:20], np.zeros((1, 5))])
    q = q[~np.isnan(q).any(axis=1)]
    for k in (1, 6, 40):
        best = B.Best(q, k)
        for at in range(0, 300, 90):
            best.see(np.arange(len(q)), ids[at : at + 90], m[at : at + 90])
        unit = q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-300)
        for i, x in enumerate(unit):
            d = np.round(1 - np.clip(np.einsum("j,ij->i", x, m), -1, 1), 8) + 0.0
            want = sorted((a, b) for a, b in zip(d, ids, strict=True) if a == a)[:k]
            assert [(a, b) for a, b in zip(best.d[i], best.ids[i], strict=True)] == want
    few = B.Best(q, 400)
    few.see(np.arange(len(q)), ids, m)
    assert np.isinf(few.d[:, -1]).all() and np.isfinite(few.d[:, 250]).all()


def test_first_copies():
    m = np.array([[1.0, 2.0], [1.0, 2.0], [0.0, 2.0], [1.0, 2.0], [0.0, 2.0]])
    assert B.first_copies(m, 2).tolist() == [True, True, True, False, True]


@pytest.mark.parametrize("seen", [16, 16384])
def test_a_search_sorts_nothing_that_it_finds(spark, tmp_path, seen, monkeypatch):
    """a task has a block of queries and tells its k nearest, so nothing found travels to be ranked; in spans it does, with the same result."""
    monkeypatch.setattr(C, "SEEN", seen)
    monkeypatch.setattr(C, "SEARCHED", 40)
    df = clustered(spark)
    index = C.VectorIndex.build(df, str(tmp_path / "v"), k=3)
    q = df.where("node_id like 'n0%'").selectExpr("xxhash64(node_id) query_id", "embedding vector")
    want = sorted(map(tuple, V.top_k_many(df, q, 6).collect()))
    found = index.nearest(q, 6)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and sorted(map(tuple, found.collect())) == want
    monkeypatch.setattr(C, "SPAN", 1)
    assert sorted(map(tuple, index.nearest(q, 6).collect())) == want


def test_texts_are_cut_into_tokens_once(spark):
    """both sides of a pair read tokens that are there already."""
    df = clustered(spark).where("node_id < 'n0040'")
    nodes = df.select("node_id", F.lit("active").alias("status"), F.lit("persistent").alias("type"), F.lit("fact").alias("okf_type"), F.lit("p").alias("project"), F.concat(F.lit("one two "), "node_id").alias("content"))
    found = V.near_duplicates(df, nodes, nodes.select("node_id"), 0.5, 6, 0.5)
    assert "regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString() and found.count()
