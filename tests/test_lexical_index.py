"""The stored index against scores worked out from all notes."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from memgrid.operators import lexical as L, lexical_index as X

NOTES = "node_id string, title string, content string, tags array<string>"
WORDS = "gateway vector nodes_vec sqlite.py recall Café zoë index shard cell bound score 数据库连接 网关重启 连接池 alpha beta gamma".split()


def notes(n: int, seed: int) -> list[tuple]:
    rng = random.Random(seed)
    rows = [(f"n{i:04}", " ".join(rng.choices(WORDS, k=2)), " ".join(rng.choices(WORDS, weights=[60 / (k + 1) for k in range(len(WORDS))], k=rng.choice([1, 3, 10, 80]))), rng.sample(WORDS, 2)) for i in range(n)]
    return [*rows, ("empty", "", "", []), ("null", None, None, None), ("blank", " ", "...", [])]


def queries(spark, seed: int):
    rng = random.Random(seed)
    texts = [" ".join(rng.choices(WORDS, k=rng.randint(1, 5))) for _ in range(25)] + ["nothing here fits", "", "the of", "Gateway gateway", "nodes_vec sqlite.py", "数据库"]
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def told(df):
    return sorted((r.query_id, r.leg, r["rank"], r.node_id, round(r.score, 6)) for r in df.collect())


@pytest.mark.parametrize(("per_slot", "tokens"), [(10, 250_000), (10_000, 30)])
def test_top_notes_equal_those_of_all(spark, tmp_path, per_slot, tokens, monkeypatch):
    monkeypatch.setattr(X, "TOKENS", tokens)
    df = spark.createDataFrame(notes(300, 1), NOTES)
    index = X.LexicalIndex.build(df, str(tmp_path / "i"), per_slot=per_slot)
    q = queries(spark, 2)
    want = L.leg_scores(q, df)
    assert told(index.top(q, 5, seeds=1, count_visits=True)) == told(L.ranked(want, 5, "leg"))
    assert index.visited["first"] + index.visited["rest"] <= index.visited["cells"]
    if per_slot == 10:
        assert index.visited["searched"] < index.visited["searches"]
    assert told(X.LexicalIndex.open(spark, index.path).top(q.where("query_id < 3"), 400)) == told(L.ranked(want.where("query_id < 3"), 400, "leg"))
    assert sorted(map(tuple, X.merged(index, q, 5).select("query_id", "rank", "node_id").collect())) == sorted(map(tuple, L.merged_legs(q, df, 5).select("query_id", "rank", "node_id").collect()))


def test_rare_words_leave_most_cells_unread(spark, tmp_path):
    rows = [(f"n{i:04}", "t", " ".join(["common"] * (i % 7 + 1)) + (" rare" if i % 400 == 0 else ""), []) for i in range(2000)]
    df = spark.createDataFrame(rows, NOTES)
    index = X.LexicalIndex.build(df, str(tmp_path / "i"), per_slot=40)
    q = spark.createDataFrame([(1, "rare common")], "query_id long, text string")
    got = index.top(q, 5, count_visits=True)
    assert {r.node_id for r in got.where("leg = 0").collect()} == {f"n{i:04}" for i in range(0, 2000, 400)}
    assert index.visited["first"] + index.visited["rest"] < index.visited["cells"] / 4


def test_changes_give_what_a_new_index_gives(spark, tmp_path):
    before, after = notes(200, 3), notes(230, 4)
    gone, new = {r[0] for r in before if r[0] < "n0040" or r[0] == "blank"}, [r for r in after if r[0] >= "n0100"]
    changed = {r[0]: r for r in before if r[0] not in gone} | {r[0]: r for r in new}
    index = X.LexicalIndex.build(spark.createDataFrame(before, NOTES), str(tmp_path / "i"), per_slot=12)
    index = index.changed(spark.createDataFrame(new, NOTES), spark.createDataFrame([(x,) for x in sorted(gone)], "node_id string"))
    fresh = spark.createDataFrame(list(changed.values()), NOTES)
    q = queries(spark, 5)
    assert told(X.LexicalIndex.open(spark, index.path).top(q, 7)) == told(L.ranked(L.leg_scores(q, fresh), 7, "leg"))
    p = L.postings(fresh).groupBy("node_id").agg(F.count("*").alias("postings"), F.sum(F.length("token")).alias("chars"))
    assert sorted(map(tuple, index.tokens().collect())) == sorted(map(tuple, p.collect()))
    assert index.changed(fresh.where("false"), spark.createDataFrame([], "node_id string")).version == 1


def test_no_notes_and_no_queries(spark, tmp_path):
    none = spark.createDataFrame([], NOTES)
    index = X.LexicalIndex.build(none, str(tmp_path / "i"))
    assert index.top(queries(spark, 1), 3).count() == 0
    index = index.changed(spark.createDataFrame(notes(5, 1), NOTES), none.select("node_id"))
    assert index.top(queries(spark, 1).where("false"), 3).count() == 0 and index.top(queries(spark, 1), 3).count() > 0


def test_a_change_writes_what_came_alone(spark, tmp_path):
    """no block is written again for a change, and notes that went count no more, after several changes, too."""
    before = notes(120, 6)
    index = X.LexicalIndex.build(spark.createDataFrame(before, NOTES), str(tmp_path / "i"), per_slot=30)
    came = [("n0003", "Café", "zoë café alpha", ["数据库连接"]), ("new", "Zoé", "gateway gateway", [])]
    index = index.changed(spark.createDataFrame(came, NOTES), spark.createDataFrame([("n0004",), ("never",)], "node_id string"))
    written = index.postings().where("version = 1")
    assert {r.token for r in written.where("leg <> 1").collect()} == {"cafe", "zoe", "alpha", "数据库连接", "gateway"}
    index = index.changed(spark.createDataFrame(came[:1], NOTES), spark.createDataFrame([("new",), ("n0005",)], "node_id string"))
    assert index.postings().where("version = 2").agg(F.sum("n")).first()[0] < 12
    index = index.changed(spark.createDataFrame([], NOTES), spark.createDataFrame([("n0007",)], "node_id string"))
    now = spark.createDataFrame([r for r in before if r[0] not in {"n0003", "n0004", "n0005", "n0007"}] + came[:1], NOTES)
    q = queries(spark, 7)
    assert told(X.LexicalIndex.open(spark, index.path).top(q, 7, seeds=1)) == told(L.ranked(L.leg_scores(q, now), 7, "leg"))
    p = L.postings(now).groupBy("node_id").agg(F.count("*").alias("postings"), F.sum(F.length("token")).alias("chars"))
    assert sorted(map(tuple, index.tokens().collect())) == sorted(map(tuple, p.collect()))
