"""Files in and out, and streams."""

from __future__ import annotations

import datetime as dt
import json

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from memgrid.sources import logs, markdown, pages
from memgrid.sources.logical import Tables
from memgrid.streaming import pipelines as S


def test_markdown_round_trip(spark, sf_dir, tmp_path):
    nodes = Tables(spark, sf_dir).nodes().where("seq < 40").withColumn("content", F.trim("content"))
    paths = [r.path for r in markdown.write(nodes, str(tmp_path)).collect()]
    assert len(set(paths)) == 40
    back = {r.node_id: r for r in markdown.parsed(markdown.scan(spark, str(tmp_path))).collect()}
    for r in nodes.collect():
        b = back[r.node_id]
        assert (b.title, b.status, b.okf_type, b.project, b.verified, b.tags, b.sources, b.created_at, b.error) == (r.title, r.status, r.okf_type, r.project, r.verified, r.tags, r.sources, r.created_at, False)
        assert b.content == r.content.rstrip()


def test_markdown_defaults(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "some-note.md").write_bytes(b"---\r\ntags: [a]\r\n---\r\n> **Supersedes**: [[x]] - why\r\nbody  \r\n")
    (tmp_path / "head.md").write_text("# A Title #1\ntext")
    (tmp_path / "open.md").write_text("---\ntitle: x\nno end")
    (tmp_path / "list.md").write_text("---\n- a\n---\nbody")
    (tmp_path / "skip.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: r for r in markdown.parsed(markdown.scan(spark, str(tmp_path))).collect()}
    assert set(got) == {"some-note.md", "head.md", "open.md", "list.md"}
    assert got["some-note.md"].title == "Some Note" and got["some-note.md"].content == "body" and got["some-note.md"].tags == ["a"]
    assert got["head.md"].title == "A Title #1" and got["head.md"].type == "persistent" and got["head.md"].node_id.startswith("mem_")
    assert got["open.md"].content.startswith("---") and not got["open.md"].error and got["list.md"].error


def test_logs(spark, tmp_path):
    p = tmp_path / "h.jsonl"
    p.write_text('{"ts": "2024-01-01T00:00:00Z", "a": 1}\n\nbroken\n{"a": 2}\n{"ts": "2024-02-01T00:00:00Z", "a": 3}\n')
    df = logs.history(spark, str(p), "ts timestamp, a int", cutoff=F.lit("2024-01-15").cast("timestamp"))
    assert sorted(r.a for r in df.collect()) == [2, 3]
    q = tmp_path / "q"
    q.mkdir()
    (q / "20240101.jsonl").write_text('{"validator_findings": [{"code": "x"}, {"code": "y"}]}\n{"validator_findings": []}\n{"other": 1}\n{"validator_findings": [{"code": "x"}]}\n')
    assert {r.code: r.n for r in logs.quarantine_codes(spark, str(q)).collect()} == {"x": 2, "y": 1, "unspecified": 2}
    out = str(tmp_path / "out")
    logs.append_jsonl(spark.range(2), out)
    logs.append_jsonl(spark.range(3), out)
    assert spark.read.json(out).count() == 5


def test_golden(spark, tmp_path):
    good = {"queries": [{"id": "a", "query": "x", "language": "en", "relevant": [{"node_id": "n", "tier": "must"}, {"node_id": "m", "tier": "may"}]}, {"id": "b", "query": "y", "expect_no_result": True}]}
    (tmp_path / "g.json").write_text(json.dumps(good, indent=1))
    rows = {r.query_id: r for r in logs.golden(spark, str(tmp_path / "g.json")).collect()}
    assert rows["a"].must == ["n"] and rows["a"].may == ["m"] and rows["b"].slice == "none"
    for broken in ({"id": "a", "query": " ", "expect_no_result": True}, {"id": "c", "query": "z"}, {"id": "a", "query": "z", "expect_no_result": True}, {"id": "d", "query": "z", "relevant": [{"node_id": "n", "tier": "odd"}]}):
        (tmp_path / "b.json").write_text(json.dumps({"queries": [*good["queries"], broken]}))
        with pytest.raises(PySparkException):
            logs.golden(spark, str(tmp_path / "b.json")).collect()


def test_handbook(spark, sf_dir):
    nodes = Tables(spark, sf_dir).nodes()
    rows = {r.path: r.text for r in pages.handbook(nodes).collect()}
    assert "index.md" in rows and all(t.startswith("# ") for t in rows.values())
    known = nodes.where("status = 'active' AND type = 'persistent' AND project IS NOT NULL AND coalesce(verified, true)").count()
    assert sum(t.count("\n- **") for p, t in rows.items() if p != "index.md") == known
    assert "| a | b |" in pages.report("r", part=spark.createDataFrame([(1, "x|y")], "a int, b string"))


def test_published_pages(spark, tmp_path):
    folder, ledger = tmp_path / "book", str(tmp_path / "ledger")
    folder.mkdir()
    (folder / "mine.md").write_text("my own")
    (folder / "b.md").write_text("mine as well")

    def publish(**pages):
        df = spark.createDataFrame([(k.replace("__", "/") + ".md", v) for k, v in pages.items()] or [("x", "")], "path string, text string")
        done = {r.path: r.action for r in pages_.published(df if pages else df.where("false"), str(folder), ledger).collect()}
        return done, {str(p.relative_to(folder)): p.read_text() for p in folder.rglob("*.md")}

    pages_ = pages
    mine = {"mine.md": "my own", "b.md": "mine as well"}
    assert publish(a="A", p__q="Q", b="B") == ({"a.md": "written", "p/q.md": "written", "b.md": "foreign"}, {"a.md": "A", "p/q.md": "Q", **mine})
    assert publish(a="A", p__q="Q2", p__r="R") == ({"a.md": "kept", "p/q.md": "written", "p/r.md": "written"}, {"a.md": "A", "p/q.md": "Q2", "p/r.md": "R", **mine})
    # a project goes, and with it its folder
    assert publish(a="A") == ({"a.md": "kept", "p/q.md": "removed", "p/r.md": "removed"}, {"a.md": "A", **mine})
    assert not (folder / "p").exists()
    assert publish() == ({"a.md": "removed"}, mine)
    assert publish(a="again") == ({"a.md": "written"}, {"a.md": "again", **mine})


def test_a_run_of_pages_that_was_cut_short(spark, tmp_path, monkeypatch):
    folder, ledger = tmp_path / "book", str(tmp_path / "ledger")
    folder.mkdir()
    df = spark.createDataFrame([("a.md", "A"), ("b.md", "B")], "path string, text string")
    real = pages.checkpointed
    calls = []

    def failing(spark):
        cut = real(spark)

        def f(df):
            calls.append(1)
            out = cut(df)
            if len(calls) == 2:
                raise RuntimeError("the driver went")
            return out

        return f

    monkeypatch.setattr(pages, "checkpointed", failing)
    with pytest.raises(RuntimeError):
        pages.published(df, str(folder), ledger)
    monkeypatch.setattr(pages, "checkpointed", real)
    done = {r.path: r.action for r in pages.published(df.where("path = 'a.md'"), str(folder), ledger).collect()}
    assert done == {"a.md": "written", "b.md": "removed"} and sorted(p.name for p in folder.iterdir()) == ["a.md"]


def test_changes(spark):
    index = spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, v int")
    changes = spark.createDataFrame([("a", 2, 5, "upsert"), ("a", 1, 0, "delete"), ("b", 9, 0, "delete"), ("d", 1, 7, "upsert")], "path string, ts int, v int, action string")
    assert {r.path: r.v for r in S.apply_changes(index, changes).collect()} == {"a": 5, "c": 1, "d": 7}


def test_sync_replays(spark, tmp_path):
    src, store = tmp_path / "src", tmp_path / "store"
    schema = "path string, ts int, v int, action string"
    spark.createDataFrame([("a", 1, 5, "upsert"), ("b", 1, 1, "upsert")], schema).write.parquet(str(src / "1"))
    spark.createDataFrame([("a", 2, 0, "delete")], schema).write.parquet(str(src / "2"))
    state = {"n": 0}

    def read():
        return spark.read.parquet(str(store / str(state["n"]))) if state["n"] else spark.createDataFrame([], "path string, v int")

    def write(df):
        df.write.parquet(str(store / str(state["n"] + 1)))
        state["n"] += 1

    for _ in range(2):
        q = S.sync(spark.readStream.schema(schema).parquet(str(src / "*")), read, write, str(tmp_path / "cp"))
        q.awaitTermination()
    assert {r.path: r.v for r in read().collect()} == {"b": 1}


def test_watermark_by_key(spark, tmp_path):
    schema = "conv_id long, number long, body string"

    def put(k, rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))

    put(1, [(1, 0, "a"), (1, 1, "b"), (2, 0, "x")])
    name, done = "marks", []

    def run(**ttl):
        df = S.pending_turns(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), **ttl)
        with S.without_idle_batches(spark):
            q = df.writeStream.foreachBatch(lambda b, _: done.extend(tuple(r) for r in b.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination()
        out = sorted(done)
        done.clear()
        return out

    assert run() == [(1, 0, 1, False), (2, 0, 0, False)]
    put(2, [(1, 2, "c")])
    assert run() == [(1, 2, 2, False)]
    put(3, [(1, 1, "changed"), (2, 0, "x")])
    assert run() == [(1, 0, 2, True)]
    put(4, [(1, 1, "changed"), (1, 3, "d"), (2, 2, "z")])  # the same again, and what goes on
    assert run() == [(1, 3, 3, False), (2, 2, 2, False)]
    put(5, [(2, 1, "late")])
    assert run() == [(2, 0, 2, True)]


def test_a_forgotten_turn_is_known_by_its_prefix(spark, tmp_path):
    """Once digests have gone, a turn below the mark is doubtful, but a whole prefix is not."""

    class Value:
        def __init__(self):
            self.v = None

        exists = lambda self: self.v is not None
        get = lambda self: self.v

        def update(self, v):
            self.v = v

    class Map(dict):
        containsKey = lambda self, k: k in self
        getValue = dict.__getitem__
        updateValue = dict.__setitem__
        iterator = dict.items

    p = S.PendingTurns(1, 1)
    p.mark, p.turns = Value(), Map()
    told = lambda rows: [tuple(x) for df in p.handleInputRows((7,), iter([pd.DataFrame(rows, columns=["number", "body"])]), None) for x in df.itertuples(index=False)]
    assert told([(0, "a"), (1, "b")]) == [(7, 0, 1, False)]
    assert told([(2, "c")]) == [(7, 2, 2, False)]
    p.turns.clear()
    assert told([(0, "a"), (1, "b"), (2, "c"), (3, "d")]) == [(7, 3, 3, False)]
    p.turns.clear()
    assert told([(1, "b")]) == [(7, 0, 3, True)]


def test_count_or_clock(spark, tmp_path):
    at = lambda d, h: dt.datetime(2024, 1, d, h)
    rows = [[("a", at(1, 4), 20), ("b", at(1, 5), 5)], [("a", at(1, 6), 15), ("a", at(1, 7), 1)], [("c", at(2, 2), 3), ("c", at(2, 4), 3), ("b", at(3, 1), 2)]]
    for k, r in enumerate(rows):
        spark.createDataFrame(r, "key string, ts timestamp, n long").coalesce(1).write.parquet(str(tmp_path / "in" / str(k)))
    df = spark.readStream.schema("key string, ts timestamp, n long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    got = sorted((r.key, r["at"], r.fired, r.reason) for r in S.drained(spark, S.threshold_trigger(df), str(tmp_path / "fires")).collect())
    # what is left of c at the slot of the third and of b at that of the third has not come up yet
    assert got == [("a", at(1, 6), 35, "count"), ("a", at(2, 3), 1, "time"), ("b", at(2, 3), 5, "time"), ("c", at(2, 3), 3, "time")]


def test_days(spark):
    from memgrid.operators.events import day_window, upsert_snapshots

    df = spark.createDataFrame([(dt.datetime(2024, 1, 4, 23, 30),), (dt.datetime(2024, 1, 5, 22, 30),), (dt.datetime(2024, 1, 5, 23, 30),)], "ts timestamp")
    assert df.where(day_window(F.col("ts"), "2024-01-05", "Europe/Berlin")).count() == 2
    old, new = spark.createDataFrame([("d1", 1), ("d2", 1)], "day string, n int"), spark.createDataFrame([("d2", 2), ("d3", 2)], "day string, n int")
    assert {r.day: r.n for r in upsert_snapshots(old, new, True).collect()} == {"d1": 1, "d2": 2, "d3": 2}
    assert {r.day: r.n for r in upsert_snapshots(old, new, False).collect()} == {"d1": 1, "d2": 1, "d3": 2}
