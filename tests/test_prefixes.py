"""The pass over sorted texts against all pairs, over ranges of every size."""

from __future__ import annotations

import random

import pytest

from memgrid.operators import nodes as N, prefixes as P


def texts(seed: int) -> list[tuple[str, str, int, str]]:
    rng = random.Random(seed)
    out = {}
    for g in ("a", "b", "", "ab"):
        stems = ["", "x", "é", "xy" * 40]
        for _ in range(60):
            body = rng.choice(stems) + "".join(rng.choices(["p", "q", "é", "漢", " "], k=rng.randint(0, 4)))
            stems.append(body)
            out[g, body] = None
    for k in range(1, 120):  # one text that grows, as saved again and again
        out["grows", "turn " * k] = None
    for k in range(40):
        out["flat", f"{k:03}"] = None
    return [(g, b, rng.randint(-5, 60), f"n{i}") for i, (g, b) in enumerate(out)]


@pytest.fixture
def ranges(spark):
    """As many ranges as the test asks for, not fewer."""
    keep = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}

    def of(n: int):
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        spark.conf.set("spark.sql.shuffle.partitions", str(n))

    yield of
    for k, v in keep.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize(("seed", "n"), [(1, 1), (2, 3), (3, 17), (4, 60)])
def test_pass_equals_all_pairs(spark, ranges, seed, n):
    rows = texts(seed)
    ranges(n)
    df = spark.createDataFrame(rows, "grp string, body string, stamp long, best string").selectExpr("grp", "body", "cast(best as binary) key", "stamp", "best")
    got = {bytes(r["key"]).decode(): (r.stamp, r["best"]) for r in P.newest_longer(df).collect()}
    want = {}
    for g, b, _, i in rows:
        longer = [(s, j) for h, c, s, j in rows if h == g and c != b and c.startswith(b)]
        if longer:
            want[i] = max(longer)
    assert got == want


@pytest.mark.parametrize("copies", [1, 1000])
def test_prefix_duplicates_of_copies_and_odd_rows(spark, copies, monkeypatch):
    monkeypatch.setattr(N, "COPIES", copies)
    rows = [("a", "T", "one  two", 1), ("b", "T", "One two three", 5), ("c", "T", "one two three", 9), ("d", "T", "one two three four", 9), ("e", "U", "one two three four five", 99), ("f", None, "one", 1), ("g", "T", None, 1), ("h", "T", "", 4), ("i", "T", "one two", 20), ("k", "T", "One two", 2), ("j", "T", "one two", None)]
    df = spark.createDataFrame(rows, "node_id string, title string, content string, at long").selectExpr("node_id", "title", "content", "timestamp_seconds(at) created_at")
    assert sorted(map(tuple, N.prefix_duplicates(df).collect())) == [("a", "d"), ("b", "d"), ("h", "i"), ("k", "d")]
    assert N.prefix_duplicates(df.where("false")).count() == 0
