"""Engines and episode guards on small cases."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from memgrid.functions import episodes as E
from memgrid.operators import engines


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_slug(spark):
    slug = lambda x: one(spark, E.english_slug(F.lit(x)))
    assert slug("The Gateway is Restarting 2024 at Café Zoë") == "gateway_restarting_cafe_zoe"
    assert slug("数据库") == "" and slug("to be") == "" and slug("a") == ""
    assert len(slug(" ".join(f"longword{i}" for i in range(9)))) <= 48


def test_truncated(spark):
    def cost(x):
        cjk = sum("㐀" <= c <= "鿿" for c in x)
        return cjk + math.ceil((len(x) - cjk) / 2)

    for x in ("abcdefghij", "数据abc据库d", "", "a"):
        got = one(spark, E.truncated(F.lit(x), 3))
        assert x.startswith(got) and (cost(got) <= 3 or len(got) == 1) and (got == x or cost(x[: len(got) + 1]) > 3)


def test_shards(spark):
    body = "## Takeaway\nt\n## A\n" + "x" * 50 + "\n## B\n" + "y" * 50 + "\n## Sources\n- s\n"
    parts = one(spark, E.shards(F.lit(body), 80))
    assert [p.count("## ") for p in parts] == [2, 1] and all(len(p) <= 80 for p in parts) and "Sources" not in "".join(parts)
    assert one(spark, E.shards(F.lit(body), 40)) is None and one(spark, E.shards(F.lit(body), 1000)) is None and one(spark, E.shards(F.lit("## Takeaway\nt\n## A\nx"), 80)) is None


def test_prefix_kept(spark):
    text = "## T1 User\na\n\n## T2 User\nb"
    h = hashlib.sha256(b"## T1 User\na").hexdigest()
    assert one(spark, E.prefix_kept(F.lit(text), F.lit(2), F.lit(h)))
    assert not one(spark, E.prefix_kept(F.lit(text.replace("a", "z")), F.lit(2), F.lit(h))) and not one(spark, E.prefix_kept(F.lit(text), F.lit(3), F.lit(h)))


def test_ladder_and_stamp(spark):
    t, f = F.lit(True), F.lit(False)
    assert [one(spark, E.update_ladder(*x)) for x in ((t, f, f), (f, t, f), (f, f, t), (f, f, f))] == ["updated", "merged", "repaired", "quarantined"]
    a, b = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z"))
    assert one(spark, E.stamped(F.lit("h"), F.lit("h"), a, b)) == ["x", "y", "z"] and one(spark, E.stamped(F.lit("h"), F.lit("g"), a, b)) is None
    assert one(spark, E.deferred(F.lit(1), F.lit(900), F.lit("h"), F.lit(None).cast("string"))) and not one(spark, E.deferred(F.lit(2), F.lit(900), F.lit("h"), F.lit("g")))


def test_engines(spark):
    df = spark.createDataFrame([("alpha beta",), ("beta alpha",), ("",), (None,)], "x string").select("x", engines.embedded(F.col("x"), dimension=48).alias("v"))
    v = {r.x: r.v for r in df.collect()}
    assert v[None] is None and all(abs(np.linalg.norm(v[k]) - 1) < 1e-6 for k in v if k is not None) and np.dot(v["alpha beta"], v["beta alpha"]) > 0.2

    def broken(dimension):
        def f(texts):
            raise OSError("no engine")

        return f

    engines.register("broken", broken)
    assert df.select(engines.embedded(F.col("x"), "broken").alias("v")).where("v IS NOT NULL").isEmpty()
    engines.register("ones", lambda d: lambda texts: pd.Series([[1.0] * d] * len(texts)))
    assert df.select(engines.embedded(F.col("x"), "ones", 3).alias("v")).first().v == [1.0] * 3
    d = engines.decided(spark.createDataFrame([(1, ["a", "b"]), (2, [])], "draft_id long, candidates array<string>"))
    assert {r.draft_id: (r.action, r.targets) for r in d.collect()} == {1: ("complement", ["a"]), 2: ("create", [])}
