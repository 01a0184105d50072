"""Banners, provenance, related links, tools and payloads."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from memgrid.functions import bodies as B
from memgrid.operators import evaluation


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_banners(spark):
    day = F.lit("2024-01-31").cast("date")
    ids = F.array(F.lit("mem_a"), F.lit(""), F.lit("mem_b"))
    x = B.with_banners(F.lit("body\n\n> quote"), F.lit("mem_new"), day, ids, F.lit(" why "))
    text = one(spark, x)
    assert text.startswith("> ⚠️ **SUPERSEDED** by [[mem_new]] on 2024-01-31.\n> This node") and text.count("> **Supersedes**: [[mem_") == 2 and "— why" in text
    assert one(spark, B.without_banners(x)) == "body\n\n> quote"
    assert one(spark, B.with_banners(x, F.lit(None).cast("string"), day, F.array().cast("array<string>"), F.lit(None).cast("string"))) == "body\n\n> quote"


def test_provenance(spark):
    body = "## Takeaway\nt\n## Related\n- [[mem_a|x]]\n- [[mem_session_1]]\n## Sources\n- [[s]]\n## Details\nd\n"
    assert one(spark, B.without_provenance(F.lit(body))) == "## Takeaway\nt\n## Details\nd"
    assert one(spark, B.with_provenance(F.lit(body), F.array(F.lit("s1")))) == "## Takeaway\nt\n## Details\nd\n\n## Related\n\n- [[mem_a]]\n\n## Sources\n\n- [[s1]]\n"


def test_related(spark):
    body = "a\n\n## Related\n- [[x]]\n\nmiddle\n\n## Related\n- [[y]]\n- [[x]]\n"
    assert one(spark, B.related_merged(F.lit(body))) == "a\n\nmiddle\n\n## Related\n- [[x]]\n- [[y]]"
    assert one(spark, B.linked(F.lit(body), F.array(F.lit("x"), F.lit("z")))) == "a\n\nmiddle\n\n## Related\n- [[x]]\n- [[y]]\n- [[z]]"
    assert one(spark, B.linked(F.lit(" a "), F.array().cast("array<string>"))) == "a"


def test_turns(spark):
    turn = lambda role, body, *tools: F.struct(F.lit(1).alias("number"), F.lit(role).alias("role"), F.lit(body).alias("body"), F.array(*map(F.lit, tools)).cast("array<string>").alias("tools"))
    noise, hub, real = "### Tool T1.1 wait\ncall: 1", '### Tool T1.2 hub\ncall: {"op": "Poll"}', '### Tool T1.3 hub\ncall: {"op": "run"}\nresult [ok]: done it'
    got = one(spark, B.dehydrated(F.array(turn("User", "", noise), turn("Assistant", "", noise, hub), turn("Assistant", "", real))))
    assert [(t.role, len(t.tools)) for t in got] == [("User", 0), ("Assistant", 1)]
    cut = one(spark, B.excerpt(turn("Assistant", "b" * 100, "x" * 100, "y" * 10), 60))
    assert len(cut) <= 60 and cut.startswith("b" * 30) and "x" in cut and "y" in cut and one(spark, B.excerpt(turn("User", "abc"), 2)) == "ab"
    t = turn("Assistant", "I say so", real)
    assert [one(spark, B.evidence_source(t, F.lit(q))) for q in ("say  SO", "done it", "else")] == ["assistant", "tool_result", "assistant"] and one(spark, B.evidence_source(turn("User", "x"), F.lit("q"))) == "user"


def test_payloads(spark):
    ok = {"decision": {"action": "create", "target_node_ids": [], "confidence": 0.5}, "audit": {"grade": 2}, "normalize": {"okf_type": "fact", "title": "t", "content": "c"}, "lessons": {"lessons": [{"title": "t", "okf_type": "fact", "content": "c", "evidence": []}]}}
    bad = {"decision": {"action": "erase"}, "audit": {"grade": 3}, "normalize": {"okf_type": "fact", "title": " ", "content": "c"}, "lessons": {"lessons": [{"title": "t", "okf_type": "odd", "content": "c"}]}}
    for k in ok:
        assert one(spark, B.payload(F.lit(json.dumps(ok[k])), k)) is not None and one(spark, B.payload(F.lit(f"Here:\n```json\n{json.dumps(ok[k])}\n```\n"), k)) is not None
        assert one(spark, B.payload(F.lit(json.dumps(bad[k])), k)) is None and one(spark, B.payload(F.lit("no json"), k)) is None


def test_history_line(spark):
    df = spark.createDataFrame([("overall", 3, 0.5), ("en", 2, 0.25)], "part string, n long, recall5 double")
    line = json.loads(evaluation.history_line(df, "2024-01-31T00:00:00Z", "h").first().value)
    assert line["overall"]["n"] == 3 and line["slices"]["en"]["recall5"] == 0.25
