"""Queries on retrieval quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgrid.operators import evaluation as E
from memgrid.plans.catalog import query
from memgrid.sources.logical import sql

#: Results and golden labels with the shape of a search's, over documents and pages of it.
_RES = "res AS (SELECT seq % 60 AS query_id, row_number() OVER (PARTITION BY seq % 60 ORDER BY used_count * 7 % 5 DESC, node_id) AS pos, node_id, seq % 13 - 3 AS score, seq % 4 > 1 AS inject FROM nodes WHERE seq % 3 > 0)"
_GOLD = "gold AS (SELECT q AS query_id, CASE q % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'de' ELSE 'en' END AS slice, CASE WHEN q % 5 = 0 THEN [] ELSE coalesce(m, []) END AS must FROM (SELECT unnest(range(60)) AS q) LEFT JOIN (SELECT seq % 60 AS query_id, list(node_id) AS m FROM nodes WHERE (seq * 11 + seq // 60) % 17 < 3 GROUP BY 1) ON query_id = q)"
_ROWS = """rk AS (SELECT *, CASE WHEN score > 0 THEN count(*) FILTER (score > 0) OVER w END AS rp, CASE WHEN inject THEN count(*) FILTER (inject) OVER w END AS ri FROM res WINDOW w AS (PARTITION BY query_id ORDER BY pos)),
j AS (SELECT g.query_id, slice, must, node_id, pos, rp, ri, score, inject, list_contains(must, node_id) AS hit FROM gold g LEFT JOIN rk r ON r.query_id = g.query_id),
pq AS (SELECT query_id, slice, len(must) AS n_must, {recalls}, {mrrs}, coalesce(bool_or(hit AND pos = 1), false) AS top1, count(node_id) AS returned, count(*) FILTER (score > 0) AS positive, count(*) FILTER (inject) AS injected FROM j GROUP BY query_id, slice, must)""".format(
    recalls=", ".join(f"CASE WHEN len(must) > 0 THEN least(1, count(*) FILTER (hit AND {c} <= 5) / len(must)) ELSE 0 END AS {a}" for c, a in (("pos", "recall5"), ("rp", "recall5_pos"), ("ri", "recall5_inject"))),
    mrrs=", ".join(f"coalesce(1 / min(CASE WHEN hit AND {c} <= 10 THEN {c} END), 0) AS {a}" for c, a in (("pos", "mrr10"), ("rp", "mrr10_pos"))),
)
CTX = (_RES, _GOLD, _ROWS)


def _rows(t):
    n = t.nodes()
    res = n.where("seq % 3 > 0").selectExpr("seq % 60 query_id", "row_number() over (partition by seq % 60 order by used_count * 7 % 5 desc, node_id) pos", "node_id", "seq % 13 - 3 score", "seq % 4 > 1 inject")
    m = n.where("(seq * 11 + seq div 60) % 17 < 3").groupBy((F.col("seq") % 60).alias("query_id")).agg(F.collect_list("node_id").alias("m"))
    gold = n.sparkSession.range(60).withColumnRenamed("id", "query_id").join(m, "query_id", "left")
    none = F.array().cast("array<string>")
    gold = gold.select("query_id", F.expr("CASE query_id % 5 WHEN 0 THEN 'none' WHEN 1 THEN 'de' ELSE 'en' END").alias("slice"), F.when(F.col("query_id") % 5 == 0, none).otherwise(F.coalesce("m", none)).alias("must"))
    return E.per_query(res, gold)


@query(sql("SELECT query_id, slice, round(recall5, 6) AS recall5, round(recall5_pos, 6) AS recall5_pos, round(recall5_inject, 6) AS recall5_inject FROM pq", *CTX))
def recall_at_5(t):
    return _rows(t).select("query_id", "slice", *[F.round(c, 6).alias(c) for c in ("recall5", "recall5_pos", "recall5_inject")])


@query(sql("SELECT query_id, round(mrr10, 6) AS mrr10, round(mrr10_pos, 6) AS mrr10_pos, top1, returned, positive, injected FROM pq", *CTX))
def mrr_at_10(t):
    return _rows(t).select("query_id", F.round("mrr10", 6).alias("mrr10"), F.round("mrr10_pos", 6).alias("mrr10_pos"), "top1", "returned", "positive", "injected")


_M = ", ".join(f"round(coalesce(avg(CASE WHEN ranked THEN CAST({c} AS DOUBLE) END), 0), 4) AS {c}" for c in ("recall5", "recall5_pos", "recall5_inject", "mrr10", "mrr10_pos", "top1"))


@query(sql(f"SELECT part, count(*) AS n, {_M}, round(avg(CASE WHEN returned > 0 THEN positive / returned ELSE 0 END), 4) AS positive_rate, round(avg(CASE WHEN returned > 0 THEN injected / returned ELSE 0 END), 4) AS inject_rate, round(avg(CASE WHEN slice = 'none' THEN CAST(positive = 0 AS DOUBLE) END), 4) AS no_result_rate, round(avg(CASE WHEN slice = 'none' THEN CAST(injected = 0 AS DOUBLE) END), 4) AS no_result_rate_inject FROM (SELECT *, part = slice OR slice <> 'none' AS ranked FROM (SELECT *, unnest([slice, 'overall']) AS part FROM pq)) GROUP BY part", *CTX))
def eval_slices(t):
    return E.report(_rows(t))


@query(sql("SELECT query_id, run, latency_ms FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY latency_ms, run) AS p, count(*) OVER (PARTITION BY query_id) AS n FROM (SELECT user_id AS query_id, event_id AS run, value AS latency_ms FROM events)) WHERE p = n // 2 + 1"))
def median_run(t):
    return E.median_run(t.raw("events").selectExpr("user_id query_id", "event_id run", "value latency_ms"))


@query(sql("SELECT part, round(quantile_disc(latency_ms, 0.5), 1) AS p50, round(quantile_disc(latency_ms, 0.95), 1) AS p95, round(avg(CASE WHEN hits = 0 THEN 1.0 ELSE 0.0 END), 4) AS lexical_zero_rate FROM (SELECT unnest([event_type, 'overall']) AS part, value AS latency_ms, CAST(event_id AS BIGINT) % 7 AS hits FROM events) GROUP BY part"))
def eval_latency(t):
    rows = t.raw("events").selectExpr("event_id query_id", "event_type slice", "value latency_ms", "event_id % 7 lexical_hits")
    return E.latency_and_zero_hits(rows)
