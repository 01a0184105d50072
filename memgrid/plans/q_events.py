"""Queries on events."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgrid.operators import events as E
from memgrid.plans.catalog import query
from memgrid.sources.logical import NOW, RUN_COUNTERS, sql

P = "round(coalesce(quantile_disc(latency_ms, {}), 0), 1)"
_S = "s AS (SELECT *, len(list_filter(results, lambda r: r.inject)) AS k, len(results) AS m FROM searches)"
_STATS = f"count(*) AS searches, {P.format(0.5)} AS p50, {P.format(0.95)} AS p95, CAST(sum(k) AS BIGINT) AS injected, round(sum(k) / nullif(count(*), 0), 4) AS inject_rate, round(count(*) FILTER (k = 0) / nullif(count(*), 0), 4) AS zero_inject_share, round(sum(k) / nullif(sum(m), 0), 3) AS inject_rate_per_result"


@query(sql(f"SELECT strftime(ts, '%Y-%m-%d') AS day, {_STATS} FROM s GROUP BY day", _S))
def search_day_stats(t):
    return E.search_stats(t.searches(), F.date_format("ts", "yyyy-MM-dd").alias("day"))


@query(sql(f"SELECT strftime(ts, '%G-W%V') AS week, count(*) AS searches, {P.format(0.5)} AS p50, {P.format(0.95)} AS p95, coalesce(round(sum(k) / nullif(sum(m), 0), 3), 0) AS inject_rate FROM s GROUP BY week", _S))
def weekly_latency(t):
    """The rate is that of results."""
    df = E.search_stats(t.searches(), E.iso_week(F.col("ts")).alias("week"))
    return df.select("week", "searches", "p50", "p95", F.coalesce("inject_rate_per_result", F.lit(0.0)).alias("inject_rate"))


@query(sql(f"SELECT {_STATS} FROM s WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-06'", _S))
def one_day_stats(t):
    return E.search_stats(t.searches().where(E.day_window(F.col("ts"), "2024-01-05")))


@query(sql("SELECT source, count(*) AS searches, count(*) FILTER (k = 0) AS zero_inject, coalesce(round(sum(k) / nullif(sum(m), 0), 3), 0) AS rate FROM s GROUP BY source", _S))
def inject_rate_by_source(t):
    return E.by_source(t.searches())


@query(sql("SELECT session_hash, count(*) AS searches FROM s WHERE session_hash IS NOT NULL GROUP BY session_hash HAVING max(k) = 0", _S))
def zero_inject_sessions(t):
    return E.zero_inject_sessions(t.searches())


_N = "n AS (SELECT node_id, count(*) AS n FROM hits WHERE inject GROUP BY node_id)"


@query(sql("(SELECT node_id, n, 'most' AS edge FROM n ORDER BY n DESC, node_id LIMIT 5) UNION ALL (SELECT node_id, n, 'least' FROM n ORDER BY n, node_id DESC LIMIT 5)", _N))
def top_injected(t):
    return E.injection_extremes(t.searches())


@query(sql("SELECT dimension, value, count(*) AS n FROM (SELECT 'total' AS dimension, 'all' AS value FROM writes UNION ALL SELECT 'failures', 'all' FROM writes WHERE NOT execution_succeeded UNION ALL SELECT 'route', coalesce(route, sampling_provider, 'unknown') FROM writes UNION ALL SELECT 'action', coalesce(action, 'none') FROM writes UNION ALL SELECT 'warning', unnest(warning_codes) FROM writes) GROUP BY ALL"))
def write_mix(t):
    return E.write_mix(t.writes())


_R = "r AS (SELECT *, coalesce(trigger, 'legacy') AS t, CASE WHEN trigger IS NULL THEN [] ELSE attempts END AS seen FROM runs), a AS (SELECT run_id, unnest(seen) AS x FROM r), f AS (SELECT run_id, count(*) AS n FROM a WHERE x.outcome = 'failed' GROUP BY run_id), q AS (SELECT r.*, CASE WHEN t = 'legacy' THEN failures ELSE greatest(0, failures - coalesce(n, 0)) END AS rest FROM r LEFT JOIN f USING (run_id))"


@query(sql("""SELECT dimension, value, CAST(sum(n) AS BIGINT) AS n FROM (
SELECT 'sum' AS dimension, 'runs' AS value, count(*) AS n FROM q UNION ALL SELECT 'sum', 'failures', sum(failures) FROM q UNION ALL SELECT 'sum', 'items_extracted', sum(items_extracted) FROM q
UNION ALL SELECT 'sum', 'items_created', sum(items_created) FROM q UNION ALL SELECT 'sum', 'items_quarantined', sum(items_quarantined) FROM q UNION ALL SELECT 'trigger', t, count(*) FROM q GROUP BY t
UNION ALL SELECT 'sum', 'attempts', count(*) FROM a UNION ALL SELECT 'sum', 'unattributed_runs', count(*) FROM q WHERE t = 'legacy' OR rest > 0 UNION ALL SELECT 'stage', 'unknown', sum(rest) FROM q
UNION ALL SELECT 'outcome', CASE WHEN x.outcome IN ('distilled', 'skipped', 'deferred', 'failed') THEN x.outcome ELSE 'unknown' END AS o, count(*) FROM a GROUP BY o
UNION ALL SELECT 'stage', CASE WHEN x.stage IN ('extract', 'write') THEN x.stage ELSE 'unknown' END AS o, count(*) FROM a WHERE x.outcome = 'failed' GROUP BY o
UNION ALL SELECT 'sum', 'sessions', count(DISTINCT x.session) FROM a) GROUP BY ALL HAVING sum(n) > 0""", _R))
def distiller_yield(t):
    return E.distiller_yield(t.runs())


RUNS_NOW = "1997-06-01 00:00:00"
_W = f"started_at <= TIMESTAMP '{RUNS_NOW}' AND started_at >= TIMESTAMP '{RUNS_NOW}' - INTERVAL {{}} DAY"


@query(sql(f"SELECT count(*) AS runs, CAST(sum(items_created) AS BIGINT) AS created, round(avg(items_created), 4) AS avg_created, count(*) FILTER ({_W.format(1)}) AS last_24h, count(*) FILTER ({_W.format(7)}) AS last_7d, count(*) FILTER ({_W.format(30)}) AS last_30d FROM runs"))
def run_windows(t):
    return E.run_windows(t.runs(), F.lit(RUNS_NOW).cast("timestamp"))


@query(sql("""SELECT *, round(related / judged, 4) AS precision, round(greatest(0, (p + 3.8416 / (2 * judged)) / (1 + 3.8416 / judged) - h), 4) AS low, round(least(1, (p + 3.8416 / (2 * judged)) / (1 + 3.8416 / judged) + h), 4) AS high
FROM (SELECT *, related / judged AS p, 1.96 * sqrt((related / judged) * (1 - related / judged) / judged + 3.8416 / (4 * judged * judged)) / (1 + 3.8416 / judged) AS h
  FROM (SELECT source, count(*) AS judged, count(*) FILTER ((event_id + rank) % 4 > 0) AS related, count(*) FILTER ((event_id + rank) % 4 > 1) AS useful FROM hits WHERE inject GROUP BY source))""").replace("SELECT *, round(related", "SELECT source, judged, related, useful, round(related"))
def wilson_precision(t):
    judged = E.hits(t.searches()).where("inject").withColumn("grade", F.least(F.lit(2), (F.col("event_id") + F.col("rank")) % 4))
    return E.precision_by(judged, "source")


@query(sql("SELECT strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS earliest FROM (SELECT min(ts) AS ts FROM searches UNION ALL SELECT min(created_at) FROM nodes UNION ALL SELECT min(created_at) FROM writes UNION ALL SELECT min(started_at) FROM runs UNION ALL SELECT min(started_at) FROM maintenance)"))
def earliest_event(t):
    return E.earliest((t.searches(), "ts"), (t.nodes(), "created_at"), (t.writes(), "created_at"), (t.runs(), "started_at"), (t.maintenance(), "started_at")).select(F.date_format("earliest", "yyyy-MM-dd HH:mm:ss").alias("earliest"))


_SNAP = f"SELECT coalesce(a.day, b.day) AS day, coalesce(searches, 0) AS searches, p95, coalesce(injected, 0) AS injected, coalesce(writes, 0) AS writes, coalesce(failures, 0) AS failures FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS searches, {P.format(0.95)} AS p95, CAST(sum(k) AS BIGINT) AS injected FROM s GROUP BY 1) a FULL JOIN (SELECT CAST(created_at AS DATE) AS day, count(*) AS writes, count(*) FILTER (NOT execution_succeeded) AS failures FROM writes GROUP BY 1) b ON a.day = b.day"


@query(sql(f"SELECT strftime(day, '%Y-%m-%d') AS day, searches, p95, injected, writes, failures FROM ({_SNAP})", _S))
def daily_snapshot(t):
    return E.daily_snapshot(t.searches(), t.writes()).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_BACK = 200
_DAYS = f"ev AS (SELECT min(ts) AS t FROM (SELECT min(ts) AS ts FROM searches UNION ALL SELECT min(created_at) FROM writes UNION ALL SELECT min(started_at) FROM runs UNION ALL SELECT min(created_at) FROM nodes)), spine AS (SELECT CAST(unnest(generate_series(greatest(CAST(CAST(t AS DATE) AS TIMESTAMP), TIMESTAMP '{NOW}' - INTERVAL {_BACK} DAY), TIMESTAMP '{NOW}', INTERVAL 1 DAY)) AS DATE) AS day FROM ev), snap AS ({_SNAP}), made AS (SELECT CAST(created_at AS DATE) AS day, type = 'transient' AS tr, strlen(content) AS b FROM nodes)"


@query(sql("SELECT strftime(day, '%Y-%m-%d') AS day, coalesce(searches, 0) AS searches, p95, coalesce(injected, 0) AS injected, coalesce(writes, 0) AS writes, coalesce(failures, 0) AS failures, coalesce(r.n, 0) AS runs, CAST(coalesce(r.c, 0) AS BIGINT) AS created, CASE WHEN k > 0 THEN nodes END AS nodes, CASE WHEN k > 0 THEN transcripts END AS transcripts, CAST(bytes AS BIGINT) AS bytes FROM spine LEFT JOIN snap USING (day) LEFT JOIN (SELECT CAST(started_at AS DATE) AS day, count(*) AS n, sum(items_created) AS c FROM runs GROUP BY 1) r USING (day) LEFT JOIN (SELECT spine.day, count(made.day) AS k, count(*) FILTER (NOT tr) AS nodes, count(*) FILTER (tr) AS transcripts, sum(b) AS bytes FROM spine LEFT JOIN made ON made.day <= spine.day GROUP BY spine.day) USING (day)", _S, _DAYS))
def daily_stocks(t):
    """Each day of the last two hundred, with events and stocks."""
    return E.daily_snapshots(t.searches(), t.writes(), t.runs(), t.nodes(), NOW, _BACK).withColumn("day", F.date_format("day", "yyyy-MM-dd"))


_SUMS = "CAST(coalesce(sum({0}), 0) AS BIGINT) AS total, round(avg({0}), 4) AS average, " + ", ".join(f"CAST(coalesce(sum({{0}}) FILTER ({_W.format(d)}), 0) AS BIGINT) AS last_{d}d" for d in (1, 7, 30))


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS counter, {_SUMS.format(c)} FROM maintenance" for c in ("duration_ms", *RUN_COUNTERS))))
def maintenance_totals(t):
    """All counters of the maintenance runs."""
    return E.run_totals(t.maintenance(), F.lit(RUNS_NOW).cast("timestamp"), ("duration_ms", *RUN_COUNTERS))


@query(sql("SELECT day, CAST(max(n) AS BIGINT) AS n FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM searches WHERE ts < TIMESTAMP '2024-01-20' GROUP BY 1 UNION ALL SELECT strftime(ts, '%Y-%m-%d'), 0 FROM searches WHERE ts >= TIMESTAMP '2024-01-15' GROUP BY 1) GROUP BY day"))
def snapshot_upsert(t):
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    old = t.searches().where("ts < timestamp'2024-01-20'").groupBy(day).agg(F.count("*").alias("n"))
    new = t.searches().where("ts >= timestamp'2024-01-15'").groupBy(day).agg(F.lit(0).cast("long").alias("n"))
    return E.upsert_snapshots(old, new, replace=False)


@query(sql("SELECT event_type AS source, round(quantile_disc(value, 0.5), 1) AS p50, round(quantile_disc(value, 0.95), 1) AS p95 FROM events GROUP BY 1"))
def percentile_nearest_rank(t):
    return t.searches().groupBy("source").agg(E.nearest_rank("latency_ms", 0.5).alias("p50"), E.nearest_rank("latency_ms", 0.95).alias("p95"))


_AUD = "aud AS (SELECT * FROM (SELECT h.*, row_number() OVER (ORDER BY sha1(concat(CAST(event_id AS VARCHAR), ':', node_id, '7')), concat(CAST(event_id AS VARCHAR), ':', node_id)) AS p FROM hits h WHERE inject AND source IN ('view', 'click')) WHERE p <= 300), jd AS (SELECT a.source, n.title, (event_id + rank) % 3 AS grade FROM aud a JOIN nodes n USING (node_id) WHERE n.status <> 'disputed')"


@query(sql("""SELECT source, judged, related, useful, round(related / judged, 4) AS precision, round(greatest(0, (p + 3.8416 / (2 * judged)) / (1 + 3.8416 / judged) - h), 4) AS low, round(least(1, (p + 3.8416 / (2 * judged)) / (1 + 3.8416 / judged) + h), 4) AS high
FROM (SELECT *, related / judged AS p, 1.96 * sqrt((related / judged) * (1 - related / judged) / judged + 3.8416 / (4 * judged * judged)) / (1 + 3.8416 / judged) AS h
  FROM (SELECT source, count(*) AS judged, count(*) FILTER (grade > 0) AS related, count(*) FILTER (grade > 1) AS useful FROM jd GROUP BY source))""", _AUD))
def injection_audit(t):
    """What was injected by two sources, a sample of 300, as a judge grades it; nodes that are gone, here disputed, drop out."""
    judge = lambda df: df.withColumn("grade", (F.col("event_id") + F.col("rank")) % 3)
    return E.injection_audit(t.searches(), t.nodes().where("status <> 'disputed'"), judge, 300, ("view", "click"))


@query(sql("SELECT n.node_id, title, n FROM (SELECT node_id, count(*) AS n FROM hits WHERE inject GROUP BY node_id) n LEFT JOIN (SELECT node_id, title FROM nodes WHERE seq % 5 > 0) USING (node_id)"))
def injected_titles(t):
    """Injected nodes with their titles, null for those that are gone."""
    n = E.hits(t.searches()).where("inject").groupBy("node_id").agg(F.count("*").alias("n"))
    return n.join(t.nodes().where("seq % 5 > 0").select("node_id", "title"), "node_id", "left").select("node_id", "title", "n")


@query("SELECT user_id, CASE user_id % 6 WHEN 0 THEN 30 WHEN 1 THEN 84 WHEN 2 THEN 180 WHEN 3 THEN CASE WHEN user_id > 0 THEN user_id END END AS days FROM (SELECT DISTINCT CAST(user_id AS INTEGER) AS user_id FROM events)")
def window_days(t):
    """F50."""
    from memgrid.functions.text import window_days as days

    u = t.raw("events").select(F.col("user_id").cast("int").alias("user_id")).distinct()
    text = F.expr("CASE user_id % 6 WHEN 0 THEN '30d' WHEN 1 THEN ' 12W' WHEN 2 THEN '6 m' WHEN 3 THEN cast(user_id as string) WHEN 4 THEN '0d' ELSE '3y' END")
    return u.select("user_id", days(text).alias("days"))


@query(sql("""SELECT 'quarantine_rate' AS metric, CAST(coalesce(round(sum(items_quarantined) / nullif(sum(items_extracted) + sum(items_quarantined), 0), 4), 0) AS DOUBLE) AS value FROM runs
UNION ALL SELECT 'zero_item_ratio', CAST(coalesce(round(count(*) FILTER (items_extracted = 0) / nullif(count(*), 0), 4), 0) AS DOUBLE) FROM runs
UNION ALL SELECT 'code:' || code, CAST(coalesce(max(n) FILTER (f), max(n)) AS DOUBLE) FROM (SELECT 'w' || CAST(seq % 7 AS VARCHAR) AS code, count(*) AS n, true AS f FROM nodes WHERE seq % 7 < 4 GROUP BY 1 UNION ALL SELECT code, count(*), false FROM (SELECT unnest(warning_codes) AS code FROM writes) GROUP BY 1) GROUP BY code
UNION ALL SELECT 'dreams_last_7d', CAST(count(*) AS DOUBLE) FROM runs WHERE started_at > TIMESTAMP '1998-06-01' - INTERVAL 7 DAY AND started_at <= TIMESTAMP '1998-06-01'"""))
def gate_health(t):
    """A23."""
    files = t.nodes().where("seq % 7 < 4").groupBy(F.concat(F.lit("w"), (F.col("seq") % 7).cast("string")).alias("code")).agg(F.count("*").alias("n"))
    stored = t.writes().select(F.explode("warning_codes").alias("code")).groupBy("code").agg(F.count("*").alias("n"))
    return E.gate_health(t.runs(), files, stored, t.runs(), F.lit("1998-06-01").cast("timestamp"))


@query(sql("SELECT r AS retrieved, i AS injected, 0 AS used, round(i / nullif(r, 0), 4) AS pass_rate, round(0 / nullif(i, 0), 4) AS conversion_rate FROM (SELECT count(*) AS r, count(*) FILTER (inject) AS i FROM hits)"))
def funnel_from_events(t):
    """Nodes without counters."""
    n = t.nodes().withColumns({f"{c}_count": F.lit(0) for c in ("retrieved", "injected", "used")})
    return E.funnel(n, t.searches()).withColumn("used", F.col("used").cast("int"))
