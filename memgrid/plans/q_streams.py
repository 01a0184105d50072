"""Queries that run a stream over a table, or what a stream does to one batch."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgrid.operators.cuts import scratch_folder
from memgrid.operators.nodes import vectorless
from memgrid.plans.catalog import query
from memgrid.sources import pages
from memgrid.sources.logical import sql
from memgrid.streaming import pipelines as S

_CH = "CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END"


@query("WITH c AS (SELECT 'p' || (user_id % 300) AS path, ts, CASE WHEN event_type = 'error' THEN 'delete' ELSE 'upsert' END AS action, event_id FROM events), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY ts DESC, action DESC, event_id DESC) AS n FROM c) WHERE n = 1), i AS (SELECT 'p' || x AS path, CAST(0 AS BIGINT) AS event_id FROM range(200, 400) t(x)) SELECT coalesce(l.path, i.path) AS path, coalesce(l.event_id, i.event_id) AS event_id FROM i FULL JOIN l ON i.path = l.path WHERE coalesce(action, 'upsert') <> 'delete'")
def changes_applied(t):
    c = t.raw("events").select(F.concat(F.lit("p"), (F.col("user_id") % 300).cast("string")).alias("path"), "ts", F.expr(_CH).alias("action"), "event_id")
    c = c.withColumn("ts", F.struct("ts", "action", "event_id"))
    index = t.spark.range(200, 400).selectExpr("concat('p', cast(id as string)) path", "cast(0 as bigint) event_id")
    return S.apply_changes(index, c)


_LATE, _OTHER, _AGAIN = "(conv_id % 3 = 1 AND turn = 1)", "(conv_id % 5 = 2 AND turn = 0)", "conv_id % 7 = 3"


@query(f"WITH a AS (SELECT conv_id, min(turn) AS lo, max(turn) AS hi FROM conversations WHERE NOT {_LATE} GROUP BY conv_id), b AS (SELECT c.conv_id, bool_or({_OTHER} OR ({_LATE} AND turn <= hi)) AS rescan, max(turn) AS top, min(turn) FILTER (turn > coalesce(hi, -1)) AS first, max(hi) AS hi FROM conversations c LEFT JOIN a USING (conv_id) WHERE {_LATE} OR {_OTHER} OR {_AGAIN} GROUP BY c.conv_id) SELECT 1 AS delivery, conv_id, lo AS from_turn, hi AS to_turn, false AS rescan FROM a UNION ALL SELECT 2, conv_id, CASE WHEN coalesce(rescan, false) THEN 0 ELSE first END, greatest(top, coalesce(hi, -1)), coalesce(rescan, false) FROM b WHERE coalesce(rescan, false) OR first IS NOT NULL")
def pending_turns(t):
    """Turns in two deliveries: some of the second come late, some have another text, some are the same again."""
    c = t.raw("conversations").select("conv_id", "turn", F.col("turn").alias("number"), F.col("text").alias("body"))
    folder = scratch_folder(t.spark, "pending")
    again = c.where(f"{_LATE} OR {_OTHER} OR {_AGAIN}").withColumn("body", F.when(F.expr(_OTHER), F.concat("body", F.lit("!"))).otherwise(F.col("body")))
    for k, rows in enumerate((c.where(f"NOT {_LATE}"), again), 1):
        rows.drop("turn").write.parquet(f"{folder}/in/delivery={k}")
        df = t.spark.readStream.schema("conv_id long, number long, body string").parquet(f"{folder}/in/delivery=*")
        S.drained(t.spark, S.pending_turns(df), folder, "update", f"rows/delivery={k}")
    return t.spark.read.schema(f"{S.PENDING}, delivery int").parquet(f"{folder}/rows").select("delivery", "conv_id", "from_turn", "to_turn", "rescan")


_WM = "SELECT max(ts) AS wm FROM events"


@query(f"WITH e AS (SELECT user_id, ts, (floor((epoch(ts) - 10800) / 86400) + 1) * 86400 + 10800 AS due FROM events), g AS (SELECT user_id, due, count(*) AS n FROM e GROUP BY ALL), c AS (SELECT user_id, due, ts, row_number() OVER (PARTITION BY user_id, due ORDER BY ts) AS k FROM e) SELECT CAST(user_id AS VARCHAR) AS key, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at, CAST(4 AS BIGINT) AS fired, 'count' AS reason FROM c WHERE k % 4 = 0 UNION ALL SELECT CAST(user_id AS VARCHAR), strftime(make_timestamp(CAST(due AS BIGINT) * 1000000), '%Y-%m-%d %H:%M:%S'), n % 4, 'time' FROM g WHERE n % 4 > 0 AND (due <= (SELECT epoch(wm) FROM ({_WM})) OR EXISTS (SELECT 1 FROM e x WHERE x.user_id = g.user_id AND epoch(x.ts) >= g.due))")
def count_or_clock(t):
    """Each user's events fire at every fourth of a day, and what is left at three o'clock; what is left after the last slot does not."""
    df = t.spark.readStream.schema(t.raw("events").schema).parquet(_folder(t, "events")).select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.lit(1).alias("n"))
    rows = S.drained(t.spark, S.threshold_trigger(df, threshold=4), scratch_folder(t.spark, "trigger"))
    return rows.select("key", F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"), "fired", "reason")


@query("SELECT user_id, CAST(min(event_id) AS BIGINT) AS first_event, count(*) AS events FROM events GROUP BY user_id")
def events_once(t):
    df = t.spark.readStream.schema(t.raw("events").schema).parquet(_folder(t, "events")).withColumn("ts", F.col("ts").cast("timestamp"))
    twice = df.union(df)
    rows = S.drained(t.spark, S.retained(twice, "1000 days", ["event_id"]).select("user_id", "event_id"), scratch_folder(t.spark, "once"))
    return rows.groupBy("user_id").agg(F.min("event_id").alias("first_event"), F.count("*").alias("events"))


def _folder(t, name: str) -> str:
    """A stream reads folders; the table may be one file."""
    return f"{t.dir}/{name}.parq*t"


@query("WITH d AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 600 MINUTE THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM d) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS events FROM s GROUP BY user_id, k")
def idle_windows(t):
    return S.idle_sessions(t.raw("events"), "600 minutes").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "events")


@query(sql("SELECT node_id FROM nodes WHERE type <> 'transient' AND node_id NOT IN (SELECT node_id FROM vectors)"))
def reembed_retry(t):
    return vectorless(t.nodes().where("type <> 'transient'"), t.vectors()).select("node_id")


_CELL = "trim(replace({}, '|', chr(92) || '|'))"
_NL = "chr(10)"


@query(sql(f"SELECT project || '.md' AS path, sha256(t) AS digest FROM g UNION ALL SELECT 'index.md', sha256('# Handbook' || {_NL} || {_NL} || '| Project | Notes |' || {_NL} || '|---|---|' || {_NL} || string_agg('| [' || project || '](' || project || '.md) | ' || n || ' |', {_NL} ORDER BY project) || {_NL}) FROM g", f"w AS (SELECT project, coalesce(okf_type, 'untyped') AS kind, title, node_id, '- **' || {_CELL.format('title')} || '** — ' || {_CELL.format('left(title, 200)')} AS l FROM nodes WHERE status = 'active' AND type = 'persistent' AND project IS NOT NULL AND coalesce(verified, true))", f"p AS (SELECT project, kind, count(*) AS n, '## ' || upper(left(kind, 1)) || substr(kind, 2) || {_NL} || {_NL} || string_agg(l, {_NL} ORDER BY title, node_id) AS p FROM w GROUP BY project, kind)", f"g AS (SELECT project, CAST(sum(n) AS BIGINT) AS n, '# ' || project || {_NL} || {_NL} || string_agg(p, {_NL} || {_NL} ORDER BY kind) || {_NL} AS t FROM p GROUP BY project)"))
def handbook(t):
    return pages.handbook(t.nodes()).select("path", F.sha2("text", 256).alias("digest"))
