"""Analytics of search, write and run events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memgrid.operators.nodes import hash_sample, ratio

OUTCOMES = ("distilled", "skipped", "deferred", "failed")
STAGES = ("source_lookup", "scanner", "gatekeeper", "write", "extract", "integrate", "unknown")


def day_window(ts: Column, day: str, zone: str = "UTC") -> Column:
    """Whether an instant is on a calendar day of a zone; half open."""
    start = F.to_utc_timestamp(F.lit(day).cast("timestamp"), zone)
    end = F.to_utc_timestamp(F.lit(day).cast("timestamp") + F.make_dt_interval(F.lit(1)), zone)
    return (ts >= start) & (ts < end)


def nearest_rank(column: str, p: float) -> Column:
    """The value at place ceil(p * n), rounded to one digit; 0 without values."""
    return F.round(F.coalesce(F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {column})"), F.lit(0.0)), 1)


def injected(results: str = "results") -> Column:
    """How many of a search's results were injected; a search without results has none."""
    return F.coalesce(F.size(F.filter(results, lambda r: r["inject"])), F.lit(0))


def search_stats(searches: DataFrame, *by: Column) -> DataFrame:
    """Volume, latency and injection; the rate is per search."""
    df = searches.select("*", *[c for c in by], injected().alias("_in"))
    names = df.columns[len(searches.columns) : -1]
    out = df.groupBy(*names).agg(
        F.count("*").alias("searches"), nearest_rank("latency_ms", 0.5).alias("p50"), nearest_rank("latency_ms", 0.95).alias("p95"),
        F.sum("_in").cast("long").alias("injected"), F.count_if(F.col("_in") == 0).alias("zero"), F.sum(F.size("results")).cast("long").alias("results"),
    )
    return out.select(*names, "searches", "p50", "p95", "injected", ratio(F.col("injected"), F.col("searches")).alias("inject_rate"), ratio(F.col("zero"), F.col("searches")).alias("zero_inject_share"), ratio(F.col("injected"), F.col("results"), 3).alias("inject_rate_per_result"))


def iso_week(ts: Column) -> Column:
    """Year and week, as in 2024-W05."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), ts).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), ts).cast("string"), 2, "0"))


def by_source(searches: DataFrame) -> DataFrame:
    """The share of results that were injected, and the searches without one."""
    df = searches.groupBy("source").agg(F.count("*").alias("searches"), F.sum(injected()).cast("long").alias("injected"), F.sum(F.size("results")).cast("long").alias("results"), F.count_if(injected() == 0).alias("zero_inject"))
    return df.select("source", "searches", "zero_inject", F.coalesce(ratio(F.col("injected"), F.col("results"), 3), F.lit(0.0)).alias("rate"))


def zero_inject_sessions(searches: DataFrame) -> DataFrame:
    """Sessions of which no search injected anything; searches without a session don't count."""
    return searches.where("session_hash IS NOT NULL AND session_hash <> ''").groupBy("session_hash").agg(F.bool_or(injected() > 0).alias("hit"), F.count("*").alias("searches")).where("NOT hit").select("session_hash", "searches")


def hits(searches: DataFrame) -> DataFrame:
    """A row for each result."""
    return searches.select("event_id", "ts", "source", "session_hash", F.explode("results").alias("r")).select("event_id", "ts", "source", "session_hash", "r.*")


def injection_extremes(searches: DataFrame, k: int = 5) -> DataFrame:
    """The k most and the k least injected nodes of those injected at all; each end is a top-k."""
    n = hits(searches).where("inject").groupBy("node_id").agg(F.count("*").alias("n"))
    top = n.orderBy(F.desc("n"), "node_id").limit(k).withColumn("edge", F.lit("most"))
    return top.union(n.orderBy("n", F.desc("node_id")).limit(k).withColumn("edge", F.lit("least")))


def write_mix(writes: DataFrame) -> DataFrame:
    """Totals, failures, routes, actions and warnings as (dimension, value, n)."""
    pairs = F.concat(
        F.array(F.struct(F.lit("total").alias("dimension"), F.lit("all").alias("value")), F.struct(F.lit("route").alias("dimension"), F.coalesce("route", "sampling_provider", F.lit("unknown")).alias("value")), F.struct(F.lit("action").alias("dimension"), F.coalesce("action", F.lit("none")).alias("value"))),
        F.when(~F.col("execution_succeeded"), F.array(F.struct(F.lit("failures").alias("dimension"), F.lit("all").alias("value")))).otherwise(F.array().cast("array<struct<dimension:string,value:string>>")),
        F.transform("warning_codes", lambda w: F.struct(F.lit("warning").alias("dimension"), w.alias("value"))),
    )
    return writes.select(F.explode(pairs).alias("x")).select("x.*").groupBy("dimension", "value").agg(F.count("*").alias("n"))


def distiller_yield(runs: DataFrame) -> DataFrame:
    """A10: sums; failures of runs that attempts don't explain go to the stage `unknown`.

    A run without a trigger or without a list of attempts is not attributed at all. Two levels: a
    row for each run first, then (dimension, value, n).
    """
    t = F.coalesce("trigger", F.lit("legacy"))
    plain = (t == "legacy") | F.col("attempts").isNull()
    seen = F.when(plain, F.array().cast(runs.schema["attempts"].dataType)).otherwise(F.col("attempts"))
    failed = F.filter(seen, lambda a: a["outcome"] == "failed")
    rest = F.when(plain, F.col("failures")).otherwise(F.greatest(F.lit(0), F.col("failures") - F.size(failed)))

    def item(d: str, v: Column | str, n: Column | int) -> Column:
        return F.struct(F.lit(d).alias("dimension"), (F.lit(v) if isinstance(v, str) else v).alias("value"), (F.lit(n) if isinstance(n, int) else n).cast("long").alias("n"))

    outcome = lambda a: F.when(a["outcome"].isin(*OUTCOMES), a["outcome"]).otherwise("unknown")
    stage = lambda a: F.when(a["stage"].isin(*STAGES), a["stage"]).otherwise("unknown")
    items = F.concat(
        F.array(item("sum", "runs", 1), item("sum", "failures", F.col("failures")), item("sum", "items_extracted", F.col("items_extracted")), item("sum", "items_created", F.col("items_created")), item("sum", "items_quarantined", F.col("items_quarantined")), item("trigger", t, 1), item("sum", "attempts", F.size(seen)), item("sum", "unattributed_runs", (plain | (rest > 0)).cast("int")), item("stage", "unknown", rest)),
        F.transform(seen, lambda a: item("outcome", outcome(a), 1)),
        F.transform(failed, lambda a: item("stage", stage(a), 1)),
    )
    out = runs.select(F.explode(items).alias("x")).select("x.*").groupBy("dimension", "value").agg(F.sum("n").alias("n"))
    sessions = runs.select(F.explode(F.transform(seen, lambda a: a["session"])).alias("s")).where("s <> ''").agg(F.countDistinct("s").alias("n")).select(F.lit("sum").alias("dimension"), F.lit("sessions").alias("value"), "n")
    return out.union(sessions).where("n > 0")


def run_windows(runs: DataFrame, now: Column) -> DataFrame:
    """All, and those of the last day, week and month."""
    since = lambda d: F.count_if((F.col("started_at") >= now - F.make_dt_interval(F.lit(d))) & (F.col("started_at") <= now))
    return runs.agg(F.count("*").alias("runs"), F.sum("items_created").alias("created"), F.round(F.avg("items_created"), 4).alias("avg_created"), since(1).alias("last_24h"), since(7).alias("last_7d"), since(30).alias("last_30d"))


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """The 95 % interval of a share, clipped to [0, 1], four digits; null over nothing."""
    n = F.nullif(n.cast("double"), F.lit(0.0))
    p, zz = k / n, z * z
    mid, half = (p + zz / (2 * n)) / (1 + zz / n), z * F.sqrt(p * (1 - p) / n + zz / (4 * n * n)) / (1 + zz / n)
    return F.round(F.greatest(F.lit(0.0), mid - half), 4), F.round(F.least(F.lit(1.0), mid + half), 4)


def precision_by(judged: DataFrame, by: str) -> DataFrame:
    """Of judged results (grade 0, 1 or 2) the related (1 or more) and useful (2) ones."""
    df = judged.groupBy(by).agg(F.count("*").alias("judged"), F.count_if(F.col("grade") >= 1).alias("related"), F.count_if(F.col("grade") == 2).alias("useful"))
    lo, hi = wilson(F.col("related"), F.col("judged"))
    return df.select("*", ratio(F.col("related"), F.col("judged")).alias("precision"), lo.alias("low"), hi.alias("high"))


def injection_audit(searches: DataFrame, nodes: DataFrame, judge: Callable[[DataFrame], DataFrame], n: int, sources: tuple[str, ...], by: str = "source") -> DataFrame:
    """Precision of what was injected: a sample of n injected results of some sources, with their nodes, as a judge grades it.

    judge adds `grade` (0, 1 or 2) to event_id, source, rank, node_id, title and content; a result
    whose node is gone is sampled, but not judged (J15). The sample is the same each time.
    """
    rows = hits(searches).where(F.col("inject") & F.col("source").isin(*sources)).withColumn("key", F.concat_ws(":", F.col("event_id").cast("string"), "node_id"))
    sample = hash_sample(rows, "key", n).select("event_id", "source", "rank", "node_id")
    return precision_by(judge(sample.join(nodes.select("node_id", "title", "content"), "node_id")), by)


def gate_health(runs: DataFrame, file_codes: DataFrame, stored_codes: DataFrame, dreams: DataFrame, now: Column) -> DataFrame:
    """Metric, value: how much the gate keeps out.

    runs: items_extracted, items_quarantined; file_codes, stored_codes: code, n; dreams: started_at.
    Shares are of items and of runs, 0 over nothing. A code's count is the files', and the stored
    one only where the files have none.
    """
    total = runs.agg(F.sum("items_extracted").alias("items"), F.sum("items_quarantined").alias("held"), F.count("*").alias("runs"), F.count_if(F.col("items_extracted") == 0).alias("empty"))
    zero = lambda c: F.coalesce(c, F.lit(0.0)).cast("double")
    shares = total.select(F.explode(F.array(F.struct(F.lit("quarantine_rate").alias("metric"), zero(ratio(F.col("held"), F.col("items") + F.col("held"))).alias("value")), F.struct(F.lit("zero_item_ratio").alias("metric"), zero(ratio(F.col("empty"), F.col("runs"))).alias("value")))).alias("x")).select("x.*")
    codes = file_codes.withColumnRenamed("n", "f").join(stored_codes.withColumnRenamed("n", "s"), "code", "full_outer")
    codes = codes.select(F.concat(F.lit("code:"), F.col("code")).alias("metric"), F.coalesce("f", "s").cast("double").alias("value"))
    week = dreams.where((F.col("started_at") > now - F.make_dt_interval(F.lit(7))) & (F.col("started_at") <= now)).agg(F.count("*").cast("double").alias("value")).select(F.lit("dreams_last_7d").alias("metric"), "value")
    return shares.union(codes).union(week)


def funnel(nodes: DataFrame, searches: DataFrame) -> DataFrame:
    """A21 with its fallback: retrieved and injected counts of the nodes, or of the events where the nodes have none."""
    kept = nodes.agg(*[F.coalesce(F.sum(f"{c}_count"), F.lit(0)).alias(c) for c in ("retrieved", "injected", "used")])
    seen = hits(searches).agg(F.count("*").alias("r"), F.count_if("inject").alias("i"))
    df = kept.crossJoin(seen)  # a row each
    none = F.col("retrieved") == 0
    df = df.select(F.when(none, F.col("r")).otherwise(F.col("retrieved")).alias("retrieved"), F.when(none, F.col("i")).otherwise(F.col("injected")).alias("injected"), "used")
    return df.select("*", ratio(F.col("injected"), F.col("retrieved")).alias("pass_rate"), ratio(F.col("used"), F.col("injected")).alias("conversion_rate"))


def run_totals(runs: DataFrame, now: Column, counters: tuple[str, ...]) -> DataFrame:
    """Of each counter of the runs its sum and average, and its sums over the last day, week and month: one pass, a row for each counter."""

    def since(c: str, days: int) -> Column:
        at = F.col("started_at")
        return F.coalesce(F.sum(F.when((at >= now - F.make_dt_interval(F.lit(days))) & (at <= now), F.col(c))), F.lit(0)).alias(f"last_{days}d")

    each = [F.struct(F.lit(c).alias("counter"), F.coalesce(F.sum(c), F.lit(0)).alias("total"), F.round(F.avg(c), 4).alias("average"), since(c, 1), since(c, 7), since(c, 30)) for c in counters]
    return runs.agg(F.array(*each).alias("x")).select(F.explode("x").alias("x")).select("x.*")


def earliest(*tables: tuple[DataFrame, str]) -> DataFrame:
    """The first instant in any table."""
    out = None
    for df, c in tables:
        one = df.agg(F.min(c).alias("ts"))
        out = one if out is None else out.union(one)
    return out.agg(F.min("ts").alias("earliest"))


def daily_snapshot(searches: DataFrame, writes: DataFrame) -> DataFrame:
    """A row for each day that has events: searches, latency, writes, failures; backfilled in one pass."""
    s = searches.groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("searches"), nearest_rank("latency_ms", 0.95).alias("p95"), F.sum(injected()).cast("long").alias("injected"))
    w = writes.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("writes"), F.count_if(~F.col("execution_succeeded")).alias("failures"))
    return s.join(w, "day", "full_outer").na.fill(0, ["searches", "injected", "writes", "failures"])


def daily_snapshots(searches: DataFrame, writes: DataFrame, runs: DataFrame, nodes: DataFrame, today: str, backfill: int) -> DataFrame:
    """A row for each of the last `backfill` days and today, whether or not anything happened: its events, and stocks at its end.

    Events are counted by day. Stocks (nodes, transcripts, bytes of notes) add up over the days at
    which notes were created; they are null before the first of those. Days before the first event of
    any table are left out. The spine has a row for each day, so the sums over it are small.
    """
    first = earliest((searches, "ts"), (writes, "created_at"), (runs, "started_at"), (nodes, "created_at")).select(F.to_date("earliest").alias("first"))
    last = F.to_date(F.lit(today))
    spine = first.where(F.col("first") <= last).select(F.explode(F.sequence(F.greatest("first", F.date_sub(last, backfill)), last)).alias("day"))
    r = runs.groupBy(F.to_date("started_at").alias("day")).agg(F.count("*").alias("runs"), F.sum("items_created").alias("created"))
    transient = F.col("type") == "transient"
    made = nodes.groupBy(F.to_date("created_at").alias("day")).agg(F.count_if(~transient).alias("nodes"), F.count_if(transient).alias("transcripts"), F.sum(F.octet_length("content")).alias("bytes"))
    stocks = ["nodes", "transcripts", "bytes"]
    # what was there before the spine begins belongs to its first day
    made = made.join(F.broadcast(spine.agg(F.min("day").alias("from"))), F.lit(True)).where(F.col("day") <= last).groupBy(F.greatest("day", "from").alias("day")).agg(*[F.sum(c).alias(c) for c in stocks])
    upto = W.orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    out = spine.join(daily_snapshot(searches, writes), "day", "left").join(r, "day", "left").join(made, "day", "left")
    out = out.na.fill(0, ["searches", "injected", "writes", "failures", "runs", "created"])
    return out.withColumns({c: F.sum(c).over(upto) for c in stocks})


def upsert_snapshots(old: DataFrame, new: DataFrame, replace: bool) -> DataFrame:
    """K4: by day; a new row replaces an old one, or is ignored where there is one."""
    keep, add = (old.join(new, "day", "left_anti"), new) if replace else (old, new.join(old, "day", "left_anti"))
    return keep.unionByName(add)
