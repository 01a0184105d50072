"""Operators on nodes and links: scans, counts, filters, duplicates, rankings (S, P, J, A, W, T)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memgrid.operators.prefixes import newest_longer

STATUSES = ("active", "superseded", "disputed")
#: Kinds of sources that nothing else stands behind.
ROOT_PREFIXES = ("mem_session_", "skill://", "managed-skill:", "http://", "https://", "session:")


def days_before(now: str | Column, days: int) -> Column:
    now = F.lit(now).cast("timestamp") if isinstance(now, str) else now
    return now - F.make_dt_interval(F.lit(days))


# --- predicates


def is_session(node_id: Column) -> Column:
    return node_id.startswith("mem_session_")


def is_transcript(node_id="node_id", session_key=None, type_="type", title="title") -> Column:
    """A session's id, a session key, or a transient session summary."""
    by_key = (F.coalesce(F.col(session_key), F.lit("")) != "") if session_key else F.lit(False)
    return is_session(F.col(node_id)) | by_key | ((F.col(type_) == "transient") & F.col(title).startswith("Session summary"))


def distilled_current(content="content", distilled_hash="distilled_hash", force_retry=None, turns=None, watermark=None) -> Column:
    """Nothing is to be done again: the hash fits, and no turn is above the watermark, if there is one."""
    out = F.coalesce(F.col(distilled_hash) == F.sha2(F.col(content), 256), F.lit(False))
    if force_retry:
        out = out & ~F.coalesce(F.col(force_retry), F.lit(False))
    if turns and watermark:
        out = out & (F.col(watermark).isNull() | ~F.exists(F.col(turns), lambda n: n > F.col(watermark)))
    return out


def is_root_source(source: Column) -> Column:
    out = F.lit(False)
    for p in ROOT_PREFIXES:
        out = out | source.startswith(p)
    return out


def verified_bucket(verified="verified") -> Column:
    """Three values."""
    return F.when(F.col(verified), "verified_true").when(~F.col(verified), "verified_false").otherwise("verified_unset")


def has_distiller_source(sources="sources") -> Column:
    return F.exists(sources, lambda s: s.startswith("mem_session_") | s.startswith("session:") | s.rlike(r"^mem_\d{8}_session_summary_"))


# --- scans


def by_path(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """The nodes of paths (path); a path belongs to one node at most."""
    return nodes.join(paths.select("path").distinct(), "path", "left_semi")


def valid_meta(nodes: DataFrame, meta: str = "meta", schema: str = "okf_type string, project string, verified boolean") -> DataFrame:
    """Nodes whose metadata is JSON and names a kind, with the metadata parsed; a text probe comes before the parser."""
    probe = F.contains(F.col(meta), F.lit('"okf_type": "'))
    parsed = F.from_json(F.col(meta), schema)
    sound = F.try_parse_json(F.col(meta)).isNotNull()
    return nodes.where(probe & sound).withColumn(meta, parsed).where(F.col(f"{meta}.okf_type").isNotNull())


def filtered(nodes: DataFrame, status: str | None = None, type_: str | None = None, title: str | None = None) -> DataFrame:
    """S5."""
    for column, value in (("status", status), ("type", type_), ("title", title)):
        if value is not None:
            nodes = nodes.where(F.col(column) == value)
    return nodes.orderBy("created_at", "node_id")


def multi_get(nodes: DataFrame, ids: list[str]) -> DataFrame:
    """The nodes in the order asked for, each once; `pos` is its place."""
    wanted = nodes.sparkSession.createDataFrame(list(enumerate(dict.fromkeys(ids))), "pos int, node_id string")
    return nodes.join(F.broadcast(wanted), "node_id").orderBy("pos")


def included(include: str, transcript: Column, session: Column | None = None, excluded: str | None = None) -> Column:
    """What a search may return: knowledge alone by default, transcripts too with `all` or `transcripts`; never an excluded session's."""
    out = F.lit(True) if include in ("all", "transcripts") else ~transcript
    if session is not None and excluded:
        out = out & ~session.eqNullSafe(F.lit(excluded))
    return out


# --- counts


def status_counts(nodes: DataFrame) -> DataFrame:
    """A1: each of the three statuses, also those without a node."""
    zero = nodes.sparkSession.createDataFrame([(s,) for s in STATUSES], "status string")
    return zero.join(nodes.groupBy("status").agg(F.count("*").alias("n")), "status", "left").select("status", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def marginals(nodes: DataFrame) -> DataFrame:
    """A2: counts by status, type, kind and project from one pass."""
    df = nodes.select("status", "type", F.coalesce("okf_type", F.lit("untyped")).alias("okf_type"), F.coalesce("project", F.lit("unassigned")).alias("project"))
    df = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in df.columns])).alias("x")).select("x.*")
    return df.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def verified_counts(nodes: DataFrame) -> DataFrame:
    """A3, among active persistent nodes."""
    return nodes.where("status = 'active' AND type = 'persistent'").groupBy(verified_bucket().alias("bucket")).agg(F.count("*").alias("n"))


def transcript_states(nodes: DataFrame, transcript: Column, has_items: Column) -> DataFrame:
    """A4: by the content's hash alone, whatever a watermark says."""
    current = distilled_current()
    return nodes.where(transcript).groupBy(F.when(~current, "undistilled").when(has_items, "represented").otherwise("zero_item").alias("state")).agg(F.count("*").alias("n"))


def project_sessions(nodes: DataFrame) -> DataFrame:
    """A5: distinct sources of each project's active knowledge."""
    df = nodes.where("status = 'active' AND type = 'persistent' AND project IS NOT NULL").select("project", F.explode("sources").alias("s"))
    return df.groupBy("project").agg(F.countDistinct("s").alias("sessions"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Links in and out of each node, none included."""
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("node_id")).groupBy("node_id").agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(ends, "node_id", "left").select("node_id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def neighbours(edges: DataFrame, anchors: DataFrame, limit: int) -> DataFrame:
    """Of each query, the nodes linked with its anchors, not themselves anchors, by how many links.

    anchors: query_id, node_id. Returns query_id, node_id, weight, pos.
    """
    both = edges.selectExpr("source_id a", "target_id node_id").unionAll(edges.selectExpr("target_id a", "source_id node_id"))
    found = anchors.select("query_id", F.col("node_id").alias("a")).join(both, "a").join(anchors.select("query_id", "node_id"), ["query_id", "node_id"], "left_anti")
    found = found.groupBy("query_id", "node_id").agg(F.count("*").alias("weight"))
    pos = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("weight"), "node_id"))
    return found.withColumn("pos", pos).where(F.col("pos") <= limit)


def top_tags(nodes: DataFrame, k: int = 3) -> DataFrame:
    """A30."""
    return nodes.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(k)


def growth(nodes: DataFrame, cutoff: Column) -> DataFrame:
    """Nodes since a cutoff by day, kind, project and verification: four marginals."""
    df = nodes.where(F.col("created_at") >= cutoff).select(F.date_format("created_at", "yyyy-MM-dd").alias("day"), F.coalesce("okf_type", F.lit("untyped")).alias("okf_type"), F.coalesce("project", F.lit("unassigned")).alias("project"), verified_bucket().alias("verified"))
    df = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in df.columns])).alias("x")).select("x.*")
    return df.groupBy("dimension", "value").agg(F.count("*").alias("n"))


def ratio(a: Column, b: Column, digits: int = 4) -> Column:
    """Null over nothing."""
    return F.round(a / F.nullif(b, F.lit(0)), digits)


def consolidation(nodes: DataFrame) -> DataFrame:
    """How much active knowledge rests on several sources."""
    known = nodes.where("status = 'active' AND type = 'persistent'").where(~is_session(F.col("node_id")))
    many = F.size("sources") >= 2
    size = F.octet_length("content")
    df = known.agg(F.count_if(many).alias("multi"), F.count_if(~many).alias("single"), F.sum(F.when(many, size).otherwise(0)).alias("multi_bytes"), F.sum(size).alias("bytes"))
    return df.select("multi", "single", "multi_bytes", "bytes", ratio(F.col("multi"), F.col("multi") + F.col("single")).alias("multi_ratio"), ratio(F.col("multi_bytes"), F.col("bytes")).alias("byte_ratio"))


def connectivity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Orphans, hubs and the share of projects that have a hub, over active knowledge."""
    known = nodes.where("status = 'active' AND type = 'persistent'").where(~is_session(F.col("node_id")))
    hub = F.array_contains("tags", "dreamer-hub")
    df = known.join(degrees(known, edges), "node_id").agg(F.count("*").alias("total"), F.count_if(F.col("degree") == 0).alias("orphans"), F.count_if(hub).alias("hubs"), F.countDistinct("project").alias("projects"), F.countDistinct(F.when(hub, F.col("project"))).alias("hub_projects"))
    return df.select("*", ratio(F.col("orphans"), F.col("total")).alias("orphan_rate"), ratio(F.col("hub_projects"), F.col("projects")).alias("projects_with_hub_ratio"))


def funnel(nodes: DataFrame) -> DataFrame:
    """Retrieved, injected, used."""
    df = nodes.agg(*[F.sum(f"{c}_count").alias(c) for c in ("retrieved", "injected", "used")])
    return df.select("*", ratio(F.col("injected"), F.col("retrieved")).alias("pass_rate"), ratio(F.col("used"), F.col("injected")).alias("conversion_rate"))


def pivot_kinds(nodes: DataFrame, kinds: list[str]) -> DataFrame:
    """A row for each project, a column for each kind."""
    return nodes.where("status = 'active' AND type = 'persistent'").groupBy(F.coalesce("project", F.lit("unassigned")).alias("project")).pivot("okf_type", kinds).agg(F.count(F.lit(1))).na.fill(0)


# --- filters by joins


def stale_orphans(nodes: DataFrame, edges: DataFrame, cutoff: Column) -> DataFrame:
    """P10: active, not read since the cutoff, without a link."""
    df = nodes.where((F.col("status") == "active") & (F.col("last_accessed") <= cutoff))
    for end in ("source_id", "target_id"):
        df = df.join(edges.select(F.col(end).alias("node_id")), "node_id", "left_anti")
    return df


def for_archival(nodes: DataFrame, cutoff: Column) -> DataFrame:
    """P11."""
    return nodes.where((F.col("status") == "superseded") & (F.col("last_accessed") <= cutoff)).orderBy("last_accessed", "node_id")


def vectorless(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """J3."""
    return nodes.join(vectors.select("node_id"), "node_id", "left_anti")


def oversized(nodes: DataFrame, max_bytes: int, attempted_hash: Column) -> DataFrame:
    """Too long and not tried yet with this content."""
    df = nodes.where("status = 'active' AND type = 'persistent' AND okf_type IS NOT NULL")
    return df.where((F.octet_length("content") > max_bytes) & ~attempted_hash.eqNullSafe(F.sha2("content", 256)))


def disputed_pairs(nodes: DataFrame) -> DataFrame:
    """Pairs that point at each other; each node has one pointer, so no pair overlaps another."""
    d = nodes.where("status = 'disputed' AND superseded_by IS NOT NULL")
    a, b = d.selectExpr("node_id id_a", "superseded_by id_b"), d.selectExpr("node_id id_b", "superseded_by id_a")
    return a.join(b, ["id_a", "id_b"]).where("id_a < id_b")


# --- duplicates


def exact_duplicates(nodes: DataFrame) -> DataFrame:
    """Of nodes with one title and content all but the newest; `keeper` is that one (of two as new the lower id)."""
    rows = nodes.select("node_id", F.xxhash64("title").alias("t"), F.sha2("content", 256).alias("h"), "created_at")
    # adds up on the way, so many copies are no burden; only what has copies is joined
    low = rows.groupBy("t", "h", "created_at").agg(F.min("node_id").alias("node_id"), F.count("*").alias("n"))
    keeper = low.groupBy("t", "h").agg(F.max_by("node_id", "created_at").alias("keeper"), F.sum("n").alias("n")).where("n > 1")
    return rows.join(keeper, ["t", "h"]).where("node_id <> keeper").select("node_id", "keeper")


#: Copies of a text from which they are put together before the pass, and such texts up to which they are broadcast.
COPIES, COPIED_TEXTS = 1000, 1_000_000


def prefix_duplicates(nodes: DataFrame) -> DataFrame:
    """Nodes whose collapsed content is a strict prefix of a newer one's with the same title; `newer` is the newest such.

    Texts travel once, to the range they are sorted in (see prefixes); a text of many copies is one row there.
    """
    body = F.lower(F.trim(F.regexp_replace("content", r"[ \t\n\x0B\f\r]+", " ")))
    flat = nodes.select("node_id", "title", body.alias("body"), F.unix_micros("created_at").alias("stamp")).where("title IS NOT NULL AND body IS NOT NULL AND stamp IS NOT NULL")
    flat = flat.withColumn("key", F.unhex(F.sha2(F.concat(F.length("title").cast("string"), F.lit(" "), F.col("title"), F.col("body")), 256)))
    copied = flat.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > COPIES).select("key")
    n = copied.count()
    texts = flat.select(F.col("title").alias("grp"), "body", "key", "stamp", F.col("node_id").alias("best"))
    if n:
        copied = F.broadcast(copied) if n <= COPIED_TEXTS else copied
        one = texts.join(copied, "key", "left_semi").groupBy("grp", "body", "key").agg(F.max(F.struct("stamp", "best")).alias("m")).select("grp", "body", "key", "m.stamp", "m.best")
        texts = texts.join(copied, "key", "left_anti").select(*one.columns).unionByName(one)
    longer = newest_longer(texts).withColumnRenamed("stamp", "newer_stamp")
    return flat.select("node_id", "stamp", "key").join(longer, "key").where("stamp < newer_stamp").select("node_id", F.col("best").alias("newer"))


def identical_active(drafts: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each draft (draft_id, title, content) the newest active node that says the same."""
    own = nodes.where("status = 'active'").select("title", F.sha2("content", 256).alias("h"), "node_id", "created_at")
    found = drafts.withColumn("h", F.sha2("content", 256)).join(own, ["title", "h"]).groupBy("draft_id").agg(F.max(F.struct("created_at", "node_id")).alias("m"))
    return found.select("draft_id", F.col("m.node_id").alias("node_id"))


# --- rankings


def takeaways(nodes: DataFrame, k: int = 20) -> DataFrame:
    """T5: each project's first k: those with several sources by sources and reads, then the others by use."""
    df = nodes.where("status = 'active' AND type = 'persistent' AND project IS NOT NULL").where(F.coalesce("verified", F.lit(True)))
    n = F.size("sources")
    order = [(n < 2).asc(), F.when(n >= 2, n).desc(), F.when(n >= 2, F.col("access_count")).otherwise(F.col("used_count")).desc(), F.when(n < 2, F.col("access_count")).desc(), F.col("node_id").asc()]
    pos = F.row_number().over(W.partitionBy("project").orderBy(*order))
    return df.select("project", "node_id", pos.alias("pos")).where(F.col("pos") <= min(20, max(1, k)))


def handbook_order(nodes: DataFrame, kind: str) -> DataFrame:
    """A kind's nodes with their place in a project: by sources, pitfalls then by reads, then by id."""
    df = nodes.where((F.col("status") == "active") & (F.col("type") == "persistent") & (F.col("okf_type") == kind) & F.coalesce("verified", F.lit(True)))
    order = [F.desc(F.size("sources")), *([F.desc("access_count")] if kind == "pitfall" else []), F.asc("node_id")]
    return df.select("project", "node_id", F.row_number().over(W.partitionBy("project").orderBy(*order)).alias("pos"))


def last_entries(df: DataFrame, at: str, key: str, n: int = 5) -> DataFrame:
    """The n latest rows, newest first."""
    return df.orderBy(F.desc(at), F.desc(key)).limit(n)


def cursor_union(nodes: DataFrame, transcript: Column) -> DataFrame:
    """Active nodes, and transcripts of any status; a node that is both comes once."""
    return nodes.where((F.col("status") == "active") | transcript)


def hash_sample(df: DataFrame, key: str, n: int, seed: str = "7") -> DataFrame:
    """N rows, the same ones each time, by a hash of the key."""
    return df.orderBy(F.sha1(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary")), key).limit(n)


def file_state_diff(disk: DataFrame, index: DataFrame) -> DataFrame:
    """What to do for each path of two snapshots (path, mtime): upsert new and newer ones, delete gone ones."""
    both = disk.select("path", F.col("mtime").alias("d")).join(index.select("path", F.col("mtime").alias("i")), "path", "full_outer")
    action = F.when(F.col("d").isNull(), "delete").when(F.col("i").isNull() | (F.col("d") > F.col("i")), "upsert")
    return both.select("path", action.alias("action")).where("action IS NOT NULL")


def resolve_aliases(links: DataFrame, nodes: DataFrame) -> DataFrame:
    """Each link text's node: an exact id, title or tag-free slug first, then the same without case; the least id wins.

    links: source_id, target. Returns source_id, target, node_id (null if unknown).
    """
    names = nodes.select("node_id", F.explode(F.array("node_id", "title")).alias("name")).where("name IS NOT NULL AND name <> ''")
    exact = names.groupBy("name").agg(F.min("node_id").alias("exact"))
    loose = names.groupBy(F.lower("name").alias("low")).agg(F.min("node_id").alias("loose"))
    df = links.join(exact, F.col("target") == F.col("name"), "left").join(loose, F.lower("target") == F.col("low"), "left")
    return df.select("source_id", "target", F.coalesce("exact", "loose").alias("node_id"))
