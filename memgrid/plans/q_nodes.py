"""Queries on nodes and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgrid.operators import nodes as N
from memgrid.plans.catalog import query
from memgrid.sources.logical import NOW, sql

TS = f"TIMESTAMP '{NOW}'"


@query(sql("SELECT s.status, CAST(count(node_id) AS BIGINT) AS n FROM (VALUES ('active'), ('superseded'), ('disputed')) s(status) LEFT JOIN nodes USING (status) GROUP BY s.status"))
def status_counts(t):
    return N.status_counts(t.nodes())


@query(sql("SELECT 'status' AS dimension, status AS value, count(*) AS n FROM nodes GROUP BY ALL UNION ALL SELECT 'type', type, count(*) FROM nodes GROUP BY ALL UNION ALL SELECT 'okf_type', coalesce(okf_type, 'untyped') AS v, count(*) FROM nodes GROUP BY v UNION ALL SELECT 'project', coalesce(project, 'unassigned') AS v, count(*) FROM nodes GROUP BY v"))
def node_marginals(t):
    return N.marginals(t.nodes())


@query(sql("SELECT CASE WHEN verified THEN 'verified_true' WHEN NOT verified THEN 'verified_false' ELSE 'verified_unset' END AS bucket, count(*) AS n FROM nodes WHERE status = 'active' AND type = 'persistent' GROUP BY bucket"))
def verified_buckets(t):
    return N.verified_counts(t.nodes())


@query(sql("SELECT CASE WHEN coalesce(distilled_hash = sha256(content), false) THEN CASE WHEN used_count > 0 THEN 'represented' ELSE 'zero_item' END ELSE 'undistilled' END AS state, count(*) AS n FROM nodes WHERE type = 'transient' GROUP BY state"))
def transcript_states(t):
    return N.transcript_states(t.nodes(), F.col("type") == "transient", F.col("used_count") > 0)


@query(sql("SELECT project, count(DISTINCT s) AS sessions FROM (SELECT project, unnest(sources) AS s FROM nodes WHERE status = 'active' AND type = 'persistent' AND project IS NOT NULL) GROUP BY project"))
def project_sessions(t):
    return N.project_sessions(t.nodes())


@query(sql("SELECT node_id, CAST(count(e) AS BIGINT) AS degree FROM nodes LEFT JOIN (SELECT source_id AS e FROM edges UNION ALL SELECT target_id FROM edges) ON e = node_id GROUP BY node_id"))
def node_degree(t):
    return N.degrees(t.nodes(), t.edges())


ANCHORS = "anchors AS (SELECT CAST(seq // 5 AS BIGINT) AS query_id, node_id FROM nodes)"


@query(sql("SELECT query_id, node_id, weight, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, node_id) AS pos FROM w) WHERE pos <= 6", ANCHORS, "w AS (SELECT query_id, o AS node_id, count(*) AS weight FROM anchors JOIN (SELECT source_id AS a, target_id AS o FROM edges UNION ALL SELECT target_id, source_id FROM edges) ON a = node_id WHERE NOT EXISTS (SELECT 1 FROM anchors x WHERE x.query_id = anchors.query_id AND x.node_id = o) GROUP BY ALL)"))
def linked_neighbors(t):
    anchors = t.nodes().selectExpr("seq div 5 query_id", "node_id")
    return N.neighbours(t.edges(), anchors, 6)


@query(sql("SELECT tag, n FROM (SELECT tag, count(*) AS n FROM (SELECT unnest(tags) AS tag FROM nodes) GROUP BY tag) ORDER BY n DESC, tag LIMIT 3"))
def label_histogram(t):
    return N.top_tags(t.nodes())


_G = "CASE WHEN verified THEN 'verified_true' WHEN NOT verified THEN 'verified_false' ELSE 'verified_unset' END"


@query(sql("SELECT d AS dimension, v AS value, count(*) AS n FROM (SELECT unnest(['day', 'okf_type', 'project', 'verified']) AS d, unnest([strftime(created_at, '%Y-%m-%d'), coalesce(okf_type, 'untyped'), coalesce(project, 'unassigned'), " + _G + f"]) AS v FROM nodes WHERE created_at >= {TS} - INTERVAL 30 DAY) GROUP BY ALL"))
def knowledge_growth(t):
    return N.growth(t.nodes(), N.days_before(NOW, 30))


_KNOWN = "known AS (SELECT * FROM nodes WHERE status = 'active' AND type = 'persistent')"


@query(sql("SELECT multi, single, multi_bytes, bytes, round(multi / nullif(multi + single, 0), 4) AS multi_ratio, round(multi_bytes / nullif(bytes, 0), 4) AS byte_ratio FROM (SELECT count(*) FILTER (len(sources) >= 2) AS multi, count(*) FILTER (len(sources) < 2) AS single, CAST(sum(CASE WHEN len(sources) >= 2 THEN strlen(content) ELSE 0 END) AS BIGINT) AS multi_bytes, CAST(sum(strlen(content)) AS BIGINT) AS bytes FROM known)", _KNOWN))
def consolidation(t):
    return N.consolidation(t.nodes())


@query(sql("SELECT *, round(orphans / nullif(total, 0), 4) AS orphan_rate, round(hub_projects / nullif(projects, 0), 4) AS projects_with_hub_ratio FROM (SELECT count(*) AS total, count(*) FILTER (e IS NULL) AS orphans, count(*) FILTER (list_contains(tags, 'dreamer-hub')) AS hubs, count(DISTINCT project) AS projects, count(DISTINCT CASE WHEN list_contains(tags, 'dreamer-hub') THEN project END) AS hub_projects FROM known LEFT JOIN (SELECT DISTINCT unnest([source_id, target_id]) AS e FROM edges) ON e = node_id)", _KNOWN))
def graph_connectivity(t):
    return N.connectivity(t.nodes(), t.edges())


@query(sql("SELECT *, round(injected / nullif(retrieved, 0), 4) AS pass_rate, round(used / nullif(injected, 0), 4) AS conversion_rate FROM (SELECT CAST(sum(retrieved_count) AS BIGINT) AS retrieved, CAST(sum(injected_count) AS BIGINT) AS injected, CAST(sum(used_count) AS BIGINT) AS used FROM nodes)"))
def funnel(t):
    return N.funnel(t.nodes())


KINDS = ["decision", "fact", "pitfall", "procedure"]


@query(sql("SELECT coalesce(project, 'unassigned') AS project, " + ", ".join(f"count(*) FILTER (okf_type = '{k}') AS {k}" for k in KINDS) + " FROM known GROUP BY 1", _KNOWN))
def pivot_handbook(t):
    return N.pivot_kinds(t.nodes(), KINDS)


@query(sql(f"SELECT node_id FROM nodes WHERE status = 'active' AND last_accessed <= {TS} - INTERVAL 30 DAY AND node_id NOT IN (SELECT source_id FROM edges) AND node_id NOT IN (SELECT target_id FROM edges)"))
def stale_orphans(t):
    return N.stale_orphans(t.nodes(), t.edges(), N.days_before(NOW, 30)).select("node_id")


@query(sql(f"SELECT node_id, CAST(epoch(last_accessed) AS BIGINT) AS last_accessed FROM nodes WHERE status = 'superseded' AND last_accessed <= {TS} - INTERVAL 60 DAY"))
def superseded_for_archival(t):
    return N.for_archival(t.nodes(), N.days_before(NOW, 60)).select("node_id", F.unix_seconds("last_accessed").alias("last_accessed"))


@query(sql("SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT node_id FROM vectors)"))
def vectorless_nodes(t):
    return N.vectorless(t.nodes(), t.vectors()).select("node_id")


@query(sql("SELECT node_id, title FROM nodes WHERE status = 'active' AND type = 'transient'"))
def filtered_list(t):
    return N.filtered(t.nodes(), status="active", type_="transient").select("node_id", "title")


@query(sql("SELECT CAST(p AS INTEGER) AS pos, node_id, type FROM nodes JOIN (VALUES (0, 'n00000009'), (1, 'n00000003'), (2, 'n00000100')) v(p, k) ON k = node_id"))
def multi_get(t):
    return N.multi_get(t.nodes(), ["n00000009", "n00000003", "n00000009", "n00000100", "gone"]).select("pos", "node_id", "type")


@query(sql("SELECT node_id, CAST(strlen(content) AS INTEGER) AS bytes FROM nodes WHERE status = 'active' AND type = 'persistent' AND okf_type IS NOT NULL AND strlen(content) > 4096 AND distilled_hash IS DISTINCT FROM sha256(content)"))
def oversized_nodes(t):
    return N.oversized(t.nodes(), 4096, F.col("distilled_hash")).select("node_id", F.octet_length("content").alias("bytes"))


@query(sql("SELECT a.node_id AS id_a, b.node_id AS id_b FROM nodes a JOIN nodes b ON a.superseded_by = b.node_id AND b.superseded_by = a.node_id WHERE a.status = 'disputed' AND b.status = 'disputed' AND a.node_id < b.node_id"))
def disputed_pairs(t):
    return N.disputed_pairs(t.nodes())


@query(sql("SELECT node_id, keeper FROM (SELECT node_id, row_number() OVER w AS n, first(node_id) OVER w AS keeper FROM nodes WINDOW w AS (PARTITION BY title, sha256(content) ORDER BY created_at DESC, node_id)) WHERE n > 1"))
def exact_duplicates(t):
    return N.exact_duplicates(t.nodes())


_FLAT = r"flat AS (SELECT node_id, title, created_at, lower(trim(regexp_replace(content, '[ \t\n\x0B\f\r]+', ' ', 'g'))) AS body FROM nodes)"


_CUT = "src AS (SELECT node_id, title, content, created_at FROM nodes UNION ALL SELECT node_id || 'p', title, left(content, length(content) // 2), created_at - INTERVAL 1 DAY FROM nodes WHERE seq % 3 = 0)"


@query(sql("SELECT a.node_id, arg_max(b.node_id, struct_pack(t := b.created_at, n := b.node_id)) AS newer FROM flat a JOIN flat b ON a.title = b.title AND a.created_at < b.created_at AND length(a.body) < length(b.body) AND starts_with(b.body, a.body) GROUP BY a.node_id", _CUT, _FLAT.replace("FROM nodes", "FROM src")))
def prefix_duplicates(t):
    n = t.texts().select("node_id", "seq", "title", "content", "created_at")
    cut = n.where("seq % 3 = 0").withColumns({"node_id": F.concat("node_id", F.lit("p")), "content": F.expr("left(content, length(content) div 2)"), "created_at": F.expr("created_at - interval 1 day")})
    return N.prefix_duplicates(n.union(cut))


@query(sql("SELECT d.seq AS draft_id, arg_max(n.node_id, struct_pack(t := n.created_at, n := n.node_id)) AS node_id FROM nodes d JOIN nodes n ON d.title = n.title AND d.content = n.content WHERE n.status = 'active' GROUP BY d.seq"))
def identical_guard(t):
    drafts = t.nodes().select(F.col("seq").alias("draft_id"), "title", "content")
    return N.identical_active(drafts, t.nodes())


@query(sql("SELECT project, node_id, CAST(pos AS INTEGER) AS pos FROM (SELECT project, node_id, row_number() OVER (PARTITION BY project ORDER BY len(sources) < 2, CASE WHEN len(sources) >= 2 THEN len(sources) END DESC NULLS LAST, CASE WHEN len(sources) >= 2 THEN access_count ELSE used_count END DESC, CASE WHEN len(sources) < 2 THEN access_count END DESC NULLS LAST, node_id) AS pos FROM known WHERE project IS NOT NULL AND coalesce(verified, true)) WHERE pos <= 20", _KNOWN))
def project_top_takeaways(t):
    return N.takeaways(t.nodes())


@query(sql("SELECT node_id FROM nodes ORDER BY sha1(concat(node_id, '7')), node_id LIMIT 25"))
def audit_sample(t):
    return N.hash_sample(t.nodes().select("node_id"), "node_id", 25)


@query(sql("SELECT coalesce(d.path, i.path) AS path, CASE WHEN d.path IS NULL THEN 'delete' WHEN i.path IS NULL OR d.mtime > i.mtime THEN 'upsert' END AS action FROM (SELECT node_id AS path, CAST(seq AS BIGINT) AS mtime FROM nodes WHERE seq % 4 <> 0) d FULL JOIN (SELECT node_id AS path, CAST(seq + seq % 3 - 1 AS BIGINT) AS mtime FROM nodes WHERE seq % 5 <> 0) i ON d.path = i.path WHERE d.path IS NULL OR i.path IS NULL OR d.mtime > i.mtime"))
def file_state_diff(t):
    n = t.nodes()
    return N.file_state_diff(n.where("seq % 4 <> 0").select(F.col("node_id").alias("path"), F.col("seq").alias("mtime")), n.where("seq % 5 <> 0").selectExpr("node_id path", "seq + seq % 3 - 1 mtime"))


@query(sql("SELECT source_id, target, coalesce(e.m, l.m) AS node_id FROM links LEFT JOIN (SELECT a, min(node_id) AS m FROM alias GROUP BY a) e ON e.a = target LEFT JOIN (SELECT lower(a) AS a, min(node_id) AS m FROM alias GROUP BY 1) l ON l.a = lower(target)", "links AS (SELECT node_id AS source_id, CASE seq % 4 WHEN 0 THEN title WHEN 1 THEN lower(title) WHEN 2 THEN 'nowhere' ELSE node_id END AS target FROM nodes)", "alias AS (SELECT node_id, unnest([node_id, title]) AS a FROM nodes)"))
def resolve_links(t):
    n = t.nodes()
    links = n.selectExpr("node_id source_id", "CASE seq % 4 WHEN 0 THEN title WHEN 1 THEN lower(title) WHEN 2 THEN 'nowhere' ELSE node_id END target")
    return N.resolve_aliases(links, n)


@query(sql("SELECT node_id FROM nodes WHERE seq % 3 = 1"))
def nodes_by_path(t):
    """Paths of a third of the nodes, some twice, and one of none."""
    n = t.nodes().withColumn("path", F.concat(F.lit("notes/"), F.col("node_id"), F.lit(".md")))
    paths = n.where("seq % 3 = 1").select("path")
    return N.by_path(n, paths.union(paths).union(t.spark.createDataFrame([("notes/none.md",)], "path string"))).select("node_id")


@query(sql("SELECT node_id, okf_type, coalesce(project, '') AS project FROM nodes WHERE okf_type IS NOT NULL AND seq % 4 <> 0"))
def valid_metadata(t):
    """Metadata as JSON text, of which every fourth is cut off."""
    meta = F.to_json(F.struct(F.col("okf_type"), F.coalesce("project", F.lit("")).alias("project")))
    spaced = F.regexp_replace(meta, '":"', '": "')
    n = t.nodes().withColumn("meta", F.when(F.col("seq") % 4 == 0, F.concat(F.lit('{"x": "\\"okf_type\\": \\"", '), F.substring(spaced, 2, 14))).otherwise(spaced))
    return N.valid_meta(n.select("node_id", "meta")).select("node_id", "meta.okf_type", "meta.project")


@query(sql("SELECT kind, project, node_id, CAST(pos AS INTEGER) AS pos FROM (SELECT 'pitfall' AS kind, project, node_id, row_number() OVER (PARTITION BY project ORDER BY len(sources) DESC, access_count DESC, node_id) AS pos FROM h WHERE okf_type = 'pitfall' UNION ALL SELECT 'decision', project, node_id, row_number() OVER (PARTITION BY project ORDER BY len(sources) DESC, node_id) FROM h WHERE okf_type = 'decision')", "h AS (SELECT * FROM nodes WHERE status = 'active' AND type = 'persistent' AND coalesce(verified, true))"))
def handbook_orders(t):
    """T6."""
    n = t.nodes()
    a, b = (N.handbook_order(n, k).select(F.lit(k).alias("kind"), "project", "node_id", "pos") for k in ("pitfall", "decision"))
    return a.union(b)


@query("SELECT o_orderkey AS run_id FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 5")
def last_runs(t):
    """W8."""
    return N.last_entries(t.runs(), "started_at", "run_id").select("run_id")


@query(sql("SELECT node_id FROM nodes WHERE status = 'active' OR type = 'transient'"))
def cursor_union(t):
    """U7."""
    return N.cursor_union(t.nodes(), F.col("type") == "transient").select("node_id")


@query(sql("SELECT 'knowledge' AS include, count(*) AS n FROM nodes WHERE type <> 'transient' AND project IS DISTINCT FROM 'web' UNION ALL SELECT 'all', count(*) FROM nodes WHERE project IS DISTINCT FROM 'web' UNION ALL SELECT 'transcripts', count(*) FROM nodes"))
def include_modes(t):
    """P9; a project stands for a session here."""
    n, talk = t.nodes(), F.col("type") == "transient"
    one = lambda mode, out: n.where(N.included(mode, talk, F.col("project"), out)).agg(F.count("*").alias("n")).select(F.lit(mode).alias("include"), "n")
    return one("knowledge", "web").union(one("all", "web")).union(one("transcripts", None))
