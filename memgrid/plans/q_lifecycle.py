"""Queries on maintenance steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgrid.operators import events as E, lifecycle as L, nodes as N, vectors as V
from memgrid.plans.catalog import query
from memgrid.plans.q_graph import _ENDS, _WALK
from memgrid.plans.q_nodes import _FLAT
from memgrid.sources.logical import NOW, sql

TS = f"TIMESTAMP '{NOW}'"


@query(sql("SELECT node_id, retrieved_count + coalesce(r, 0) AS retrieved_count, injected_count + coalesce(i, 0) AS injected_count, access_count + coalesce(i, 0) AS access_count, CAST(floor(epoch(greatest(last_accessed, hit_at))) AS BIGINT) AS last_accessed FROM nodes LEFT JOIN (SELECT node_id, count(*) AS r, count(*) FILTER (b) AS i, max(ts) FILTER (b) AS hit_at FROM (SELECT event_id, node_id, bool_or(inject) AS b, max(ts) AS ts FROM hits GROUP BY event_id, node_id) GROUP BY node_id) USING (node_id)"))
def access_accounting(t):
    df = L.access_accounted(t.nodes(), E.hits(t.searches()))
    return df.select("node_id", "retrieved_count", "injected_count", "access_count", F.unix_seconds("last_accessed").alias("last_accessed"))


@query(sql("SELECT node_id, used_count + coalesce(u, 0) AS used_count, injected_count + coalesce(i, 0) AS injected_count, access_count + coalesce(u, 0) AS access_count FROM nodes LEFT JOIN (SELECT node_id, count(*) FILTER (kind = 'used') AS u, count(*) FILTER (kind = 'injected') AS i FROM (SELECT DISTINCT session_hash, node_id, CASE WHEN inject THEN 'used' ELSE 'injected' END AS kind FROM hits) GROUP BY node_id) USING (node_id)"))
def usage_credit(t):
    usage = E.hits(t.searches()).select("session_hash", "node_id", F.when(F.col("inject"), "used").otherwise("injected").alias("kind"))
    return L.usage_credited(t.nodes(), usage).select("node_id", "used_count", "injected_count", "access_count")


@query(sql("SELECT node_id, CASE WHEN seq % 4 = 1 THEN 'new' ELSE title END AS title, CASE WHEN seq % 4 = 1 THEN greatest(used_count, 3) ELSE used_count END AS used_count FROM nodes"))
def monotone_merge(t):
    old = t.nodes().select("node_id", "title", "used_count")
    new = t.nodes().where("seq % 4 = 1").select("node_id", F.lit("new").alias("title"), F.lit(3).cast("long").alias("used_count"))
    return L.upserted(old, new, "node_id", ("used_count",))


@query(sql(f"SELECT node_id, CAST(epoch(last_accessed) AS BIGINT) AS last_accessed FROM nodes WHERE status = 'active' AND type = 'transient' AND last_accessed <= {TS} - INTERVAL 10 DAY AND NOT coalesce(distilled_hash = sha256(content), false) ORDER BY nodes.last_accessed, node_id LIMIT 50"))
def idle_sessions(t):
    return L.idle_transcripts(t.nodes(), N.days_before(NOW, 10), 50).select("node_id", F.unix_seconds("last_accessed").alias("last_accessed"))


@query(sql(f"SELECT node_id FROM nodes WHERE type = 'transient' AND distilled_hash = sha256(content) AND last_accessed <= {TS} - INTERVAL 45 DAY"))
def expired_sessions(t):
    return L.expired_transcripts(t.nodes(), N.days_before(NOW, 45)).select("node_id")


@query(sql(f"SELECT 'stale' AS stage, node_id FROM nodes WHERE status = 'active' AND last_accessed <= {TS} - INTERVAL 30 DAY AND node_id NOT IN (SELECT source_id FROM edges) AND node_id NOT IN (SELECT target_id FROM edges) UNION ALL SELECT 'superseded', node_id FROM nodes WHERE status = 'superseded' AND last_accessed <= {TS} - INTERVAL 60 DAY UNION ALL SELECT 'disputed', a.node_id FROM nodes a JOIN nodes b ON a.superseded_by = b.node_id AND b.superseded_by = a.node_id WHERE a.status = 'disputed' AND b.status = 'disputed'"))
def maintenance_scan(t):
    return L.scan(t.nodes(), t.edges(), NOW)


_DEC = "d AS (SELECT seq AS draft_id, CASE seq % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'supersede' WHEN 2 THEN 'complement' WHEN 3 THEN 'erase' ELSE 'supersede' END AS action, CASE seq % 4 WHEN 0 THEN [] WHEN 1 THEN [node_id] ELSE [node_id, 'n00000005'] END AS targets, CASE seq % 7 WHEN 0 THEN NULL WHEN 1 THEN 1.5 ELSE 0.5 END AS confidence FROM nodes)"


@query(sql("SELECT draft_id, CASE WHEN action NOT IN ('create', 'supersede', 'complement') THEN 'unsupported_action' WHEN len(list_filter(targets, lambda x: x <> 'n00000005' AND draft_id % 9 = 0)) > 0 OR (list_contains(targets, 'n00000005') AND draft_id % 2 = 0) THEN 'target_not_candidate' WHEN len(list_intersect(targets, (SELECT list(node_id) FROM nodes WHERE type = 'transient'))) > 0 THEN 'target_is_transcript' WHEN action = 'create' AND len(targets) > 0 THEN 'create_with_targets' WHEN action <> 'create' AND len(targets) = 0 THEN 'no_targets' WHEN confidence NOT BETWEEN 0 AND 1 THEN 'confidence_out_of_range' END AS error FROM d", _DEC))
def decision_validation(t):
    n = t.nodes()
    none = "cast(array() as array<string>)"
    d = n.selectExpr("seq draft_id", "CASE seq % 5 WHEN 0 THEN 'create' WHEN 1 THEN 'supersede' WHEN 2 THEN 'complement' WHEN 3 THEN 'erase' ELSE 'supersede' END action", f"CASE seq % 4 WHEN 0 THEN {none} WHEN 1 THEN array(node_id) ELSE array(node_id, 'n00000005') END targets", "CASE seq % 7 WHEN 0 THEN NULL WHEN 1 THEN 1.5D ELSE 0.5D END confidence")
    candidates = n.where("seq % 9 > 0 OR node_id = 'n00000005'").selectExpr("seq draft_id", "node_id").union(n.where("seq % 2 = 1").selectExpr("seq draft_id", "'n00000005'"))
    return L.decision_errors(d, candidates, n.where("type = 'transient'"))


@query()
def supersede_downgrade(t):
    n = t.nodes()
    d = n.select(F.col("seq").alias("draft_id"), F.when(F.col("seq") % 2 == 0, "supersede").otherwise("complement").alias("action"), F.expr("concat('n', lpad(cast(seq div 2 as string), 8, '0'))").alias("target"), "content")
    return L.downgraded(d, n)


@query(sql("SELECT n.node_id, CASE WHEN x IS NOT NULL THEN 'superseded' ELSE status END AS status, coalesce(x, superseded_by) AS superseded_by, sha256(CASE WHEN len(l) > 0 THEN rtrim(content, ' ') || chr(10) || chr(10) || array_to_string(list_transform(l, lambda y: '- [[' || y || ']]'), chr(10)) ELSE content END) AS digest FROM nodes n LEFT JOIN (SELECT target, min(new_id) FILTER (action = 'supersede') AS x, list_sort(list(DISTINCT new_id) FILTER (action = 'complement')) AS l FROM (SELECT concat('x', cast(seq as string)) AS new_id, CASE WHEN seq % 2 = 0 THEN 'supersede' ELSE 'complement' END AS action, concat('n', lpad(cast(seq // 3 as string), 8, '0')) AS target FROM nodes) GROUP BY target) d ON d.target = n.node_id"))
def decisions_executed(t):
    n = t.nodes()
    d = n.selectExpr("concat('x', cast(seq as string)) new_id", "CASE WHEN seq % 2 = 0 THEN 'supersede' ELSE 'complement' END action", "concat('n', lpad(cast(seq div 3 as string), 8, '0')) target")
    return L.executed(n, d).select("node_id", "status", "superseded_by", F.sha2("content", 256).alias("digest"))


_PAIR = "p AS (SELECT a.node_id AS id_a, b.node_id AS id_b, CASE a.seq % 3 WHEN 0 THEN 'supersede_a' WHEN 1 THEN 'supersede_b' ELSE 'both_valid' END AS action FROM nodes a JOIN nodes b ON a.superseded_by = b.node_id AND b.superseded_by = a.node_id WHERE a.status = 'disputed' AND b.status = 'disputed' AND a.node_id < b.node_id)"


@query(sql("SELECT id_a AS node_id, CASE WHEN action = 'supersede_a' THEN 'superseded' ELSE 'active' END AS status, CASE WHEN action = 'supersede_a' THEN id_b END AS superseded_by FROM p UNION ALL SELECT id_b, CASE WHEN action = 'supersede_b' THEN 'superseded' ELSE 'active' END, CASE WHEN action = 'supersede_b' THEN id_a END FROM p", _PAIR))
def conflicts_applied(t):
    n = t.nodes()
    pairs = N.disputed_pairs(n).withColumn("action", F.expr("CASE cast(substring(id_a, 2) as bigint) % 3 WHEN 0 THEN 'supersede_a' WHEN 1 THEN 'supersede_b' ELSE 'both_valid' END"))
    return L.conflicts_applied(n, pairs)


@query(sql("SELECT node_id, CAST(count(*) AS INTEGER) AS added FROM (SELECT id_a AS node_id, id_b AS o FROM q UNION SELECT id_b, id_a FROM q) JOIN nodes USING (node_id) GROUP BY node_id", "q AS (SELECT a.node_id AS id_a, b.node_id AS id_b FROM vectors a JOIN vectors b ON a.node_id < b.node_id WHERE round(1 - round(1 - greatest(-1, least(1, list_dot_product(a.embedding, b.embedding))), 8), 8) >= 0.33)"))
def links_woven(t):
    # only what may hold a link travels, as the texts are not asked for
    n = t.texts().select("node_id", F.when(F.contains("content", F.lit("[[")), F.col("content")).otherwise("").alias("content"))
    return L.partners_woven(n, V.similar_partners(t.vectors(), 0.33)).select("node_id", "added")


_TAGS = "SELECT project, string_agg(tag, ',' ORDER BY k DESC, tag) AS tags FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY k DESC, tag) AS p FROM (SELECT project, tag, count(*) AS k FROM (SELECT project, unnest(tags) AS tag FROM g) GROUP BY project, tag)) WHERE p <= 3 GROUP BY project"
_TEXT = "'## Takeaway' || n || n || 'Merged ' || count(*) || ' notes' || n || n || '## Context' || n || n || string_agg('- **' || title || '** (`' || node_id || '`): z' || w, chr(10) ORDER BY node_id) || n || n || '## Sources' || n || n || string_agg('- [[' || node_id || ']]', chr(10) ORDER BY node_id)"


@query(sql(f"SELECT project, k AS n, tags, digest FROM (SELECT project, count(*) AS k, sha256({_TEXT}) AS digest FROM (SELECT *, chr(10) AS n, rtrim(left(regexp_replace(content, '[^a-z]+', ' ', 'g'), 100)) AS w FROM g) GROUP BY project, n) JOIN ({_TAGS}) USING (project)", "g AS (SELECT * FROM nodes WHERE status = 'superseded' AND project IS NOT NULL)"))
def condensation(t):
    """B3; a note's first line is the first hundred of its letters, the rest follows."""
    n = t.nodes().where("status = 'superseded' AND project IS NOT NULL")
    n = n.withColumn("content", F.concat(F.lit("## Head\nuser:\n- z"), F.rtrim(F.substring(F.regexp_replace("content", "[^a-z]+", " "), 1, 100)), F.lit("\n"), F.col("content")))
    return L.condensed(n, "project").select("project", "n", "tags", F.sha2("content", 256).alias("digest"))


@query(sql("SELECT g, CAST(sum(used_count) AS BIGINT) AS used_count, CAST(sum(injected_count) AS BIGINT) AS injected_count, max(retrieved_count) AS retrieved_count, array_to_string(list_sort(list_distinct(flatten(list(tags)))), ',') AS tags, array_to_string(list_sort(list_distinct(flatten(list(sources)))), ',') AS sources, CAST(sum(used_count) + sum(injected_count) AS BIGINT) AS access_count FROM (SELECT *, seq // 4 AS g FROM nodes) GROUP BY g"))
def merged_counters(t):
    return L.merged_counters(t.nodes().withColumn("g", F.expr("seq div 4")), "g").withColumns({"tags": F.array_join("tags", ","), "sources": F.array_join("sources", ",")})


_DUP = [
    "act AS (SELECT * FROM nodes WHERE status = 'active')",
    "ra AS (SELECT node_id FROM (SELECT node_id, row_number() OVER (PARTITION BY title, sha256(content) ORDER BY created_at DESC, node_id) AS n FROM act) WHERE n > 1)",
    _FLAT.replace("FROM nodes", "FROM act WHERE node_id NOT IN (SELECT node_id FROM ra)"),
    "rb AS (SELECT DISTINCT a.node_id FROM flat a JOIN flat b ON a.title = b.title AND a.created_at < b.created_at AND length(a.body) < length(b.body) AND starts_with(b.body, a.body))",
    _WALK, _ENDS,
    "rc AS (SELECT x.node_id FROM nodes x JOIN ends USING (node_id) LEFT JOIN nodes e ON e.node_id = ende WHERE x.status = 'superseded' AND (x.superseded_by IS NULL OR outcome = 'missing_successor' OR (outcome = 'terminal' AND e.status <> 'disputed')))",
]


@query(sql("SELECT node_id, min(rule) AS rule FROM (SELECT node_id, 'A' AS rule FROM ra UNION ALL SELECT node_id, 'B' FROM rb UNION ALL SELECT node_id, 'C' FROM rc) GROUP BY node_id", *_DUP))
def session_duplicates(t):
    return L.session_duplicates(t.texts())


@query(sql("SELECT 'mem_session_' || left(sha1(k), 16) AS node_id, CASE WHEN seq % 3 = 0 THEN 'created' WHEN seq % 3 = 1 THEN 'unchanged' ELSE 'updated' END AS action FROM (SELECT seq, concat('key', cast(seq as string)) AS k FROM nodes)"))
def session_upsert_actions(t):
    n = t.nodes().withColumn("key", F.expr("concat('key', cast(seq as string))"))
    have = n.where("seq % 3 > 0").select(F.concat(F.lit("mem_session_"), F.substring(F.sha1(F.col("key").cast("binary")), 1, 16)).alias("node_id"), F.expr("CASE WHEN seq % 3 = 1 THEN content ELSE concat(content, '!') END").alias("content"))
    return L.session_actions(n.select("key", "content"), have)


@query(sql("SELECT seq AS draft_id, CASE WHEN type = 'transient' OR okf_type IS NOT NULL THEN 'as_is' WHEN seq % 4 = 1 THEN 'inferred' ELSE 'reshape' END AS plan FROM nodes"))
def write_plan(t):
    return L.write_plan(t.nodes().select(F.col("seq").alias("draft_id"), "type", "okf_type", F.when(F.col("seq") % 4 == 1, "fact").alias("inferred")))


@query(sql("SELECT owner, array_to_string(list(node_id ORDER BY pos), ',') AS related FROM (SELECT owner, w.node_id, min(pos) AS pos FROM (SELECT source_id AS owner, target_id AS node_id, seq % 5 AS pos FROM edges JOIN nodes ON node_id = target_id) w JOIN nodes n ON n.node_id = w.node_id WHERE n.status = 'active' AND n.type = 'persistent' AND w.node_id <> owner GROUP BY ALL) GROUP BY owner").replace("ORDER BY pos)", "ORDER BY pos, node_id)"))
def related_ids(t):
    n = t.nodes()
    wanted = t.edges().selectExpr("source_id owner", "target_id node_id").join(n.selectExpr("node_id", "seq % 5 pos"), "node_id")
    return L.related_ids(n, wanted).withColumn("related", F.array_join("related", ","))


@query(sql("SELECT event_id // 20 AS run_id, count(*) AS operations, count(*) FILTER (action IS NULL) AS invalid, count(*) FILTER (action = 'create') AS created, count(*) FILTER (action = 'supersede') AS updated, CAST(0 AS BIGINT) AS quarantined FROM writes GROUP BY 1"))
def run_roll_up(t):
    return L.rolled_up(t.writes().select(F.expr("event_id div 20").alias("run_id"), "action"))


@query(sql("SELECT node_id AS name, CASE WHEN n > 1 THEN s || '-' || n ELSE s END AS slug FROM (SELECT node_id, 'p' || (seq % 37) AS s, row_number() OVER (PARTITION BY seq % 37 ORDER BY node_id) AS n FROM nodes)"))
def unique_slugs(t):
    return L.unique_slugs(t.nodes().selectExpr("node_id name", "concat('p', cast(seq % 37 as string)) slug"))


@query(sql("SELECT node_id FROM nodes WHERE list_contains(sources, 'session:4') OR contains(content, '[[session:4]]')"))
def citing_nodes(t):
    return L.citing(t.nodes(), "session:4").select("node_id")


@query(sql("SELECT event_id FROM searches WHERE ts >= TIMESTAMP '2024-01-20'"))
def retention_prune(t):
    return L.pruned(t.searches(), "ts", F.expr("timestamp'2024-01-20'")).select("event_id")


@query(sql("SELECT stage, node_id FROM (SELECT 'condense' AS stage, node_id FROM nodes WHERE seq % 3 = 0 AND node_id NOT IN (SELECT node_id FROM nodes WHERE seq % 2 = 0))"))
def later_stage(t):
    n = t.nodes()
    return L.without(n.where("seq % 3 = 0"), n.where("seq % 2 = 0")).select(F.lit("condense").alias("stage"), "node_id")


@query(sql(f"SELECT node_id, status, CAST(epoch(CASE WHEN status = 'active' AND seq % 5 = 0 THEN {TS} ELSE last_accessed END) AS BIGINT) AS last_accessed, CASE WHEN status <> 'active' THEN 'untouched' WHEN seq % 5 = 0 THEN 'kept' WHEN seq % 5 = 1 THEN 'archived' WHEN seq % 5 = 2 THEN 'condensed' ELSE 'untouched' END AS fate FROM nodes"))
def triage(t):
    """B2."""
    n = t.nodes()
    d = n.where("seq % 5 < 3").selectExpr("node_id", "CASE seq % 5 WHEN 0 THEN 'keep' WHEN 1 THEN 'archive' ELSE 'condense' END decision").union(t.spark.createDataFrame([("gone", "keep")], "node_id string, decision string"))
    return L.triage_applied(n, d, NOW).withColumn("last_accessed", F.unix_seconds("last_accessed"))


@query(sql("SELECT node_id, node_id || '.md' AS path, CASE seq % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'same' ELSE 'write' END AS action, CASE WHEN seq % 4 > 1 THEN sha256(content) END AS digest FROM nodes UNION ALL SELECT node_id, '.collisions/' || node_id || '.' || left(sha1(content || ' old'), 8) || '.md', 'write', sha256(content || ' old') FROM nodes WHERE seq % 4 = 3"))
def archive_moves(t):
    """B9."""
    n = t.nodes()
    texts = n.select("node_id", F.when(F.col("seq") % 4 > 0, F.col("content")).alias("text"))
    there = n.where("seq % 4 in (1, 3)").select("node_id", F.when(F.col("seq") % 4 == 1, F.col("content")).otherwise(F.concat("content", F.lit(" old"))).alias("text"))
    return L.archived(texts, there).select("node_id", "path", "action", F.sha2("text", 256).alias("digest"))


@query(sql("SELECT 'vector' AS what, node_id AS a, '' AS b FROM vectors WHERE node_id NOT IN (SELECT node_id FROM nodes WHERE type = 'transient') UNION ALL SELECT 'edge', source_id, target_id FROM edges WHERE source_id NOT IN (SELECT node_id FROM nodes WHERE type = 'transient') AND target_id NOT IN (SELECT node_id FROM nodes WHERE type = 'transient')"))
def transcripts_pruned(t):
    """B12."""
    v, e = L.without_transcripts(t.vectors(), t.edges(), t.nodes().where("type = 'transient'"))
    return v.select(F.lit("vector").alias("what"), F.col("node_id").alias("a"), F.lit("").alias("b")).union(e.select(F.lit("edge"), "source_id", "target_id"))


_DRAFTS = """dr AS (SELECT seq AS draft_id, 'x' || seq AS new_id, title, CASE WHEN seq % 6 = 0 THEN content ELSE content || chr(10) || 'more ' || node_id END AS content, sources AS new_sources, node_id AS target, CASE seq % 6 WHEN 1 THEN 'create' WHEN 2 THEN 'complement' WHEN 5 THEN 'erase' ELSE 'supersede' END AS action FROM nodes),
tw AS (SELECT d.draft_id, arg_max(n.node_id, struct_pack(t := n.created_at, n := n.node_id)) AS twin FROM dr d JOIN nodes n ON n.title = d.title AND n.content = d.content AND n.status = 'active' GROUP BY d.draft_id),
ok AS (SELECT d.*, list_contains(list_transform(n.sources, lambda s: starts_with(s, 'session:') OR starts_with(s, 'mem_session_')), true) AS distilled, n.superseded_by IS NOT NULL AS claimed FROM dr d JOIN nodes n ON n.node_id = d.target WHERE draft_id NOT IN (SELECT draft_id FROM tw) AND action <> 'erase'),
fin AS (SELECT *, action = 'supersede' AND (NOT distilled OR claimed) AS softer FROM ok)"""


@query(sql("SELECT d.draft_id, CASE WHEN twin IS NOT NULL THEN 'identical' WHEN d.action = 'erase' THEN 'invalid' WHEN softer THEN 'downgraded' ELSE d.action END AS outcome, CASE WHEN twin IS NOT NULL THEN twin WHEN d.action = 'erase' THEN 'unsupported_action' END AS detail FROM dr d LEFT JOIN tw USING (draft_id) LEFT JOIN fin f ON f.draft_id = d.draft_id", _DRAFTS))
def write_outcomes(t):
    """A draft for each node, most of which say more than it."""
    return _written(t)[0]


@query(sql("SELECT n.node_id, CASE WHEN heir IS NOT NULL THEN 'superseded' ELSE status END AS status, coalesce(heir, superseded_by) AS superseded_by, sha256(CASE WHEN link IS NOT NULL THEN rtrim(content, ' ') || chr(10) || chr(10) || '- [[' || link || ']]' ELSE content END) AS digest, '' AS supersedes FROM nodes n LEFT JOIN (SELECT target, CASE WHEN action = 'supersede' AND NOT softer THEN new_id END AS heir, CASE WHEN action = 'complement' OR softer THEN new_id END AS link FROM fin WHERE action <> 'create') f ON f.target = n.node_id UNION ALL SELECT new_id, 'active', NULL, sha256(content), CASE WHEN action = 'supersede' AND NOT softer THEN target ELSE '' END FROM fin", _DRAFTS))
def write_snapshot(t):
    """The nodes after the drafts were written."""
    return _written(t)[1].select("node_id", "status", "superseded_by", F.sha2("content", 256).alias("digest"), F.array_join("supersedes", ",").alias("supersedes"))


def _written(t):
    n = t.nodes()
    drafts = n.select(F.col("seq").alias("draft_id"), F.expr("concat('x', cast(seq as string))").alias("new_id"), "title", F.when(F.col("seq") % 6 == 0, F.col("content")).otherwise(F.concat("content", F.lit("\nmore "), F.col("node_id"))).alias("content"), "sources")
    d = n.select(F.col("seq").alias("draft_id"), F.expr("CASE seq % 6 WHEN 1 THEN 'create' WHEN 2 THEN 'complement' WHEN 5 THEN 'erase' ELSE 'supersede' END").alias("action"), F.expr("CASE WHEN seq % 6 = 1 THEN cast(array() as array<string>) ELSE array(node_id) END").alias("targets"), F.lit(0.9).alias("confidence"))
    return L.write_path(drafts, n, n.selectExpr("seq draft_id", "node_id"), d)


@query(sql("SELECT node_id, sha256(concat('## Details', n, '- ', w, n, '- common', n, n, '- new ', seq, n, n, '## Sources', n, '- mem_2')) AS digest, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS sources, 0 AS lost FROM (SELECT *, list_concat(sources, ['session:1', 'mem_2']) AS l, chr(10) AS n, concat('z', regexp_replace(content, '[^a-zA-Z]+', ' ', 'g'), 'z') AS w FROM nodes)"))
def merge_updates(t):
    """B17."""
    n = t.nodes().withColumn("content", F.concat(F.lit("## Details\n- z"), F.regexp_replace("content", "[^a-zA-Z]+", " "), F.lit("z\n- common\n")))
    u = n.select("node_id", F.expr("concat('## Details\\n- Common\\n- new ', seq, '\\n\\n## Sources\\n- mem_2')").alias("content"), F.array(F.lit("session:1"), F.lit("mem_2")).alias("sources"))
    return L.merge_updates(n, u).select("node_id", F.sha2("content", 256).alias("digest"), F.array_join(F.array_distinct("sources"), ",").alias("sources"), "lost")


@query(sql("SELECT episode_id, node_id, score, CAST(row_number() OVER (PARTITION BY episode_id ORDER BY score DESC, node_id) AS INTEGER) AS pos FROM (SELECT event_id // 50 AS episode_id, node_id, max(1.0 / rank) AS score FROM hits GROUP BY ALL)"))
def retrieved_lessons(t):
    """Every fifty searches are one episode's."""
    r = E.hits(t.searches()).selectExpr("event_id div 50 episode_id", "event_id query_id", "node_id", "1.0D / rank score")
    return L.retrieved_lessons(r)


@query(sql(f"SELECT node_id FROM (SELECT *, CASE WHEN seq % 4 < 2 THEN sha256(content) END AS put_off, seq % 6 = 1 AS retry FROM nodes) WHERE status = 'active' AND type = 'transient' AND last_accessed <= {TS} - INTERVAL 10 DAY AND (retry OR NOT coalesce(distilled_hash = sha256(content), false)) AND (retry OR put_off IS NULL OR put_off <> sha256(content)) ORDER BY last_accessed, node_id LIMIT 50"))
def deferred_sessions(t):
    """P13 with what was put off and what is to be tried again."""
    n = t.nodes().withColumn("put_off", F.when(F.col("seq") % 4 < 2, F.sha2("content", 256))).withColumn("retry", F.col("seq") % 6 == 1)
    return L.idle_transcripts(n, N.days_before(NOW, 10), 50, "put_off", "retry").select("node_id")


_MERGE = "cl AS (SELECT seq // 3 AS cluster, * FROM nodes), ac AS (SELECT cluster, count(*) AS total, cluster % 4 <> 0 OR count(*) < 2 AS accepted FROM cl GROUP BY cluster)"


@query(sql("SELECT cluster, accepted, CAST(CASE WHEN cluster % 4 = 0 THEN total ELSE 0 END AS INTEGER) AS missing, CAST(total AS INTEGER) AS total FROM ac", _MERGE))
def merge_gate(t):
    """Notes with a literal each, of which every fourth draft keeps none."""
    return _merged(t)[0]


@query(sql("SELECT node_id, CASE WHEN accepted THEN 'superseded' ELSE status END AS status, CASE WHEN accepted THEN 'x' || cluster ELSE superseded_by END AS superseded_by, accepted AS ended, used_count FROM cl JOIN ac USING (cluster) UNION ALL SELECT 'x' || cluster, 'active', NULL, false, CAST(sum(used_count) AS BIGINT) FROM cl JOIN ac USING (cluster) WHERE accepted GROUP BY cluster", _MERGE))
def merge_snapshot(t):
    """The nodes after the merge."""
    return _merged(t)[1].select("node_id", "status", "superseded_by", F.col("valid_until").isNotNull().alias("ended"), "used_count")


def _merged(t):
    flag = F.concat(F.lit("flag_"), F.col("seq").cast("string"))
    n = t.nodes().withColumn("content", F.concat(F.lit("## Details\n- sets `"), flag, F.lit("` "), F.lower(F.regexp_replace("content", "[^a-zA-Z]+", " "))))
    clusters = n.selectExpr("seq div 3 cluster", "node_id")
    drafts = n.withColumn("cluster", F.expr("seq div 3")).groupBy("cluster").agg(F.array_join(F.collect_list(flag), " and ").alias("flags"))
    drafts = drafts.select("cluster", F.concat(F.lit("x"), F.col("cluster").cast("string")).alias("new_id"), F.lit("Merged").alias("title"), F.when(F.col("cluster") % 4 == 0, "## Details\n- nothing").otherwise(F.concat(F.lit("## Details\n- all of "), F.col("flags"))).alias("content"))
    return L.semantic_merge(n, clusters, drafts, NOW)


def _long(t, least=3):
    """Notes of `least` to twelve sections, the first with the whole text, or of one that can't be split; `most` is 500 bytes more than the text."""
    w = F.concat(F.lit("z"), F.regexp_replace(F.coalesce("content", F.lit("")), "[^a-zA-Z]+", " "))
    body = lambda k: F.concat(F.lit("## S"), F.char(k + 96), F.lit("\n"), F.when(k == 1, w).otherwise("z"), F.repeat(F.lit("."), 60))
    many = F.concat(F.lit("## Takeaway\n\nT.\n\n"), F.array_join(F.transform(F.sequence(F.lit(1).cast("long"), F.greatest(F.col("seq") % 10 + 3, F.lit(least).cast("long"))), body), "\n\n"))
    one = F.concat(F.lit("## Takeaway\n\nT.\n\n## Details\n"), w, F.repeat(F.lit(" word"), 140))
    return t.texts().select("seq", "node_id", F.coalesce("title", F.lit("")).alias("title"), F.when(F.col("seq") % 4 == 0, one).otherwise(many).alias("content"), (F.length(w) + 500).alias("most"))


@query(sql("SELECT seq, CASE WHEN seq % 4 > 0 AND seq % 10 >= 4 THEN CAST(seq % 10 + 3 AS INTEGER) ELSE 0 END AS sections, true AS fits, true AS linked FROM nodes"))
def sibling_parts(t):
    """All sections are in some part, each part is short enough, and links to each other one."""
    n = _long(t)
    p = L.siblings(n, F.col("most"))
    p = p.select("node_id", "part", F.regexp_count("content", F.lit(r"(?m)^## S[a-l]$")).alias("s"), F.regexp_count("content", F.lit(r"_part_\d+\]\]")).alias("l"), F.octet_length("content").alias("size"))
    p = p.groupBy("node_id").agg(F.count("part").alias("n"), F.coalesce(F.sum("s"), F.lit(0)).cast("int").alias("sections"), F.max("size").alias("size"), F.min("l").alias("least"), F.max("l").alias("most_links"))
    p = p.select("node_id", "sections", "size", F.coalesce((F.col("least") == F.col("n") - 1) & (F.col("most_links") == F.col("n") - 1), F.lit(True)).alias("linked"))
    return n.select("seq", "node_id", "most").join(p, "node_id").select("seq", "sections", F.coalesce(F.col("size") <= F.col("most"), F.lit(True)).alias("fits"), "linked")


@query(sql("SELECT node_id, CASE WHEN seq % 3 = 0 THEN 'compacted' WHEN seq % 4 > 0 THEN 'split' ELSE 'attempted' END AS action FROM nodes"))
def oversized_actions(t):
    """All notes are over their limit; every third one has a compact version."""
    n = _long(t, least=8)
    short = n.where("seq % 3 = 0").select("node_id", F.lit("## Takeaway\n\nT.\n\n## Details\nshort").alias("content"))
    return L.oversized_plan(n.drop("seq"), short, F.col("most")).select("node_id", "action")
