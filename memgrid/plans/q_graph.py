"""Queries on chains, provenance and links."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgrid.operators import graph as G
from memgrid.plans.catalog import query
from memgrid.sources.logical import sql

_WALK = "walk AS (SELECT node_id, node_id AS cur, 0 AS d FROM nodes UNION ALL SELECT w.node_id, n.superseded_by, d + 1 FROM walk w JOIN nodes n ON n.node_id = w.cur JOIN nodes s ON s.node_id = n.superseded_by WHERE d < 70)"
_ENDS = "ends AS (SELECT w.node_id, CASE WHEN d >= 64 THEN NULL ELSE w.cur END AS ende, CASE WHEN d >= 64 THEN 'cycle' WHEN n.superseded_by IS NULL THEN 'terminal' ELSE 'missing_successor' END AS outcome FROM (SELECT node_id, arg_max(cur, d) AS cur, max(d) AS d FROM walk GROUP BY node_id) w JOIN nodes n ON n.node_id = w.cur)"


@query(sql('SELECT node_id, ende AS "end", outcome FROM ends', _WALK, _ENDS))
def supersession_terminal(t):
    return G.chain_ends(t.nodes())


_V = "SELECT x.node_id, CASE WHEN x.superseded_by IS NULL THEN 'archive' WHEN outcome = 'cycle' THEN 'cyclic_supersession' WHEN outcome = 'missing_successor' THEN 'archive' WHEN e.status = 'disputed' THEN 'disputed_superseder' {} ELSE 'archive' END AS verdict FROM nodes x JOIN ends USING (node_id) LEFT JOIN nodes e ON e.node_id = ende WHERE x.status = 'superseded'"


@query(sql(_V.format("WHEN e.status <> 'active' OR e.seq % 9 = 0 THEN 'invalid_superseder'"), _WALK, _ENDS))
def archive_verdict(t):
    return G.archive_verdicts(t.nodes(), F.col("seq") % 9 != 0)


@query(sql(_V.format(""), _WALK, _ENDS))
def archive_verdict_loose(t):
    return G.archive_verdicts(t.nodes(), need_active=False)


_ROOT = "regexp_matches({}, '^(mem_session_|skill://|managed-skill:|https?://|session:)')"
_PROV = [
    "links AS (SELECT node_id AS a, unnest(sources) AS b FROM nodes)",
    f"reach AS (SELECT a, b FROM links WHERE NOT {_ROOT.format('b')} UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b WHERE NOT {_ROOT.format('l.b')})",
    f"rts AS (SELECT a, b FROM links WHERE {_ROOT.format('b')} UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b WHERE {_ROOT.format('l.b')})",
    "prov AS (SELECT node_id, len(sources) AS n_direct, (SELECT count(*) FROM rts WHERE a = node_id) AS n_roots, EXISTS (SELECT 1 FROM reach WHERE a = node_id AND b NOT IN (SELECT a FROM links)) AS unknown, EXISTS (SELECT 1 FROM reach r JOIN reach c ON c.a = r.b AND c.b = r.b WHERE r.a = node_id) AS cyclic FROM nodes WHERE status = 'active' AND type = 'persistent')",
]


@query(sql("SELECT node_id, CAST(n_direct AS INTEGER) AS n_direct, CAST(n_roots AS BIGINT) AS n_roots, unknown, cyclic FROM prov", *_PROV))
def provenance_paths(t):
    return G.provenance(t.nodes())


@query(sql("SELECT count(*) FILTER (n_roots >= 2) AS multi_source, count(*) FILTER (n_roots = 1 AND n_direct >= 2 AND NOT unknown AND NOT cyclic) AS same_root, count(*) FILTER (unknown OR cyclic) AS unknown_or_cyclic FROM prov", *_PROV))
def provenance_counts(t):
    return G.provenance_counts(G.provenance_states(t.texts()))


_TXT = "CASE seq % 4 WHEN 0 THEN concat(content, ' [[', {0}, ']] and [[ ', {1}, ' | other ]]') WHEN 1 THEN concat('[[', title, ']]') WHEN 2 THEN concat('[[none]] [[', node_id, ']]') ELSE content END"


def _ids(n: str) -> tuple[str, str]:
    return f"concat('n', lpad(cast(seq * 3 % {n} as string), 8, '0'))", f"concat('n', lpad(cast(seq * 7 % {n} as string), 8, '0'))"


@query(sql("SELECT DISTINCT source_id, t AS target_id FROM (SELECT source_id, coalesce(e.m, l.m) AS t FROM lk LEFT JOIN (SELECT a, min(node_id) AS m FROM al GROUP BY a) e ON e.a = target LEFT JOIN (SELECT lower(a) AS a, min(node_id) AS m FROM al GROUP BY 1) l ON l.a = lower(target)) WHERE t IS NOT NULL AND t <> source_id", f"tx AS (SELECT node_id, title, {_TXT.format(*_ids('n'))} AS content FROM nodes, n_docs)", "lk AS (SELECT node_id AS source_id, trim(split_part(unnest(regexp_extract_all(content, '\\[\\[([^\\]]+)\\]\\]', 1)), '|', 1)) AS target FROM tx)", "al AS (SELECT node_id, unnest([node_id, title]) AS a FROM tx)"))
def wiki_edges(t):
    n = t.nodes().selectExpr("node_id", "title", f"{_TXT.format(*_ids(t.n()))} content")
    return G.edges_from_text(n)


@query(sql("SELECT n.node_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), ',') AS sources, moved AS hits FROM nodes n JOIN (SELECT node_id, list(coalesce(ende, s) ORDER BY i) AS l, count(ende) AS moved FROM (SELECT node_id, unnest(sources) AS s, unnest(range(len(sources))) AS i FROM nodes) LEFT JOIN (SELECT e.node_id AS old, ende FROM ends e JOIN nodes x ON x.node_id = e.node_id JOIN nodes y ON y.node_id = ende WHERE x.status = 'superseded' AND outcome = 'terminal' AND y.status = 'active' AND ende <> e.node_id) ON old = s GROUP BY node_id) USING (node_id) WHERE moved > 0", _WALK, _ENDS))
def repointed_sources(t):
    return G.repointed(t.nodes()).select("node_id", F.array_join("sources", ",").alias("sources"), "hits")


@query(sql("SELECT l.query_id, CASE WHEN outcome = 'terminal' AND s.status <> 'superseded' THEN ende END AS node_id FROM (SELECT seq % 40 AS query_id, node_id FROM nodes UNION ALL SELECT 1, 'gone') l LEFT JOIN (SELECT w.node_id, CASE WHEN d >= 64 THEN NULL ELSE w.cur END AS ende, CASE WHEN d >= 64 THEN 'cycle' WHEN n.nx IS NULL THEN 'terminal' ELSE 'missing' END AS outcome FROM (SELECT node_id, arg_max(cur, d) AS cur, max(d) AS d FROM wl GROUP BY node_id) w JOIN fo n ON n.node_id = w.cur) e ON e.node_id = l.node_id LEFT JOIN nodes s ON s.node_id = ende GROUP BY ALL", "fo AS (SELECT node_id, CASE WHEN status = 'superseded' THEN superseded_by END AS nx FROM nodes)", "wl AS (SELECT node_id, node_id AS cur, 0 AS d FROM nodes UNION ALL SELECT w.node_id, n.nx, d + 1 FROM wl w JOIN fo n ON n.node_id = w.cur JOIN nodes s ON s.node_id = n.nx WHERE d < 70)"))
def resolved_labels(t):
    n = t.nodes()
    labels = n.selectExpr("seq % 40 query_id", "node_id").union(n.sparkSession.createDataFrame([(1, "gone")], "query_id long, node_id string"))
    return G.resolved_labels(labels, n)


_GOLD = "g AS (SELECT seq AS query_id, seq % 9 = 0 AS expect_no_result, CASE seq % 6 WHEN 0 THEN [] WHEN 1 THEN [node_id] WHEN 2 THEN [node_id, 'gone'] ELSE [node_id, concat('n', lpad(cast(seq + 1 as string), 8, '0')), concat('n', lpad(cast(seq - 1 as string), 8, '0'))] END AS relevant FROM nodes), el AS (SELECT w.node_id, CASE WHEN d < 64 AND n.nx IS NULL AND s.status <> 'superseded' THEN w.cur END AS live FROM (SELECT node_id, arg_max(cur, d) AS cur, max(d) AS d FROM wl GROUP BY node_id) w JOIN fo n ON n.node_id = w.cur JOIN nodes s ON s.node_id = w.cur), rs AS (SELECT query_id, list_sort(list(DISTINCT live) FILTER (live IS NOT NULL)) AS must, count(*) FILTER (live IS NULL) AS stale FROM (SELECT query_id, unnest(relevant) AS node_id FROM g WHERE NOT expect_no_result) LEFT JOIN el USING (node_id) GROUP BY query_id)"


@query(sql("SELECT query_id, array_to_string(CASE WHEN stale IS NULL THEN relevant ELSE coalesce(must, []) END, ',') AS must, coalesce(stale, 0) AS stale, NOT expect_no_result AND NOT (stale IS NOT NULL AND len(coalesce(must, [])) = 0) AS counted, NOT expect_no_result AS counted_strict FROM g LEFT JOIN rs USING (query_id)", "fo AS (SELECT node_id, CASE WHEN status = 'superseded' THEN superseded_by END AS nx FROM nodes)", "wl AS (SELECT node_id, node_id AS cur, 0 AS d FROM nodes UNION ALL SELECT w.node_id, n.nx, d + 1 FROM wl w JOIN fo n ON n.node_id = w.cur JOIN nodes s ON s.node_id = n.nx WHERE d < 70)", _GOLD))
def label_states(t):
    """E5: labels of which some have a successor, some are stale, and some were never there."""
    n = t.texts()
    near = "concat('n', lpad(cast(seq {} 1 as string), 8, '0'))"
    g = n.selectExpr("seq query_id", "seq % 9 = 0 expect_no_result", f"CASE seq % 6 WHEN 0 THEN cast(array() as array<string>) WHEN 1 THEN array(node_id) WHEN 2 THEN array(node_id, 'gone') ELSE array(node_id, {near.format('+')}, {near.format('-')}) END relevant")
    return G.label_states(g, n).withColumn("must", F.array_join("must", ","))
