"""Queries on vectors: nearest neighbours, similarity joins, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgrid.operators import nodes as N, vectors as V
from memgrid.plans.catalog import query
from memgrid.sources.logical import NOW, sql

SIM = "list_dot_product(a.embedding, b.embedding)"
_CLIP = "greatest(-1, least(1, {}))"
_PAIRS = f"pairs AS (SELECT a.node_id AS id_a, b.node_id AS id_b, round(1 - round(1 - {_CLIP.format(SIM)}, 8), 8) AS sim FROM v a JOIN v b ON a.node_id < b.node_id)"
_V = "v AS (SELECT * FROM vectors)"
TYPED = "status = 'active' AND type = 'persistent' AND okf_type IS NOT NULL"
_T = f"v AS (SELECT node_id, embedding, coalesce(project, '') AS project FROM vectors JOIN nodes USING (node_id) WHERE {TYPED})"
THRESHOLDS = (0.25, 0.3, 0.35, 0.4, 0.45)


@query(sql(f"SELECT node_id, round(d, 5) AS distance FROM (SELECT a.node_id, greatest(0, round(1 - {_CLIP.format(SIM)}, 8)) AS d FROM vectors a, (SELECT * FROM vectors WHERE node_id = 'n00000007') b ORDER BY d, a.node_id LIMIT 10)"))
def vector_topk(t):
    v = t.vectors()
    q = v.where("node_id = 'n00000007'").first()
    return V.top_k(v, list(q.embedding) if q else [1.0], 10).withColumn("distance", F.greatest(F.lit(0.0), F.round("distance", 5)))


_DQ = "round(1 - greatest(-1, least(1, list_dot_product(a.embedding, CAST(b.embedding AS DOUBLE[])))), 8)"


@query(sql(f"SELECT query_id, node_id, greatest(0, round(d, 5)) AS distance, CAST(rank AS INTEGER) AS rank FROM (SELECT b.vec_id AS query_id, a.node_id, {_DQ} AS d, row_number() OVER (PARTITION BY b.vec_id ORDER BY {_DQ}, a.node_id) AS rank FROM vectors a, (SELECT * FROM embeddings WHERE vec_id % 100 = 0) b) WHERE rank <= 10"))
def vector_search(t):
    q = t.raw("embeddings").where("vec_id % 100 = 0").selectExpr("vec_id query_id", "cast(embedding as array<double>) vector")
    return t.vector_index().nearest(q, 10).withColumn("distance", F.greatest(F.lit(0.0), F.round("distance", 5)))


@query(sql("SELECT id_a, id_b, round(sim, 5) AS sim FROM pairs WHERE sim >= 0.3", _V, _PAIRS))
def similar_pairs(t):
    return V.similar_pairs(t.vectors(), 0.3).withColumn("sim", F.round("sim", 5))


@query(sql("SELECT id_a, id_b, round(sim, 5) AS sim FROM pairs WHERE sim >= 0.3 AND NOT EXISTS (SELECT 1 FROM edges e WHERE (e.source_id = id_a AND e.target_id = id_b) OR (e.source_id = id_b AND e.target_id = id_a))", _V, _PAIRS))
def missing_link_pairs(t):
    return V.similar_pairs(t.vectors(), 0.3, links=t.edges()).withColumn("sim", F.round("sim", 5))


@query(sql("SELECT t AS threshold, count(*) AS n FROM pairs, (SELECT unnest([0.25, 0.3, 0.35, 0.4, 0.45]::DOUBLE[]) AS t) WHERE sim >= t AND NOT EXISTS (SELECT 1 FROM edges e WHERE (e.source_id = id_a AND e.target_id = id_b) OR (e.source_id = id_b AND e.target_id = id_a)) GROUP BY t", _V, _PAIRS))
def similarity_histogram(t):
    return V.pair_counts(t.vectors(), THRESHOLDS, links=t.edges())


@query(sql("SELECT id_a, id_b, round(sim, 5) AS sim FROM pairs JOIN v a ON a.node_id = id_a JOIN v b ON b.node_id = id_b WHERE a.project = b.project AND sim >= 0.2", _T, _PAIRS))
def same_project_pairs(t):
    return V.similar_pairs(V.typed(t.nodes(), t.vectors()), 0.2, by="project").withColumn("sim", F.round("sim", 5))


_REACH = "reach AS (SELECT id_a AS node_id, id_b AS other FROM p UNION SELECT id_b, id_a FROM p UNION SELECT r.node_id, q.other FROM reach r JOIN (SELECT id_a AS a, id_b AS other FROM p UNION ALL SELECT id_b, id_a FROM p) q ON q.a = r.other), lab AS (SELECT node_id, least(node_id, min(other)) AS label FROM reach GROUP BY node_id)"


@query(sql("SELECT label, node_id FROM lab WHERE label IN (SELECT label FROM lab GROUP BY label HAVING count(*) BETWEEN 3 AND 20)", _T, _PAIRS, "p AS (SELECT id_a, id_b FROM pairs JOIN v a ON a.node_id = id_a JOIN v b ON b.node_id = id_b WHERE a.project = b.project AND sim >= 0.2)", _REACH))
def single_linkage_clusters(t):
    return V.single_linkage(t.nodes(), t.vectors(), 0.2, 3, 20)


@query()
def complete_linkage(t):
    return V.complete_linkage(t.nodes(), t.vectors(), 0.22, 0.15)


_NN = f"nn AS (SELECT s.node_id AS source, a.node_id, 1 - round(1 - {_CLIP.format('list_dot_product(a.embedding, s.embedding)')}, 8) AS sim, row_number() OVER (PARTITION BY s.node_id ORDER BY round(1 - {_CLIP.format('list_dot_product(a.embedding, s.embedding)')}, 8), a.node_id) AS r FROM vectors a, (SELECT node_id, embedding FROM vectors JOIN nodes USING (node_id)) s)"


@query(sql(f"SELECT source, n.node_id, round(sim, 5) AS sim FROM nn n JOIN nodes x ON x.node_id = n.node_id JOIN nodes y ON y.node_id = source WHERE r <= 25 AND n.node_id <> source AND sim >= 0.1 AND x.status = 'active' AND x.type = 'persistent' AND x.okf_type IS NOT NULL AND coalesce(x.project, '') = coalesce(y.project, '')", _NN))
def near_duplicate_nodes(t):
    n = t.texts()
    return V.near_duplicates(t.vectors(), n, n.select("node_id"), 0.1, index=t.vector_index()).withColumn("sim", F.round("sim", 5))


@query(sql("SELECT DISTINCT label FROM (SELECT c.label, h.node_id, count(*) AS k FROM c JOIN (SELECT DISTINCT node_id, unnest(sources) AS s FROM nodes WHERE status = 'active' AND okf_type IS NOT NULL) h ON h.s = c.node_id WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.label = c.label AND x.node_id = h.node_id) GROUP BY ALL) JOIN (SELECT label, count(*) AS n FROM c GROUP BY label) USING (label) WHERE k >= 0.7 * n", "c AS (SELECT seq // 2 AS label, node_id FROM nodes)"))
def covered_clusters(t):
    n = t.nodes()
    return V.hub_covered(n.selectExpr("seq div 2 label", "node_id"), n)


@query(sql(f"SELECT source, node_id, round(sim, 5) AS sim FROM (SELECT n.source, n.node_id, sim, list_distinct(regexp_extract_all(lower(x.content), '[a-z0-9]{{2,}}')) AS p, list_distinct(regexp_extract_all(lower(y.content), '[a-z0-9]{{2,}}')) AS q FROM nn n JOIN nodes x ON x.node_id = n.node_id JOIN nodes y ON y.node_id = source WHERE r <= 25 AND n.node_id <> source AND sim >= 0.1 AND x.status = 'active' AND x.type = 'persistent' AND x.okf_type IS NOT NULL AND coalesce(x.project, '') = coalesce(y.project, '')) WHERE len(p) + len(q) > 0 AND len(list_intersect(p, q)) / (len(p) + len(q) - len(list_intersect(p, q))) >= 0.3", _NN))
def near_duplicate_gate(t):
    """Near by vectors and by tokens."""
    n = t.texts()
    return V.near_duplicates(t.vectors(), n, n.select("node_id"), 0.1, overlap=0.3, index=t.vector_index()).withColumn("sim", F.round("sim", 5))


@query(sql("SELECT id_a, id_b FROM pairs WHERE sim >= 0.3 ORDER BY id_a, id_b LIMIT 100", _V, _PAIRS))
def capped_pairs(t):
    """What one run looks at, the first pairs by id."""
    return V.similar_pairs(t.vectors(), 0.3).orderBy("id_a", "id_b").limit(100).select("id_a", "id_b")


@query(sql("SELECT node_id, CAST(floor(embedding[1] * 1000) AS BIGINT) AS first FROM (SELECT node_id, CASE WHEN n % 3 = 1 THEN list_transform(embedding, lambda x: -x) ELSE embedding END AS embedding, n FROM (SELECT *, CAST(substr(node_id, 2) AS BIGINT) AS n FROM vectors)) WHERE n % 3 <> 2"))
def vector_changes(t):
    """V2: a snapshot after some vectors were replaced and some deleted."""
    v = t.vectors().withColumn("n", F.substring("node_id", 2, 8).cast("long"))
    new = v.where("n % 3 = 1").select("node_id", F.transform("embedding", lambda x: -x).alias("embedding"))
    out = V.changed(v.drop("n"), new, v.where("n % 3 = 2").select("node_id"))
    return out.select("node_id", F.floor(F.element_at("embedding", 1) * 1000).alias("first"))


@query(sql(f"SELECT id_a, id_b, round(sim, 5) AS sim FROM pairs WHERE sim >= 0.3 AND NOT EXISTS (SELECT 1 FROM edges e WHERE (e.source_id = id_a AND e.target_id = id_b) OR (e.source_id = id_b AND e.target_id = id_a))", f"v AS (SELECT node_id, embedding FROM vectors JOIN nodes USING (node_id) WHERE status = 'active' AND last_accessed >= TIMESTAMP '{NOW}' - INTERVAL 60 DAY)", _PAIRS))
def recent_missing_links(t):
    """Among active nodes that were read in the last sixty days."""
    v = V.recent(t.vectors(), t.nodes(), N.days_before(NOW, 60))
    return V.unlinked(V.similar_pairs(v, 0.3), t.edges()).withColumn("sim", F.round("sim", 5))


@query(sql(f"SELECT id_a, id_b FROM pairs JOIN v a ON a.node_id = id_a JOIN v b ON b.node_id = id_b WHERE a.project = b.project AND sim >= 0.25", f"v AS (SELECT node_id, embedding, CASE WHEN project IS NOT NULL THEN project WHEN contains(lower(concat_ws(' ', node_id, title, content)), 'the') THEN 'english' ELSE 'general' END AS project FROM vectors JOIN nodes USING (node_id) WHERE {TYPED})", _PAIRS))
def inferred_project_pairs(t):
    """V9: projects as their texts tell them."""
    p = V.cluster_project("inferred", [("english", ["the"])])
    return V.similar_pairs(V.typed(t.nodes(), t.vectors(), project=p), 0.25, by="project").select("id_a", "id_b")
