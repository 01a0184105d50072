"""Queries on engines, episodes, and the state of everything."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgrid.functions import episodes as E
from memgrid.operators import engines, graph, nodes as N, vectors as V
from memgrid.plans.catalog import query
from memgrid.plans.q_graph import _ENDS, _WALK
from memgrid.plans.q_retrieval import LEX
from memgrid.plans.q_vectors import _PAIRS, _REACH, _T, _V
from memgrid.sources.logical import NOW, sql

TS = f"TIMESTAMP '{NOW}'"


@query(sql(f"SELECT 'active' AS what, count(*) AS n FROM nodes WHERE status = 'active' UNION ALL SELECT 'superseded', count(*) FROM nodes WHERE status = 'superseded' UNION ALL SELECT 'disputed', count(*) FROM nodes WHERE status = 'disputed' UNION ALL SELECT 'vectorless', count(*) FROM nodes WHERE node_id NOT IN (SELECT node_id FROM vectors) UNION ALL SELECT 'stale_orphans', count(*) FROM nodes WHERE status = 'active' AND last_accessed <= {TS} - INTERVAL 30 DAY AND node_id NOT IN (SELECT source_id FROM edges) AND node_id NOT IN (SELECT target_id FROM edges) UNION ALL SELECT 'archivable', count(*) FROM nodes x JOIN ends USING (node_id) LEFT JOIN nodes e ON e.node_id = ende WHERE x.status = 'superseded' AND (outcome = 'missing_successor' OR (outcome = 'terminal' AND e.status = 'active')) UNION ALL SELECT 'missing_links', count(*) FROM pairs WHERE sim >= 0.3 AND NOT EXISTS (SELECT 1 FROM edges e WHERE (e.source_id = id_a AND e.target_id = id_b) OR (e.source_id = id_b AND e.target_id = id_a)) UNION ALL SELECT 'disputed_pairs', count(*) FROM nodes a JOIN nodes b ON a.superseded_by = b.node_id AND b.superseded_by = a.node_id WHERE a.status = 'disputed' AND b.status = 'disputed' AND a.node_id < b.node_id", _WALK, _ENDS, _V, _PAIRS))
def health(t):
    """B21."""
    n, e, v = t.nodes(), t.edges(), t.vectors()
    one = lambda what, df: df.agg(F.count("*").alias("n")).select(F.lit(what).alias("what"), "n")
    out = N.status_counts(n).withColumnRenamed("status", "what")
    for what, df in {"vectorless": N.vectorless(n, v), "stale_orphans": N.stale_orphans(n, e, N.days_before(NOW, 30)), "archivable": graph.archive_verdicts(n).where("verdict = 'archive'"), "missing_links": V.unlinked(V.similar_pairs(v, 0.3), e), "disputed_pairs": N.disputed_pairs(n)}.items():
        out = out.union(one(what, df))
    return out


@query(sql("SELECT query_id, CAST(chunk AS INTEGER) AS chunk, length(text) AS chars FROM (SELECT query_id, unnest(range(len(l))) AS chunk, unnest(l) AS text FROM (SELECT query_id, list_prepend(x, list_filter(list_transform(string_split(x, chr(10) || '---' || chr(10)), lambda c: trim(c, ' ' || chr(10) || chr(9))), lambda c: length(c) >= 24 AND c <> trim(x, ' ' || chr(10) || chr(9)))) AS l FROM (SELECT item_id AS query_id, CASE WHEN item_id % 2 = 0 THEN replace(text, '. ', chr(10) || '---' || chr(10)) ELSE text END AS x FROM benchmark)))"))
def query_chunks(t):
    q = t.raw("benchmark").select(F.col("item_id").alias("query_id"), F.when(F.col("item_id") % 2 == 0, F.replace("text", F.lit(". "), F.lit("\n---\n"))).otherwise(F.col("text")).alias("text"))
    return engines.query_chunks(q).select("query_id", "chunk", F.length("text").cast("long").alias("chars"))


_SW = ", ".join(f"'{w}'" for w in E.SLUG_STOPWORDS)


@query(sql(f"SELECT seq, CASE WHEN n < 2 OR length(s) < 8 THEN '' ELSE s END AS slug FROM (SELECT seq, n, array_to_string(list_slice(l, 1, n), '_') AS s FROM (SELECT seq, l, len(list_filter(range(1, least(8, len(l)) + 1), lambda k: length(array_to_string(list_slice(l, 1, k), '_')) <= 48)) AS n FROM (SELECT seq, CASE WHEN len(t) > 0 THEN t ELSE w END AS l FROM (SELECT seq, w, list_filter(w, lambda x: x NOT IN ({_SW}) AND NOT regexp_full_match(x, '[0-9]+')) AS t FROM (SELECT seq, regexp_extract_all(lower(regexp_replace(strip_accents(content), '[^\\x00-\\x7F]+', '', 'g')), '[a-z0-9]+') AS w FROM nodes)))))"))
def english_slugs(t):
    """F6, of whole texts, so that every stopword comes up."""
    return t.texts().select("seq", E.english_slug(F.col("content")).alias("slug"))


@query(sql("SELECT conv_id, string_agg(number, ',' ORDER BY number) AS kept FROM (SELECT conv_id, CAST(number AS VARCHAR) AS number, row_number() OVER (PARTITION BY conv_id ORDER BY -(number % 3), CASE number % 5 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 4 ELSE 9 END, turns.number) AS p, sum(length(body)) OVER (PARTITION BY conv_id) AS c, count(*) OVER (PARTITION BY conv_id) AS n FROM turns) WHERE c >= 1500 OR n <= 3 OR p <= 3 GROUP BY conv_id"))
def lesson_cap(t):
    kinds = "CASE number % 5 WHEN 0 THEN 'pitfall' WHEN 1 THEN 'decision' WHEN 2 THEN 'procedure' WHEN 3 THEN 'fact' ELSE 'other' END"
    g = t.turns().select("conv_id", "body", F.struct("number", F.expr(kinds).alias("kind"), (F.col("number") % 3).alias("n")).alias("x")).groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias("x"), F.sum(F.length("body")).alias("c"))
    return g.select("conv_id", F.array_join(F.transform(E.capped_lessons(F.col("x"), F.col("c")), lambda y: y["number"].cast("string")), ",").alias("kept"))


@query()
def deterministic_embed(t):
    """V4: vectors of the notes; as numbers that a run on other data can be held against."""
    v = t.nodes().select("node_id", engines.embedded(F.col("content"), dimension=64).alias("embedding"))
    return v.select("node_id", F.round(V.dot("embedding", "embedding"), 4).alias("norm"), F.sha2(F.to_json(F.transform("embedding", lambda x: F.round(x, 6))), 256).alias("digest"))


_C = "c AS (SELECT label, node_id FROM lab WHERE label IN (SELECT label FROM lab GROUP BY label HAVING count(*) BETWEEN 3 AND 20)), cov AS (SELECT label FROM (SELECT c.label, h.node_id, count(*) AS k FROM c JOIN (SELECT DISTINCT node_id, unnest(sources) AS s FROM nodes WHERE status = 'active' AND okf_type IS NOT NULL) h ON h.s = c.node_id WHERE NOT EXISTS (SELECT 1 FROM c x WHERE x.label = c.label AND x.node_id = h.node_id) GROUP BY ALL) JOIN (SELECT label, count(*) AS n FROM c GROUP BY label) USING (label) WHERE k >= 0.7 * n)"


@query(sql("SELECT label, count(*) AS size, min(node_id) AS first FROM c WHERE label NOT IN (SELECT label FROM cov) GROUP BY label ORDER BY first LIMIT 20", _T, _PAIRS, "p AS (SELECT id_a, id_b FROM pairs JOIN v a ON a.node_id = id_a JOIN v b ON b.node_id = id_b WHERE a.project = b.project AND sim >= 0.2)", _REACH, _C))
def synthesis_hubs(t):
    """Clusters of a project that no node covers yet, first 20."""
    n = t.nodes()
    c = V.single_linkage(n, t.vectors(), 0.2, 3, 20)
    open_ = c.join(V.hub_covered(c, n), "label", "left_anti")
    return open_.groupBy("label").agg(F.count("*").alias("size"), F.min("node_id").alias("first")).orderBy("first").limit(20)


@query(sql("SELECT seq, type <> 'transient' AS has_vector, coalesce(n, 0) AS postings, coalesce(c, 0) AS chars, coalesce(e, 0) AS edges FROM nodes LEFT JOIN (SELECT node_id, count(*) AS n, CAST(sum(length(token)) AS BIGINT) AS c FROM posts GROUP BY node_id) USING (node_id) LEFT JOIN (SELECT node_id, len(regexp_extract_all(content, '\\[\\[')) AS e FROM nodes) USING (node_id)", LEX[3]))
def index_rebuild(t):
    """What is derived from each note, written anew: a vector or none, postings of the stored index, links."""
    n = t.texts()
    vectors = n.where("type <> 'transient'").select("node_id", engines.embedded(F.col("content")).alias("embedding")).where("embedding IS NOT NULL").select("node_id", F.lit(True).alias("v"))
    posts = t.lexical_index(anew=True).tokens()
    edges = graph.edges_from_text(n).groupBy(F.col("source_id").alias("node_id")).agg(F.count("*").alias("edges"))
    df = n.select("seq", "node_id").join(vectors, "node_id", "left").join(posts, "node_id", "left").join(edges, "node_id", "left")
    return df.select("seq", F.coalesce("v", F.lit(False)).alias("has_vector"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("postings", "chars", "edges")])
