"""Queries on lexical retrieval, fusion, scores, and the whole search."""

from __future__ import annotations

from pyspark.sql import functions as F

from memgrid.functions import scoring as S
from memgrid.functions.text import STOPWORDS
from memgrid.operators import lexical_index as X, nodes as N
from memgrid.operators.cuts import scratch_folder
from memgrid.plans import hybrid as H
from memgrid.plans.catalog import query
from memgrid.sources.logical import NOW, sql


def queries_of(t):
    """Each item of the benchmark, with the vector of that number."""
    v = t.raw("embeddings").selectExpr("vec_id query_id", "cast(embedding as array<double>) vector")
    return t.raw("benchmark").selectExpr("item_id query_id", "text").join(v, "query_id")


_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
#: Lexical retrieval. No text here has CJK characters, so both legs are the same.
LEX = [
    "q AS (SELECT item_id AS query_id, text FROM benchmark JOIN embeddings ON vec_id = item_id)",
    f"qt AS (SELECT query_id, list_filter(string_split_regex(trim(text), '\\s+'), lambda w: regexp_matches(w, '[\\p{{L}}\\p{{N}}_]') AND lower(w) NOT IN ({_STOP}) AND length(w) >= 2) AS l FROM q)",
    "terms AS (SELECT query_id, regexp_extract_all(lower(strip_accents(t)), '[\\p{L}\\p{N}]+') AS tokens FROM (SELECT query_id, unnest(list_slice(list_filter(l, lambda x, i: list_position(l, x) = i), 1, 24)) AS t FROM qt))",
    "posts AS (SELECT node_id, c, unnest(ts) AS token, unnest(range(len(ts))) AS pos FROM (SELECT node_id, c, regexp_extract_all(lower(strip_accents(x)), '[\\p{L}\\p{N}]+') AS ts FROM (SELECT node_id, unnest([0, 1, 2]) AS c, unnest([title, content, array_to_string(tags, ' ')]) AS x FROM nodes)))",
    "phr AS (SELECT DISTINCT tokens FROM terms WHERE len(tokens) > 0), want AS (SELECT tokens, unnest(tokens) AS token, unnest(range(len(tokens))) AS i FROM phr)",
    "occ AS (SELECT tokens, node_id, c, pos - i AS start FROM posts JOIN want USING (token) GROUP BY tokens, node_id, c, pos - i HAVING count(*) = len(tokens))",
    "tf AS (SELECT tokens, node_id, count(*) AS tf FROM occ GROUP BY tokens, node_id), df AS (SELECT tokens, count(*) AS df FROM tf GROUP BY tokens)",
    "dl AS (SELECT node_id, count(*) AS len FROM posts GROUP BY node_id), av AS (SELECT sum(len) / (SELECT count(*) FROM nodes) AS a FROM dl)",
    "bm AS (SELECT query_id, node_id, sum(greatest(1e-6, ln(((SELECT count(*) FROM nodes) - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / a))) AS score FROM terms JOIN tf USING (tokens) JOIN df USING (tokens) JOIN dl USING (node_id), av GROUP BY query_id, node_id)",
    "leg AS (SELECT * FROM (SELECT query_id, node_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 8) DESC, node_id) AS rank FROM bm) WHERE rank <= 20)",
    "mg AS (SELECT query_id, node_id, 200 / (60 + rank) AS score, rank FROM leg)",
]
_CLIPD = "round(1 - greatest(-1, least(1, list_dot_product(v.embedding, CAST(e.embedding AS DOUBLE[])))), 8)"
LEGS = [
    f"dn AS (SELECT * FROM (SELECT e.vec_id AS query_id, v.node_id, row_number() OVER (PARTITION BY e.vec_id ORDER BY {_CLIPD}, v.node_id) AS rank FROM vectors v, embeddings e WHERE e.vec_id IN (SELECT query_id FROM q)) WHERE rank <= 20)",
    "ok AS (SELECT * FROM nodes WHERE NOT (type = 'transient' AND seq % 10 = 0))",
    "lg AS (SELECT query_id, leg, node_id, row_number() OVER (PARTITION BY query_id, leg ORDER BY rank) AS rank FROM (SELECT query_id, 'lexical' AS leg, node_id, rank FROM mg UNION ALL SELECT query_id, 'dense', node_id, rank FROM dn) WHERE node_id IN (SELECT node_id FROM ok))",
    "fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS pos FROM (SELECT query_id, node_id, max(1 / (60 + rank)) AS score FROM lg GROUP BY query_id, node_id)) WHERE pos <= 9)",
]
DEG = "deg AS (SELECT node_id, count(e) AS degree FROM nodes LEFT JOIN (SELECT source_id AS e FROM edges UNION ALL SELECT target_id FROM edges) ON e = node_id GROUP BY node_id)"
SES = "ses AS (SELECT project, count(DISTINCT s) AS sessions FROM (SELECT project, unnest(sources) AS s FROM nodes WHERE status = 'active' AND type = 'persistent' AND project IS NOT NULL) GROUP BY project)"
_DAYS = f"greatest(0, (epoch(TIMESTAMP '{NOW}') - epoch(last_accessed)) / 86400)"
_ACT = f"CASE WHEN used_count + 0.25 * injected_count > 0 THEN least(0.6, 0.15 * ln(1 + (used_count + 0.25 * injected_count) * power(greatest(1, coalesce(sessions, {_DAYS})), -0.5))) ELSE 0 END"
_HUB = "CASE WHEN degree > 0 THEN -0.08 * ln(1 + degree) ELSE 0 END"
_STATUS = "CASE status WHEN 'superseded' THEN ln(0.1) WHEN 'disputed' THEN ln(0.5) ELSE 0 END"
_PEN = f"CASE type WHEN 'persistent' THEN -0.2 + {_ACT} + {_HUB} ELSE ln(0.98) * {_DAYS} END"
CTX = [DEG, SES]


@query(sql("SELECT query_id, node_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM leg", *LEX))
def bm25_leg(t):
    return t.lexical_index().top(queries_of(t), 20).where("leg = 0").select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


@query(sql("SELECT query_id, node_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM mg", *LEX))
def lexical_merge(t):
    return X.merged(t.lexical_index(), queries_of(t)).withColumn("score", F.round("score", 6))


@query(sql("SELECT query_id, CAST(count(node_id) AS BIGINT) AS hits FROM q LEFT JOIN mg USING (query_id) GROUP BY query_id", *LEX))
def lexical_hits(t):
    return X.hit_count(t.lexical_index(), queries_of(t))


@query(sql("SELECT query_id, node_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM leg", *LEX))
def lexical_index_changes(t):
    """The index of notes as they once were (a third not there yet, a third shorter, some since gone), after what has changed."""
    n = t.texts().select("seq", "node_id", "title", "content", "tags")
    gone = n.where("seq % 4 = 0").withColumn("node_id", F.concat(F.lit("gone"), F.col("node_id")))
    once = n.where("seq % 3 > 0").withColumn("content", F.when(F.col("seq") % 3 == 1, F.reverse("content")).otherwise(F.col("content")))
    index = X.LexicalIndex.build(once.union(gone), scratch_folder(t.spark, "lexical"))
    index = index.changed(n.where("seq % 3 < 2"), gone.select("node_id"))
    return index.top(queries_of(t), 20).where("leg = 0").select("query_id", "node_id", F.round("score", 6).alias("score"), "rank")


@query(sql("SELECT query_id, node_id, round(score, 6) AS score, CAST(pos AS INTEGER) AS pos FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS pos FROM (SELECT query_id, node_id, max(1 / (60 + rank)) AS score FROM (SELECT seq % 30 AS query_id, 'a' AS leg, node_id, row_number() OVER (PARTITION BY seq % 30 ORDER BY used_count DESC, node_id) AS rank FROM nodes UNION ALL SELECT seq % 30, 'b', node_id, row_number() OVER (PARTITION BY seq % 30 ORDER BY retrieved_count DESC, node_id) FROM nodes) GROUP BY ALL)) WHERE pos <= 9"))
def rrf_max_fusion(t):
    n = t.nodes().withColumn("query_id", F.col("seq") % 30)
    legs = [n.selectExpr("query_id", f"'{leg}' leg", "node_id", f"row_number() over (partition by query_id order by {c} desc, node_id) rank") for leg, c in (("a", "used_count"), ("b", "retrieved_count"))]
    return H.fused(legs[0].union(legs[1])).withColumn("score", F.round("score", 6))


def _context(t):
    n, e = t.nodes(), t.edges()
    return n.join(N.degrees(n, e), "node_id").join(N.project_sessions(n), "project", "left")


@query(sql(f"SELECT node_id, round(1.5 + {_PEN} + {_STATUS}, 6) AS score FROM nodes JOIN deg USING (node_id) LEFT JOIN ses USING (project)", *CTX))
def decay_score(t):
    return H.scored(_context(t).withColumn("rerank_score", F.lit(1.5)), NOW).select("node_id", F.round("score", 6).alias("score"))


@query(sql(f"SELECT node_id, round({_ACT}, 6) AS activation, round({_HUB}, 6) + 0.0 AS hub_penalty, round({_STATUS}, 6) + 0.0 AS status_penalty FROM nodes JOIN deg USING (node_id) LEFT JOIN ses USING (project)", *CTX))
def penalties(t):
    days = S.elapsed_days(F.lit(NOW).cast("timestamp"), F.col("last_accessed"))
    act = S.activation(F.col("used_count"), F.col("injected_count"), F.coalesce(F.col("sessions").cast("double"), days))
    return _context(t).select("node_id", F.round(act, 6).alias("activation"), (F.round(S.hub_penalty(F.col("degree")), 6) + 0.0).alias("hub_penalty"), (F.round(S.status_penalty(F.col("status")), 6) + 0.0).alias("status_penalty"))


@query(sql("SELECT query_id, node_id, rerank >= 0.25 AND rerank >= max(rerank) OVER (PARTITION BY query_id) - 2.5 AND verified IS DISTINCT FROM false AS inject FROM (SELECT seq % 50 AS query_id, node_id, verified, (seq * 37 % 101) / 20 AS rerank FROM nodes)"))
def inject_gate(t):
    n = t.nodes().withColumn("query_id", F.col("seq") % 50).withColumn("rerank", (F.col("seq") * 37 % 101) / 20)
    return n.select("query_id", "node_id", S.inject(F.col("rerank"), F.col("verified"), "query_id").alias("inject"))


_W = "regexp_extract_all(lower({}), '[\\p{{L}}\\p{{N}}_]+')"
_DOC = "array_to_string(list_filter([title, 'Tags: ' || array_to_string(tags, ', '), trim(content)], lambda x: x <> ''), chr(10) || chr(10))"
_RR = "CASE WHEN len(qw) = 0 THEN 0 ELSE round(3 * k / greatest(1, len(list_distinct(qw))) + k / greatest(1, len(list_distinct(dw))) + CASE WHEN trim(text) <> '' AND contains(lower(doc), lower(text)) THEN 1 ELSE 0 END + CASE WHEN contains(array_to_string(dw, ' '), array_to_string(qw, ' ')) THEN 0.75 ELSE least(0.5, 0.1 * len(list_filter(list_transform(range(1, len(qw)), lambda i: qw[i] || ' ' || qw[i + 1]), lambda p: contains(array_to_string(dw, ' '), p)))) END, 6) END"
RERANK = ["cd AS (SELECT c.query_id, c.node_id, c.anchor, text, ok.*EXCLUDE (node_id), {} AS doc FROM ca c JOIN ok USING (node_id) JOIN q USING (query_id))".format(_DOC), f"rk AS (SELECT *, {_RR} AS rerank_score FROM (SELECT *, {_W.format('text')} AS qw, {_W.format('doc')} AS dw, len(list_intersect({_W.format('text')}, {_W.format('doc')})) AS k FROM cd))"]
CANDIDATES = [
    "nb AS (SELECT query_id, o AS node_id, count(*) AS w FROM fu JOIN (SELECT source_id AS a, target_id AS o FROM edges UNION ALL SELECT target_id, source_id FROM edges) ON a = node_id WHERE NOT EXISTS (SELECT 1 FROM fu x WHERE x.query_id = fu.query_id AND x.node_id = o) GROUP BY ALL)",
    "ca AS (SELECT query_id, node_id, true AS anchor FROM fu UNION ALL SELECT query_id, node_id, false FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, node_id) AS p FROM nb) JOIN (SELECT query_id, 9 - count(*) AS slots FROM fu GROUP BY query_id) USING (query_id) WHERE p <= slots)",
]


@query(sql(f"SELECT query_id, CAST(pos AS INTEGER) AS pos, node_id, rerank_score, score, anchor AS is_anchor, rerank_score >= 0.25 AND rerank_score >= max(rerank_score) OVER (PARTITION BY query_id) - 2.5 AND verified IS DISTINCT FROM false AS inject FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS pos FROM (SELECT *, round(rerank_score + {_PEN} + {_STATUS}, 6) AS score FROM rk JOIN deg USING (node_id) LEFT JOIN ses USING (project))) WHERE pos <= 5", *LEX, *LEGS, *CTX, *CANDIDATES, *RERANK))
def hybrid_search(t):
    keep = ~((F.col("type") == "transient") & (F.col("seq") % 10 == 0))
    return H.search(queries_of(t), t.nodes(), t.edges(), t.vectors(), NOW, keep, index=t.lexical_index())


_FOUND = f"sc AS (SELECT query_id // 4 AS draft_id, query_id, node_id, round(rerank_score + {_PEN} + {_STATUS}, 6) AS score FROM rk JOIN deg USING (node_id) LEFT JOIN ses USING (project)), fit AS (SELECT * FROM sc WHERE least(1, greatest(0, score)) >= 0.3), top AS (SELECT draft_id, node_id, max(score) AS best FROM fit GROUP BY ALL), since AS (SELECT draft_id, node_id, best, min(query_id) AS q0 FROM fit JOIN top USING (draft_id, node_id) WHERE score = best GROUP BY ALL)"


@query(sql("SELECT draft_id, CAST(pos AS INTEGER) AS pos, node_id, least(1, best) AS score, matched FROM (SELECT draft_id, node_id, best, array_to_string(list(query_id ORDER BY query_id), ',') AS matched, row_number() OVER (PARTITION BY draft_id ORDER BY best DESC, node_id) AS pos FROM fit JOIN since USING (draft_id, node_id) WHERE query_id >= q0 GROUP BY draft_id, node_id, best) WHERE pos <= 9", *LEX, *LEGS, *CTX, *CANDIDATES, *RERANK, _FOUND))
def write_candidates(t):
    """Every four queries are one draft's."""
    keep = ~((F.col("type") == "transient") & (F.col("seq") % 10 == 0))
    found = H.search(queries_of(t), t.nodes(), t.edges(), t.vectors(), NOW, keep, top_k=H.MAX_CANDIDATES, index=t.lexical_index())
    found = H.write_candidates(found.selectExpr("query_id div 4 draft_id", "query_id", "node_id", "score"))
    return found.withColumn("matched", F.array_join("matched", ","))


@query(sql("SELECT query_id, CAST(count(*) AS INTEGER) AS results, sha256(string_agg(block, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos)) AS digest FROM (SELECT query_id, pos, CASE status WHEN 'disputed' THEN '[DISPUTED] ' ELSE '' END || title || chr(10) || 'Path: notes/' || node_id || '.md' || chr(10) || 'Status: ' || status || chr(10) || chr(10) || trim(content, ' ' || chr(9) || chr(10) || chr(13)) AS block FROM (SELECT seq % 40 AS query_id, row_number() OVER (PARTITION BY seq % 40 ORDER BY seq) AS pos, * FROM nodes) WHERE pos <= 5) GROUP BY query_id"))
def context_blocks(t):
    """Of every fortieth node five, as one reader's context."""
    n = t.nodes().withColumn("query_id", F.col("seq") % 40).withColumn("pos", F.expr("row_number() over (partition by query_id order by seq)")).where("pos <= 5")
    block = H.context_block(F.col("title"), F.concat(F.lit("notes/"), F.col("node_id"), F.lit(".md")), F.col("status"), F.col("content"))
    n = n.select("query_id", "pos", block.alias("block"))
    return H.contexts(n).join(n.groupBy("query_id").agg(F.count("*").cast("int").alias("results")), "query_id").select("query_id", "results", F.sha2("context", 256).alias("digest"))
