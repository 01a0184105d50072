"""The whole retrieval as one plan for many queries at once: legs, fusion, neighbours, rerank, scores, gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memgrid.functions import scoring as S
from memgrid.operators import lexical, lexical_index, nodes as N, vectors as V
from memgrid.operators.cuts import checkpointed
from memgrid.operators.vector_cells import VectorIndex

MAX_CANDIDATES, LEG_LIMIT, TOP_K, RRF_K = 9, 20, 5, 60


def words(text: Column) -> Column:
    """F4."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def document(title: str = "title", tags: str = "tags", content: str = "content") -> Column:
    """What a node is reranked by."""
    label = F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", ")))
    return F.array_join(F.filter(F.array(F.col(title), label, F.trim(F.col(content))), lambda x: x.isNotNull() & (x != "")), "\n\n")


def rerank_score(query: Column, doc: Column) -> Column:
    """V5 without the bias of a model's name: coverage, density, phrase and order."""
    q, d = words(query), words(doc)
    both = F.size(F.array_intersect(q, d))
    joined_q, joined_d = F.array_join(q, " "), F.array_join(d, " ")
    pairs = F.zip_with(F.slice(q, 1, F.greatest(F.lit(0), F.size(q) - 1)), F.slice(q, 2, F.size(q)), lambda a, b: F.concat(a, F.lit(" "), b))
    steps = F.size(F.filter(pairs, lambda p: F.contains(joined_d, p)))
    order = F.when(F.contains(joined_d, joined_q), 0.75).otherwise(F.least(F.lit(0.5), steps * 0.1))
    phrase = F.when((F.trim(query) != "") & F.contains(F.lower(doc), F.lower(query)), 1.0).otherwise(0.0)
    score = 3.0 * both / F.greatest(F.lit(1), F.size(F.array_distinct(q))) + both / F.greatest(F.lit(1), F.size(F.array_distinct(d))) + phrase + order
    return F.when(F.size(q) == 0, 0.0).otherwise(F.round(score, 6))


def fused(legs: DataFrame, limit: int = MAX_CANDIDATES, k: int = RRF_K) -> DataFrame:
    """The best 1 / (k + rank) of any leg (query_id, leg, node_id, rank), not the sum."""
    best = legs.groupBy("query_id", "node_id").agg(F.max(S.reciprocal_rank(F.col("rank"), k)).alias("score"))
    pos = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "node_id"))
    return best.withColumn("pos", pos).where(F.col("pos") <= limit)


def reranked_legs(legs: DataFrame, keep: DataFrame) -> DataFrame:
    """Ranks again after the filter, which comes before the fusion: what it drops takes up no place."""
    rank = F.row_number().over(W.partitionBy("query_id", "leg").orderBy("rank"))
    return legs.join(keep.select("node_id"), "node_id", "left_semi").withColumn("rank", rank)


def scored(candidates: DataFrame, now: str) -> DataFrame:
    """R4-R7 over rerank_score, type, status, counters, last_accessed, degree and sessions (null: none known)."""
    days = S.elapsed_days(F.lit(now).cast("timestamp"), F.col("last_accessed"))
    act = S.activation(F.col("used_count"), F.col("injected_count"), F.coalesce(F.col("sessions").cast("double"), days))
    penalty = S.decay(F.col("type"), days, act, S.hub_penalty(F.col("degree"))) + S.status_penalty(F.col("status"))
    return candidates.withColumn("score", F.col("rerank_score") + penalty)


def search(queries: DataFrame, nodes: DataFrame, edges: DataFrame, vectors: DataFrame, now: str, keep: Column | None = None, top_k: int = TOP_K, max_candidates: int = MAX_CANDIDATES, chunks: DataFrame | None = None, reranks: bool = True, index: lexical_index.LexicalIndex | None = None, stored: VectorIndex | None = None) -> DataFrame:
    """Results of each query (query_id, text, vector): query_id, pos, node_id, rerank_score, score, is_anchor, inject.

    V3: chunks (query_id, chunk > 0, vector) of a long query each vote as a dense leg of their own.
    R3: without a reranker (reranks false) all rerank scores are 0, and penalties alone decide.
    The lexical leg reads a stored index of the nodes; without one it cuts all of them into tokens.
    The dense legs read cells of stored vectors, or without those all vectors.
    """
    allowed = nodes.where(keep) if keep is not None else nodes
    asked_texts = queries.select("query_id", "text")
    lex = lexical_index.merged(index, asked_texts, LEG_LIMIT) if index else lexical.merged_legs(asked_texts, nodes, LEG_LIMIT)
    lex = lex.select("query_id", F.lit("lexical").alias("leg"), "node_id", "rank")
    asked = queries.select("query_id", F.lit(0).alias("chunk"), "vector")
    if chunks is not None:
        asked = asked.unionByName(chunks.select("query_id", "chunk", "vector"))
    asked = asked.withColumn("ask", F.xxhash64("query_id", "chunk"))
    by_ask = asked.selectExpr("ask query_id", "vector")
    hits = stored.nearest(by_ask, LEG_LIMIT) if stored else V.top_k_many(vectors, by_ask, LEG_LIMIT)
    dense = hits.withColumnRenamed("query_id", "ask").join(asked.drop("vector"), "ask")
    dense = dense.select("query_id", F.concat(F.lit("dense"), F.col("chunk")).alias("leg"), "node_id", "rank")
    # a few rows for each query, which five later joins start from
    anchors = checkpointed(queries.sparkSession)(fused(reranked_legs(lex.unionByName(dense), allowed), max_candidates).select("query_id", "node_id", F.col("score").alias("anchor_score")))
    slots = anchors.groupBy("query_id").agg((F.lit(max_candidates) - F.count("*")).alias("slots"))
    near = N.neighbours(edges, anchors.select("query_id", "node_id"), max_candidates).join(slots, "query_id").where("pos <= slots").select("query_id", "node_id", F.lit(None).cast("double").alias("anchor_score"))
    candidates = anchors.unionByName(near)
    found = candidates.join(allowed, "node_id").join(queries.select("query_id", "text"), "query_id")
    found = found.withColumn("rerank_score", rerank_score(F.col("text"), document()) if reranks else F.lit(0.0))
    found = found.join(N.degrees(candidates.select("node_id").distinct(), edges), "node_id").join(N.project_sessions(nodes), "project", "left")
    pos = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(F.round("score", 6)), "node_id"))
    final = scored(found, now).withColumn("pos", pos).where(F.col("pos") <= top_k)
    return final.select("query_id", "pos", "node_id", "rerank_score", F.round("score", 6).alias("score"), F.col("anchor_score").isNotNull().alias("is_anchor"), S.inject(F.col("rerank_score"), F.col("verified"), "query_id").alias("inject"))


def write_candidates(found: DataFrame, threshold: float = 0.3, limit: int = MAX_CANDIDATES) -> DataFrame:
    """draft_id, pos, node_id, score, matched: what a draft's queries (in order of query_id) found.

    found: draft_id, query_id, node_id, score. A score counts if it reaches the threshold once it is
    held to [0, 1]. Each better score starts the list of matching queries anew, so it holds the
    queries from the first with the best score on.
    """
    fit = found.withColumn("held", F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("score"))), 6)).where(F.col("held") >= threshold)
    best = fit.groupBy("draft_id", "node_id").agg(F.max("score").alias("raw"), F.max("held").alias("score"), F.array_sort(F.collect_list(F.struct("query_id", F.col("score").alias("s")))).alias("all"))
    first = F.array_min(F.transform(F.filter("all", lambda x: x["s"] == F.col("raw")), lambda x: x["query_id"]))
    matched = F.transform(F.filter("all", lambda x: x["query_id"] >= F.col("first")), lambda x: x["query_id"])
    pos = F.row_number().over(W.partitionBy("draft_id").orderBy(F.desc("raw"), "node_id"))
    return best.withColumn("first", first).select("draft_id", pos.alias("pos"), "node_id", "score", matched.alias("matched")).where(F.col("pos") <= limit)


def context_block(title: Column, path: Column, status: Column, content: Column) -> Column:
    """What a result says to a reader."""
    mark = F.when(status == "disputed", "[DISPUTED] ").otherwise("")
    return F.trim(F.concat(mark, title, F.lit("\nPath: "), path, F.lit("\nStatus: "), status, F.lit("\n\n"), F.trim(content, F.lit(" \n\t\r"))), F.lit(" \n\t\r"))


def contexts(results: DataFrame) -> DataFrame:
    """query_id, context: the blocks of each query's results (query_id, pos, block) in order, between rules."""
    return results.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "block"))), lambda x: x["block"]), "\n\n---\n\n").alias("context"))
