"""Vector retrieval, similarity joins and clusters (V*, J7-J10, A29)."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memgrid.functions.text import inferred_project, jaccard, project_slug, token_set
from memgrid.operators.blocks import BLOCK, PER_BLOCK, PER_QUERY_BLOCK, Nearest
from memgrid.operators.cuts import checkpointed
from memgrid.operators.vector_cells import VectorIndex, pair_counts, similar_pairs, similar_partners  # noqa: F401  callers take them from here


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def normalized(v: Column) -> Column:
    """unit length, eight digits; a zero vector stays zero."""
    size = F.sqrt(dot(v, v))
    return F.when(size > 0, F.transform(v, lambda x: F.round(x / size, 8))).otherwise(v)


def distance(a: Column | str, b: Column | str) -> Column:
    """Cosine distance of unit vectors, eight digits, in [0, 2]."""
    return F.round(1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))), 8) + 0.0


def top_k(vectors: DataFrame, query: list[float], k: int) -> DataFrame:
    """The k nearest by distance, then id. A top-k of each partition meets the others', so nothing is sorted whole."""
    q = F.array(*map(F.lit, query))
    return vectors.where(F.size("embedding") == len(query)).select("node_id", distance(F.col("embedding"), normalized(q)).alias("distance")).orderBy("distance", "node_id").limit(k)


def changed(vectors: DataFrame, upserts: DataFrame, deletes: DataFrame) -> DataFrame:
    """V2: the next snapshot of vectors (node_id, embedding); an upsert of a deleted node wins."""
    gone = upserts.select("node_id").union(deletes.select("node_id"))
    return vectors.join(gone, "node_id", "left_anti").unionByName(upserts.select("node_id", "embedding"))


#: Numbers in the queries' vectors (64 MB) up to which they are sent to each task.
SENT = 8_000_000


def top_k_many(vectors: DataFrame, queries: DataFrame, k: int, sent: int = SENT) -> DataFrame:
    """V1 for a table of queries (query_id, vector): query_id, node_id, distance, rank of the k nearest, ties by id.

    Queries of another size than a vector don't meet it. Few queries are sent to each task, which
    hands on its k best for each. Are there more than `sent` numbers in them, then queries and
    vectors are dealt to the cells of a grid, and a cell hands on its k best for each of its queries.
    """
    kind = "query_id long, node_id string, distance double"
    queries = queries.select(F.col("query_id").cast("long").alias("query_id"), "vector", F.size("vector").alias("d")).where("vector IS NOT NULL")
    n = queries.agg(F.count("*").alias("n"), F.coalesce(F.sum("d"), F.lit(0)).alias("size")).first()
    if n["size"] <= sent:
        by: dict[int, list] = {}
        for r in queries.collect():  # no more than `sent` numbers
            by.setdefault(r.d, []).append(r)
        blocks = [(np.array([r.query_id for r in rows]), np.array([r.vector for r in rows], float)) for rows in by.values()]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            near = [Nearest(ids, q, k) for ids, q in blocks]
            for batch in batches:
                names, rows = np.array(batch.column("node_id").to_pylist(), object), batch.column("embedding").to_pylist()
                for x in near:
                    x.see(names, rows)
            yield from (x.found() for x in near)

        best = vectors.select("node_id", "embedding").mapInArrow(run, kind)
    else:
        rows, columns = n["n"] // PER_QUERY_BLOCK + 1, vectors.count() // (8 * PER_BLOCK) + 1
        q = queries.select(F.col("query_id").alias("id"), "vector", "d", F.pmod(F.xxhash64("query_id"), F.lit(rows)).alias("i"), F.explode(F.sequence(F.lit(0), F.lit(columns - 1))).alias("j"))
        v = vectors.where("embedding IS NOT NULL").select("node_id", "embedding", F.size("embedding").alias("d"), F.explode(F.sequence(F.lit(0), F.lit(rows - 1))).alias("i"), F.pmod(F.xxhash64("node_id"), F.lit(columns)).alias("j"))

        def cell(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame([], columns=["query_id", "node_id", "distance"])
            near = Nearest(left.id.to_numpy(), np.vstack(left.vector.to_numpy()).astype(float), k)
            for at in range(0, len(right), BLOCK):
                part = right.iloc[at : at + BLOCK]
                near.see(part.node_id.to_numpy(object), list(part.embedding))
            return near.found().to_pandas()

        best = q.groupBy("d", "i", "j").cogroup(v.groupBy("d", "i", "j")).applyInPandas(cell, kind)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("distance", "node_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k)


def unlinked(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs that no edge links in either direction."""
    linked = edges.select(F.least("source_id", "target_id").alias("id_a"), F.greatest("source_id", "target_id").alias("id_b"))
    return pairs.join(linked, ["id_a", "id_b"], "left_anti")


def histogram(pairs: DataFrame, thresholds: tuple[float, ...]) -> DataFrame:
    """Pairs at or above each threshold."""
    return pairs.select(F.explode(F.filter(F.array(*map(F.lit, thresholds)), lambda t: F.col("sim") >= t)).alias("threshold")).groupBy("threshold").agg(F.count("*").alias("n"))


#: Ids of notes up to which they are sent to each task, so that other notes' texts don't travel.
SENT_IDS = 1_000_000


def near_duplicates(vectors: DataFrame, nodes: DataFrame, sources: DataFrame, threshold: float = 0.88, candidates: int = 25, overlap: float | None = None, index: VectorIndex | None = None) -> DataFrame:
    """Of each source's nearest `candidates` (itself among them) those that pass; the filter comes after the cut.

    With `overlap`, the token sets of both contents must have that Jaccard similarity as well. With a
    stored index of the vectors only cells that may hold one of the nearest are read. Only notes that
    are in some pair are cut into tokens, and a token travels as its 64-bit hash.
    """
    q = sources.join(vectors, "node_id").select(F.xxhash64("node_id").alias("query_id"), F.col("node_id").alias("source"), F.col("embedding").alias("vector"))
    hits = (index.nearest(q, candidates) if index else top_k_many(vectors, q, candidates)).withColumn("sim", F.round(1 - F.col("distance"), 8)).where(F.col("sim") >= threshold)
    fit = nodes.where("status = 'active' AND type = 'persistent' AND okf_type IS NOT NULL").select("node_id", F.coalesce("project", F.lit("")).alias("p"))
    own = nodes.select(F.xxhash64("node_id").alias("query_id"), F.col("node_id").alias("source"), F.coalesce("project", F.lit("")).alias("p"))
    hits = hits.join(own, "query_id").where(F.col("node_id") != F.col("source")).join(fit, ["node_id", "p"]).select("source", "node_id", "sim")
    if overlap is None:
        return hits
    cut = checkpointed(vectors.sparkSession)
    hits = cut(hits)
    asked = cut(hits.select("node_id").union(hits.select("source")).distinct())
    asked = F.broadcast(asked) if asked.count() <= SENT_IDS else asked
    tokens = cut(nodes.select("node_id", "content").join(asked, "node_id", "left_semi").select("node_id", F.transform(token_set(F.col("content")), lambda x: F.xxhash64(x)).alias("x")))  # met twice, cut once
    both = hits.join(tokens, "node_id").join(tokens.selectExpr("node_id source", "x y"), "source")
    return both.where(jaccard(F.col("x"), F.col("y")) >= overlap).select("source", "node_id", "sim")


def connected(pairs: DataFrame) -> DataFrame:
    """Least node of each node's component of pairs (id_a, id_b); a label travels and jumps each round, until none changes."""
    spark = pairs.sparkSession
    both = pairs.select("id_a", "id_b").union(pairs.select("id_b", "id_a")).toDF("node_id", "other").distinct().persist()
    labels = both.groupBy("node_id").agg(F.min("other").alias("m")).select("node_id", F.least("node_id", "m").alias("label"))
    cut = checkpointed(spark)
    try:
        while True:
            near = both.join(labels.toDF("other", "label"), "other").groupBy("node_id").agg(F.min("label").alias("m"))
            one = labels.join(near, "node_id").select("node_id", F.col("label").alias("old"), F.least("label", "m").alias("up"))
            new = cut(one.join(labels.toDF("up", "jump"), "up", "left").select("node_id", "old", F.least("up", "jump").alias("label")))
            labels = new.select("node_id", "label")
            if new.where("old <> label").isEmpty():
                break
    finally:
        both.unpersist()
    return labels


#: V9: what holds clusters apart: a project as it is written, its slug, or the one that a node's text tells.
PROJECT_MODES = ("raw", "explicit_slug", "inferred")


def cluster_project(mode: str, domains: list[tuple[str, list[str]]] | None = None) -> Column:
    """V9: a node's project in one of PROJECT_MODES; '' without one."""
    if mode == "inferred":
        return inferred_project(F.col("project"), F.col("node_id"), F.col("title"), F.col("content"), domains or [])
    raw = F.coalesce(F.trim("project"), F.lit(""))
    return raw if mode == "raw" else F.when(raw == "", "").otherwise(project_slug(raw))


def recent(vectors: DataFrame, nodes: DataFrame, cutoff: Column) -> DataFrame:
    """Vectors of active nodes that were read since a cutoff."""
    fit = nodes.where((F.col("status") == "active") & (F.col("last_accessed") >= cutoff))
    return vectors.join(fit.select("node_id"), "node_id", "left_semi")


def typed(nodes: DataFrame, vectors: DataFrame, hubs: bool = True, project: Column | None = None) -> DataFrame:
    """Active persistent nodes with a kind and a vector."""
    df = nodes.where("status = 'active' AND type = 'persistent' AND okf_type IS NOT NULL")
    if not hubs:
        df = df.where(~F.array_contains("tags", "dreamer-hub"))
    return df.select("node_id", (F.coalesce("project", F.lit("")) if project is None else project).alias("project")).join(vectors, "node_id")


def single_linkage(nodes: DataFrame, vectors: DataFrame, threshold: float = 0.80, least: int = 4, most: int = 20) -> DataFrame:
    """V8: components of the similar pairs of a project, from `least` to `most` nodes. label, node_id."""
    labels = connected(similar_pairs(typed(nodes, vectors), threshold, by="project"))
    sizes = labels.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    return labels.join(sizes.select("label"), "label").select("label", "node_id")


#: Pairs of a component up to which its clusters are told in one task, and rounds after which components are looked for again.
COMPONENT_PAIRS, PEEL = 200_000, 4


def folded(pairs: DataFrame, seed: float, most: int) -> DataFrame:
    """V9's clusters of pairs (label, id_a, id_b, sim), the pairs of a label one after the other: cluster, node_id."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        near: dict[str, dict[str, float]] = {}
        for a, b, s in zip(pdf.id_a, pdf.id_b, pdf.sim, strict=True):
            near.setdefault(a, {})[b] = s
            near.setdefault(b, {})[a] = s
        taken: set[str] = set()
        out = []
        for a, b, s in sorted(zip(pdf.id_a, pdf.id_b, pdf.sim, strict=True), key=lambda x: (-x[2], x[0], x[1])):
            if s < seed or a in taken or b in taken:
                continue
            members = [a, b]
            while len(members) < most:
                options = set.intersection(*(set(near[m]) for m in members)) - taken - set(members)
                scored = [(-min(v), c) for c in options for v in [[near[m][c] for m in members]] if max(v) >= seed]
                if not scored:
                    break
                members.append(min(scored)[1])
            taken.update(members)
            out += [(min(members), m) for m in members]
        return pd.DataFrame(out, columns=["cluster", "node_id"])

    return pairs.groupBy("label").applyInPandas(grow, "cluster string, node_id string")


def dominant_clusters(pairs: DataFrame, seed: float, most: int) -> DataFrame:
    """One round of V9 over pairs (id_a, id_b, sim): cluster, node_id of the clusters of all locally dominant seeds.

    A cluster lies among the neighbours of its seed's nodes. So a seed that comes before all seeds with
    a node within two links of its own is not touched by any of those, nor they by it: all such seeds
    grow as they would one after the other. Each step adds to each cluster the candidate whose least
    similarity is the highest, if one of its similarities reaches `seed`; it is a join along links.
    """
    cut = checkpointed(pairs.sparkSession)
    both = pairs.select("id_a", "id_b", "sim").union(pairs.select("id_b", "id_a", "sim")).toDF("v", "other", "sim")
    seeds = pairs.where(F.col("sim") >= seed).select("id_a", "id_b", F.struct((-F.col("sim")).alias("s"), "id_a", "id_b").alias("key"))
    first = seeds.select(F.col("id_a").alias("v"), "key").union(seeds.select("id_b", "key")).groupBy("v").agg(F.min("key").alias("key"))
    for _ in range(2):
        told = both.join(first.withColumnRenamed("v", "other"), "other").select("v", "key").union(first.select("v", "key"))
        first = told.groupBy("v").agg(F.min("key").alias("key"))
    chosen = cut(seeds.join(first.select(F.col("v").alias("id_a"), F.col("key").alias("first")), "id_a").where(F.col("key") == F.col("first")).select("id_a", "id_b"))
    members = chosen.select(F.col("id_a").alias("seed"), F.explode(F.array("id_a", "id_b")).alias("node_id"))
    # candidates: linked to each member so far; a node that is the a of two chosen seeds can't be
    near = members.join(both.withColumnRenamed("v", "node_id"), "node_id").join(chosen.select(F.col("id_a").alias("seed"), "id_b"), "seed").where("other <> seed AND other <> id_b")
    candidates = cut(near.groupBy("seed", F.col("other").alias("v")).agg(F.count("*").alias("n"), F.min("sim").alias("lo"), F.max("sim").alias("hi")).where("n = 2").drop("n"))
    for _ in range(most - 2):
        best = cut(candidates.where(F.col("hi") >= seed).groupBy("seed").agg(F.min(F.struct((-F.col("lo")).alias("lo"), "v")).alias("b")).select("seed", F.col("b.v").alias("added")))
        if best.isEmpty():
            break
        members = members.union(best.select("seed", "added"))
        step = candidates.join(best, "seed").where("v <> added").join(both.select(F.col("v").alias("added"), F.col("other").alias("v"), "sim"), ["added", "v"])
        candidates = cut(step.select("seed", "v", F.least("lo", "sim").alias("lo"), F.greatest("hi", "sim").alias("hi")))
    name = members.groupBy("seed").agg(F.min("node_id").alias("cluster"))
    return members.join(name, "seed").select("cluster", "node_id")


def linked(pairs: DataFrame, seed: float, most: int, component_pairs: int = COMPONENT_PAIRS) -> DataFrame:
    """V9's clusters of pairs (id_a, id_b, sim): as if seeds were taken one after the other by similarity, then ids; cluster, node_id.

    A component of the graph of pairs, which no cluster leaves, is told in one task if it has no more
    than component_pairs. Larger ones lose their locally dominant clusters round by round, until none
    is left or what is left falls into such components.
    """
    cut = checkpointed(pairs.sparkSession)
    left, out, k = cut(pairs.select("id_a", "id_b", "sim")), [], 0
    while not left.where(F.col("sim") >= seed).isEmpty():
        if k % PEEL == 0:
            rows = cut(left.join(connected(left).withColumnRenamed("node_id", "id_a"), "id_a"))
            sizes = rows.groupBy("label").agg(F.count("*").alias("n"))
            small = sizes.where(F.col("n") <= component_pairs).select("label")
            out.append(folded(rows.join(small, "label"), seed, most))
            left = cut(rows.join(small, "label", "left_anti").select("id_a", "id_b", "sim"))
        else:
            found = cut(dominant_clusters(left, seed, most))
            out.append(found)
            gone = found.select("node_id")
            left = cut(left.join(gone.withColumnRenamed("node_id", "id_a"), "id_a", "left_anti").join(gone.withColumnRenamed("node_id", "id_b"), "id_b", "left_anti").select("id_a", "id_b", "sim"))
        k += 1
    every = out[0] if out else pairs.sparkSession.createDataFrame([], "cluster string, node_id string")
    for df in out[1:]:
        every = every.unionByName(df)
    return every


#: Numbers in the vectors of a project (16 MB) up to which its clusters are told in one task, from the vectors; and partners kept of each.
PROJECT_NUMBERS, PARTNERS = 2_000_000, 16


class Partners:
    """Vectors in the order of their ids, of which some are taken; sims as similar_pairs() gives them."""

    def __init__(self, m: np.ndarray):
        self.m, self.alive = m, np.ones(len(m), bool)
        self.live, self.rows = np.arange(len(m)), m

    def take(self, members: list[int]) -> None:
        self.alive[members] = False
        if self.alive.sum() < 0.7 * len(self.live):
            self.live = np.flatnonzero(self.alive)
            self.rows = self.m[self.live]

    def sims(self, i: int) -> np.ndarray:
        """Sims of vector i and each of `live`."""
        return rounded(self.rows @ self.m[i])

    def best(self, i: np.ndarray, least: float) -> list[list[tuple[float, int]]]:
        """Of each of i its best free partners that come after it, PARTNERS of them at most, by falling sim and number: (-sim, number)."""
        s = self.m[i] @ self.rows.T
        fit = (s >= least - 1e-6) & self.alive[self.live] & (self.live > i[:, None])
        out = []
        for row, f in zip(s, fit, strict=True):
            j = np.flatnonzero(f)
            v = rounded(row[j])
            j, v = self.live[j[v >= least]], v[v >= least]
            if len(v) > PARTNERS:
                low = np.partition(v, len(v) - PARTNERS)[len(v) - PARTNERS]
                at = np.concatenate([np.flatnonzero(v > low), np.flatnonzero(v == low)])[:PARTNERS]
                j, v = j[at], v[at]
            out.append(sorted(zip((-v).tolist(), j.tolist(), strict=True), reverse=True))
        return out


def rounded(s: np.ndarray) -> np.ndarray:
    return np.round(1 - np.round(1 - np.clip(s, -1, 1), 8), 8)


def folded_vectors(ids: np.ndarray, m: np.ndarray, seed: float, floor: float, most: int) -> list[tuple[str, str]]:
    """V9's clusters of unit vectors, as folded() tells them of all their pairs: (cluster, node_id). No list of pairs is made."""
    order = np.unique(ids, return_index=True)[1]
    ids, p = ids[order], Partners(m[order])
    near: dict[int, list] = {}
    for at in range(0, len(ids), 256):
        i = np.arange(at, min(at + 256, len(ids)))
        near.update((k, x) for k, x in zip(i.tolist(), p.best(i, seed), strict=True) if x)
    full = {k for k, x in near.items() if len(x) == PARTNERS}
    heap = [(x[-1][0], k, x[-1][1]) for k, x in near.items()]
    heapq.heapify(heap)
    out = []
    while heap:
        _, a, b = heapq.heappop(heap)
        if not p.alive[a]:
            continue
        if not p.alive[b]:
            mine = near[a]
            while mine and not p.alive[mine[-1][1]]:
                mine.pop()
            if not mine and a in full:
                mine = near[a] = p.best(np.array([a]), seed)[0]
                if len(mine) < PARTNERS:
                    full.discard(a)
            if mine:
                heapq.heappush(heap, (mine[-1][0], a, mine[-1][1]))
            continue
        x, y = p.sims(a), p.sims(b)
        at = np.flatnonzero((x >= floor) & (y >= floor) & p.alive[p.live] & (p.live != a) & (p.live != b))
        others, low, high = p.live[at], np.minimum(x, y)[at], np.maximum(x, y)[at]
        members = [a, b]
        while len(members) < most and (high >= seed).any():
            k = int(np.argmax(np.where(high >= seed, low, -2)))  # the first of the highest
            members.append(int(others[k]))
            z = rounded(p.m[others] @ p.m[others[k]])
            keep = (z >= floor) & (others != others[k])
            others, low, high = others[keep], np.minimum(low, z)[keep], np.maximum(high, z)[keep]
        p.take(members)
        out += [(str(ids[min(members)]), str(ids[k])) for k in members]
    return out


def complete_linkage(nodes: DataFrame, vectors: DataFrame, seed: float = 0.86, floor: float = 0.84, most: int = 6, project: Column | None = None, component_pairs: int = COMPONENT_PAIRS, numbers: int = PROJECT_NUMBERS) -> DataFrame:
    """V9: clusters of which all pairs reach `floor`; project, cluster (its least node), node_id.

    Seeds are taken by similarity; a cluster grows by the node whose least similarity to it is the
    highest, if one similarity reaches `seed`. A project with no more than `numbers` numbers in its
    vectors is told in one task; of a larger one all similar pairs are listed and told by linked().
    """
    cut = checkpointed(vectors.sparkSession)
    t = typed(nodes, vectors, hubs=False, project=project).where("embedding IS NOT NULL")
    t = cut(t.select("node_id", F.coalesce("project", F.lit("")).alias("project"), "embedding", F.size("embedding").alias("d")))
    small = t.groupBy("project", "d").agg(F.count("*").alias("n")).where(F.col("n") * F.col("d") <= numbers).select("project", "d")

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        found = folded_vectors(pdf.node_id.to_numpy(str), np.vstack(pdf.embedding.to_numpy()).astype(float), seed, floor, most)
        return pd.DataFrame([(node, cluster, key[0]) for cluster, node in found], columns=["node_id", "cluster", "project"])

    out = t.join(small, ["project", "d"], "left_semi").groupBy("project", "d").applyInPandas(fold, "node_id string, cluster string, project string")
    large = t.join(small, ["project", "d"], "left_anti")
    if large.isEmpty():
        return out
    found = linked(similar_pairs(large, floor, by="project"), seed, most, component_pairs)
    return out.unionByName(found.join(large.select("node_id", "project"), "node_id"))


def hub_covered(clusters: DataFrame, nodes: DataFrame, share: float = 0.7) -> DataFrame:
    """Clusters (label, node_id) whose members an outside node's sources hold by `share`."""
    size = clusters.groupBy("label").agg(F.count("*").alias("n"))
    cited = nodes.where("status = 'active' AND okf_type IS NOT NULL").select(F.col("node_id").alias("hub"), F.explode(F.array_distinct("sources")).alias("node_id"))
    both = clusters.join(cited, "node_id").groupBy("label", "hub").agg(F.count("*").alias("k"))
    outside = both.join(clusters.select("label", F.col("node_id").alias("hub")), ["label", "hub"], "left_anti")
    return outside.join(size, "label").where(F.col("k") >= share * F.col("n")).select("label").distinct()
