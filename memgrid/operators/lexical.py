"""Lexical retrieval: positions, phrases, BM25, and the merge of two legs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from memgrid.functions.scoring import reciprocal_rank
from memgrid.functions.text import cjk_bigrams, fts_tokens, has_cjk, or_terms

K1, B = 1.2, 0.75
#: Positions that a column takes up, so that no phrase runs from one into the next.
COLUMN = 1 << 24
#: Terms up to which the queries' tokens are broadcast.
BROADCAST_ROWS = 1_000_000


def fields() -> list[Column]:
    """What of a note is cut into tokens."""
    return [F.coalesce(f, F.lit("")) for f in (F.col("title"), F.col("content"), F.array_join("tags", " "))]


def tokenized(nodes: DataFrame, *kept: str) -> DataFrame:
    """L1, L2: node_id, other columns to be kept, plain and bigram: tokens of title, content and tags, an array for each field.

    bigram is the shadow index; it is null where the fields hold no CJK character, as both are the same then.
    """
    texts = fields()
    plain = F.array(*map(fts_tokens, texts))
    bigram = F.when(has_cjk(F.concat(*texts)), F.array(*[fts_tokens(cjk_bigrams(f)) for f in texts]))
    return nodes.select("node_id", *kept, plain.alias("plain"), bigram.alias("bigram"))


def postings(nodes: DataFrame) -> DataFrame:
    """node_id, pos, token of the shadow index; a position counts from its field's multiple of COLUMN."""
    at = F.flatten(F.transform(F.coalesce("bigram", "plain"), lambda f, k: F.transform(f, lambda t, i: F.struct((i + k * COLUMN).alias("pos"), t.alias("token")))))
    return tokenized(nodes).select("node_id", F.explode(at).alias("p")).select("node_id", "p.*")


def length(fields: Column) -> Column:
    return F.aggregate(fields, F.lit(0), lambda n, f: n + F.size(f))


def leg_scores(queries: DataFrame, nodes: DataFrame) -> DataFrame:
    """L3, L4 for both legs at once: query_id, leg (0 plain, 1 bigram), node_id, score for each node that holds a term.

    queries: query_id, text. A term is a phrase of one or more tokens. A term's token i at position
    p votes for a phrase that starts at p - i; a start with all votes is an occurrence. Nodes are
    cut into tokens once for their postings, of which only those that some query asks for leave the
    task, with the length of their node, and once for the lengths' sum. leg is null while both are the same.
    """
    terms = queries.select("query_id", F.posexplode(or_terms(F.col("text"))).alias("term", "t")).select("query_id", fts_tokens(F.col("t")).alias("tokens")).where(F.size("tokens") > 0).select("query_id", F.array_join("tokens", " ").alias("phrase"))
    # the same phrase in several queries is looked up once
    wanted = terms.select("phrase").distinct().select("phrase", F.split("phrase", " ").alias("tokens")).select("phrase", F.size("tokens").alias("size"), F.posexplode("tokens").alias("i", "token"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    def posts(fields: Column, leg: Column) -> Column:
        each = F.transform(fields, lambda f, k: F.transform(f, lambda t, i: F.struct(leg.alias("leg"), (i + k * COLUMN).alias("pos"), t.alias("token"))))
        return F.flatten(each)

    cut = tokenized(nodes)
    same = F.col("bigram").isNull()
    both = F.when(same, posts(F.col("plain"), F.lit(None).cast("int"))).otherwise(F.concat(posts(F.col("plain"), F.lit(0)), posts(F.col("bigram"), F.lit(1))))
    rows = cut.select("node_id", length(F.col("plain")).alias("len0"), length(F.coalesce("bigram", "plain")).alias("len1"), F.explode(both).alias("p")).select("node_id", "len0", "len1", "p.*")
    # a word alone needs no vote; a node's postings are in one task, so both counts add up there
    start = F.when(F.col("size") > 1, F.col("pos") - F.col("i"))
    found = rows.join(wanted, "token").groupBy("node_id", "phrase", "leg", "size", "len0", "len1", start.alias("start")).agg(F.count("*").alias("votes"))
    times = F.when(F.col("size") == 1, F.col("votes")).otherwise((F.col("votes") == F.col("size")).cast("long"))
    tf = found.groupBy("node_id", "phrase", "leg", "len0", "len1").agg(F.sum(times).alias("tf")).where("tf > 0")
    tf = tf.select("phrase", "node_id", "tf", "len0", "len1", F.explode(F.when(F.col("leg").isNull(), F.array(F.lit(0), F.lit(1))).otherwise(F.array("leg"))).alias("leg"))
    tf = tf.select("phrase", "node_id", "tf", "leg", F.when(F.col("leg") == 0, F.col("len0")).otherwise(F.col("len1")).alias("len"))
    df = tf.groupBy("phrase", "leg").agg(F.count("*").alias("df"))
    total = cut.agg(F.count("*").alias("n"), F.sum(length(F.col("plain"))).alias("sum0"), F.sum(length(F.coalesce("bigram", "plain"))).alias("sum1"))  # one row
    idf = F.greatest(F.lit(1e-6), F.ln((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    df = df.crossJoin(F.broadcast(total)).select("phrase", "leg", idf.alias("idf"), (F.when(F.col("leg") == 0, F.col("sum0")).otherwise(F.col("sum1")) / F.col("n")).alias("avg"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    weight = tf.join(df, ["phrase", "leg"]).select("phrase", "leg", "node_id", part.alias("part"))
    return terms.join(weight, "phrase").groupBy("query_id", "leg", "node_id").agg(F.sum("part").alias("score"))


def bm25(queries: DataFrame, nodes: DataFrame, bigrams: bool = False) -> DataFrame:
    """One leg: query_id, node_id, score."""
    return leg_scores(queries, nodes).where(F.col("leg") == int(bigrams)).drop("leg")


def ranked(scores: DataFrame, limit: int, *by: str) -> DataFrame:
    """Rank within each query (and `by`) by score, then id. Scores are rounded first, so ties are ties."""
    w = W.partitionBy("query_id", *by).orderBy(F.desc(F.round("score", 8)), "node_id")
    return scores.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)


def merged_legs(queries: DataFrame, nodes: DataFrame, limit: int = 20) -> DataFrame:
    """Two legs, the plain and the bigram index, summed by reciprocal rank (times 100)."""
    legs = ranked(leg_scores(queries, nodes), limit, "leg")
    total = legs.groupBy("query_id", "node_id").agg((F.sum(reciprocal_rank(F.col("rank"))) * 100).alias("score"))
    return ranked(total, limit)


def hit_count(queries: DataFrame, nodes: DataFrame, limit: int = 20) -> DataFrame:
    """Hits of each query, none included."""
    n = merged_legs(queries, nodes, limit).groupBy("query_id").agg(F.count("*").alias("hits"))
    return queries.select("query_id").join(n, "query_id", "left").na.fill(0, ["hits"])
